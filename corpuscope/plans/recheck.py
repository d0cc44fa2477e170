"""Validation that only checks contents no earlier run has checked."""

from __future__ import annotations

import hashlib
import platform
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.operators.quality import PERFORMANCE, SECURITY
from corpuscope.plans.validation import FOUND, all_findings, finding_rows
from corpuscope.session import drop_shuffles

# Raise it when what the parse reports changes: findings kept under the old number are not read any more.
PARSE_RULES = 1
# Contents are dealt over so many slots by a fast hash; a pass takes a range of them.
SLOTS = 256
KEPT = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("slot", T.ShortType()), T.StructField("run", T.StringType()),
                     T.StructField("found", FOUND)])


def rules_digest(rules, lint: bool) -> str:
    """What findings depend on besides the text, and how they are kept; the parse depends on the Python version too."""
    parse = f"{PARSE_RULES} {platform.python_version()}" if lint else ""
    return hashlib.sha256(repr((tuple(rules), parse, SLOTS, KEPT.simpleString())).encode()).hexdigest()[:16]


def kept_findings(spark: SparkSession, path: str, rules=tuple(SECURITY + PERFORMANCE), lint: bool = True) -> DataFrame:
    """``digest, slot, run, found``: kept findings by content for these rules; empty where nothing is kept yet."""
    try:
        return spark.read.schema(KEPT).parquet(f"{path}/rules={rules_digest(rules, lint)}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEPT)


def _new_findings(marked: DataFrame, kept: DataFrame, rules, lint: bool) -> DataFrame:
    """``digest, slot, found`` of contents that are not kept, each checked once."""
    # One file stands for a content: equal contents, however many, shrink in every task before they meet.
    stands = marked.where("digest is not null").groupBy("digest").agg(F.min("row").alias("row"))
    new = stands.join(kept.select("digest"), "digest", "left_anti")
    texts = marked.join(new, ["digest", "row"], "left_semi")
    return all_findings(texts, ["digest", "slot"], rules, "__text", lint)


def check_changed(files: DataFrame, path: str, rules=tuple(SECURITY + PERFORMANCE), keys=("file_path",), content: str = "content",
                  lint: bool = True, passes: int = 1) -> DataFrame:
    """As ``check_files``, plus ``known``: whether the findings of this content were read from an earlier run.

    ``path`` keeps a row for each content ever checked, by its SHA-256 and a digest of the rules (other rules, other rows). Only
    contents that are not there are checked, each once however many files hold it, and added. Which contents are new is told
    from digests; their texts then move once to be found and once to be parsed, the result moves digests and findings. A missing
    content has no findings and is never known.

    ``passes`` (up to ``SLOTS``) bounds the disk: each reads ``files`` once more for its share of the contents, and its
    shuffle files go before the next. Give more than one for a large table that is cheap to read.

    An append that fails half-way leaves whole rows of some contents, which the next run may use; two runs at once, or
    a repeated row, may add a content twice, with equal findings, and one is read. So no lock is needed.
    """
    spark = files.sparkSession
    run, passes = uuid.uuid4().hex, min(max(passes, 1), SLOTS)
    marked = files.select(F.struct(*keys).alias("file"), F.unhex(F.sha2(content, 256)).alias("digest"), F.col(content).alias("__text"))
    dealt = marked.select("digest", F.pmod(F.xxhash64("__text"), F.lit(SLOTS)).cast("short").alias("slot"), F.xxhash64("file").alias("row"), "__text")
    for at in range(passes):
        mine = (F.col("slot") >= SLOTS * at // passes) & (F.col("slot") < SLOTS * (at + 1) // passes)
        fresh = _new_findings(dealt.where(mine), kept_findings(spark, path, rules, lint).where(mine), rules, lint)
        fresh.select("digest", "slot", F.lit(run).alias("run"), "found").write.mode("append").option("compression", "zstd").parquet(
            f"{path}/rules={rules_digest(rules, lint)}")
        del fresh
        drop_shuffles(spark, last=True)
    # Findings move as JSON, in half the bytes of nested rows, and as they are: hardly any content is there twice.
    kept = kept_findings(spark, path, rules, lint).select("digest", (F.col("run") != run).alias("known"), F.to_json("found").alias("json"))
    found = kept.repartition("digest").groupBy("digest").agg(F.any_value("json").alias("json"), F.bool_and("known").alias("known"))
    joined = marked.select("file", "digest").join(found, "digest", "left")
    rows = joined.select("file.*", F.coalesce("known", F.lit(False)).alias("known"), F.from_json("json", FOUND).alias("found"))
    return finding_rows(rows, [*keys, "known"])
