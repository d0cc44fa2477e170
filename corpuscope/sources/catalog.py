"""API catalog: one row per public object, unique by qualified name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscope.functions.text import strip

# Catalog columns in file order.
CATALOG_COLUMNS = [
    "pyspark_version", "module", "qualname", "type", "parameters", "returns", "deprecated",
    "versionadded", "versionchanged", "versionchanged_note", "deprecated_in", "deprecated_note",
    "replacement", "docstring",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CATALOG_COLUMNS])


def read_api_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; ``deprecated`` holds only where the text is ``true`` in any case."""
    raw = (
        spark.read.schema(RAW_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    flag = F.coalesce(F.lower(strip("deprecated")) == "true", F.lit(False))
    texts = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in CATALOG_COLUMNS]
    return raw.select(texts).withColumn("deprecated", flag).select(CATALOG_COLUMNS)


def write_api_catalog(catalog: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV in the fixed column order."""
    (
        catalog.select(CATALOG_COLUMNS)
        .write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def catalog_dims(catalog: DataFrame) -> DataFrame:
    """Distinct ``(kind, name)``: modules, and class names (part before the last of names with more than two parts)."""
    parts = F.split(strip("qualname"), r"\.")
    named = catalog.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        F.col("module").isNotNull(),
                        F.struct(F.lit("module").alias("kind"), strip("module").alias("name")),
                    ),
                    F.when(
                        F.size(parts) > 2,
                        F.struct(F.lit("class").alias("kind"), F.try_element_at(parts, F.lit(-2)).alias("name")),
                    ),
                )
            )
        ).alias("dim")
    )
    return named.select("dim.kind", "dim.name").distinct()
