"""Source-tree scan and JSON config documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.functions.text import any_of, file_name

# Extensions scanned, folders skipped, size limit of the documented service.
SOURCE_EXTENSIONS = [".py", ".js", ".ts", ".java", ".go", ".rs", ".cpp", ".c"]
SKIPPED_FOLDERS = ["node_modules", "__pycache__", "venv"]
MAX_FILE_BYTES = 1048576
# Bytes one cell can hold.
READABLE = (1 << 31) - 1

CONFIG_SCHEMA = """
    data_sources array<struct<name string, type string, connection_params map<string,string>,
        tables_or_files array<string>>>,
    transformations array<struct<name string, type string, parameters map<string,string>,
        input_sources array<string>, output_target string>>,
    outputs array<struct<name string, type string, format string, location string,
        schema struct<columns array<string>>>>,
    dependencies array<string>,
    processing_config struct<batch_size int, parallel_processing boolean, error_handling string>,
    metadata struct<description string, version string, created_by string, last_modified string>,
    validation struct<is_valid boolean, errors array<string>, warnings array<string>, suggestions array<string>>,
    sequence array<map<string,string>>
"""


def scan_sources(spark: SparkSession, root: str, extensions=None, max_bytes: int | None = None) -> DataFrame:
    """Text files below ``root`` with their file information.

    ``content_status`` is ``text``, ``too_large`` (above ``max_bytes``, if given, or what a cell can hold) or
    ``not_utf8``; content is NULL in the last two. The extension filter runs on the listing, so other files are never
    opened; nor are those that are too large, whose rows come from a second scan without the content.
    """
    extensions = extensions or SOURCE_EXTENSIONS
    glob = "*{" + ",".join(extensions) + "}" if len(extensions) > 1 else "*" + extensions[0]
    limit = READABLE if max_bytes is None else min(max_bytes, READABLE)
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    folders = F.split(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "/")
    base = [p for p in root.split("://")[-1].split("/") if p]
    below = F.slice(folders, F.lit(len(base) + 2), F.size(folders))
    inner = F.slice(below, F.lit(1), F.greatest(F.size(below) - 1, F.lit(0)))
    skipped = F.exists(inner, lambda d: d.isin(SKIPPED_FOLDERS) | F.startswith(d, F.lit(".")))
    name = file_name("path")
    extension = F.regexp_extract(name, r"(?s)[^.](\.[^.]+)$", 1)
    wanted = any_of(F.endswith(name, F.lit(e)) for e in extensions) & ~skipped

    def described(rows, content, status):
        return rows.where(wanted).select(
            F.col("path").alias("file_path"),
            name.alias("name"),
            extension.alias("extension"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("modified"),
            (extension == ".py").alias("is_python"),
            content.alias("content"),
            status.alias("content_status"),
        )

    text = F.col("content").cast("string")
    readable = F.is_valid_utf8(text)
    return described(
        raw.where(F.col("length") <= limit), F.when(readable, text), F.when(readable, "text").otherwise("not_utf8")
    ).unionByName(described(raw.where(F.col("length") > limit), F.lit(None).cast("string"), F.lit("too_large")))


def write_sources(files: DataFrame, path: str, mode: str = "append") -> None:
    """Text sink: one JSON record per file with path and content, in the given folder."""
    files.select("file_path", "content").write.mode(mode).json(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Config documents, one row per file, read with a fixed schema."""
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)
