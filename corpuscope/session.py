"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import corpuscope

# Functions of the library travel to the executors with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(corpuscope)

# Settings every operator relies on; the cluster's own values win elsewhere.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Sessions of a key are merged in every task before the exchange, so a hot key sends few rows.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "corpuscope") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for name, value in REQUIRED.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session made elsewhere."""
    for name, value in REQUIRED.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder, removed when the application ends.

    Only on a local master (tests on one machine) a temporary folder is made and set for the session where none is
    named; elsewhere that is an error, since each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="corpuscope-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, columnar, survives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def staged_parts(parts, purpose: str) -> DataFrame:
    """As ``staged`` for a table that is made part by part: the shuffle files of a part go before the next one is made.

    ``parts`` should make each table when it is asked for it, since shuffle files of a table that is held stay.
    """
    path = None
    for part in parts:
        spark, schema, path = part.sparkSession, part.schema, path or shared_dir(part.sparkSession, purpose)
        part.write.mode("append").option("compression", "zstd").parquet(path)
        del part
        drop_shuffles(spark, last=True)
    table = spark.read.schema(schema).parquet(path)
    table.staged_at = path
    return table


def passes_for(table: DataFrame, most: int = 8, at_once: int = 64 << 20) -> int:
    """In how many passes to work over a table: one for each ``at_once`` bytes of its files, but not more than bound the disk well."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(most, -(-size // at_once)))


def release(*tables: DataFrame) -> None:
    """Remove staged tables that nothing reads any more; whatever was made of them must be written by now."""
    for table in tables:
        context = table.sparkSession.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def drop_shuffles(spark: SparkSession, last: bool = False) -> None:
    """Let Spark remove the shuffle files of finished jobs now: it does so for what the driver's JVM has collected as garbage.

    Those of the ``last`` job go with what a first collection sets free, so they take a second one a little later.
    """
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    if last:
        time.sleep(0.3)
        jvm.System.gc()
