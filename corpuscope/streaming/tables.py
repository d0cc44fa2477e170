"""Tables that micro-batches keep up to date: snapshots of buckets of keys, put in place by one rename."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a bucket beyond which it is split when it is next written, and snapshots kept for readers that have begun.
BUCKET_BYTES = 128 << 20
KEPT = 2
BUCKET = "__bucket"
# Buckets a table begins with, as bits of the hash.
BITS = 3


class Snapshots:
    """The folders of one table: ``data/`` with written buckets and ``snapshots/`` with numbered manifests.

    A manifest names the folder of every bucket. A bucket is ``depth-number``: keys whose hash ends in these bits. A new
    manifest is written aside and renamed to the next number, so readers see the old table or the new one, and a writer that
    dies before leaves nothing that is read; the next one removes what it left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, below: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}" if below else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("snapshots") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The newest manifest, or that of a version; an empty one before the first."""
        found = self.versions()
        if not found:
            return {"version": 0, "through": -1, "schema": None, "buckets": {}}
        version = found[-1] if version is None else version
        stream = self.fs.open(self._path(f"snapshots/{version}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Put the next manifest in place; fails where another writer has been faster."""
        aside, place = self._path(f"snapshots/.{uuid.uuid4().hex}"), self._path(f"snapshots/{manifest['version']}.json")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if self.fs.exists(place) or not self.fs.rename(aside, place):
            self.fs.delete(aside, False)
            raise RuntimeError(f"version {manifest['version']} of {self.path} has been written by another")
        self._clean()

    def _clean(self) -> None:
        """Remove snapshots before the last few, and written folders that none of these names."""
        found = self.versions()
        for version in found[:-KEPT]:
            self.fs.delete(self._path(f"snapshots/{version}.json"), False)
        used = {f.split("/")[0] for v in found[-KEPT:] for f in self.manifest(v)["buckets"].values()}
        for name in set(self._names("data")) - used:
            self.fs.delete(self._path(f"data/{name}"), True)

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(f"data/{folder}")).getLength()

    def read(self, manifest: dict, buckets) -> DataFrame | None:
        """Rows of some buckets; None where there are none."""
        folders = [f"{self.path}/data/{manifest['buckets'][b]}" for b in sorted(buckets) if b in manifest["buckets"]]
        return self.spark.read.schema(manifest["schema"]).parquet(*folders) if folders else None


def _split(buckets, splitting) -> set[str]:
    """Names of buckets once some are split: both halves stand for a bucket that is, whether rows are in them or not."""
    halves = {f"{depth + 1}-{half}" for depth, number in (map(int, b.split("-")) for b in splitting) for half in (number, number + (1 << depth))}
    return (set(buckets) - set(splitting)) | halves


def _bucket(keys, buckets) -> Column:
    """Bucket of a key: the deepest of ``buckets`` with its last bits; a new one begins with ``BITS``. One branch for each depth."""
    value = F.xxhash64(*keys)
    by_depth: dict[int, list[int]] = {}
    for name in sorted(buckets):
        depth, number = map(int, name.split("-"))
        by_depth.setdefault(depth, []).append(number)

    def named(depth: int) -> Column:
        return F.concat(F.lit(f"{depth}-"), F.pmod(value, F.lit(1 << depth)).cast("string"))

    found = [F.when(F.pmod(value, F.lit(1 << depth)).isin(numbers), named(depth)) for depth, numbers in sorted(by_depth.items(), reverse=True)]
    return F.coalesce(*found, named(BITS)) if found else named(BITS)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows of the newest snapshot of a table (or of an older one that is still there)."""
    table = Snapshots(spark, path)
    manifest = table.manifest(version)
    found = table.read(manifest, manifest["buckets"])
    if found is None:
        raise FileNotFoundError(f"no rows in {path}")
    return found


def update_table(spark: SparkSession, path: str, keys, touched: DataFrame, change, through: int | None = None,
                 bucket_bytes: int = BUCKET_BYTES) -> bool:
    """Rewrite the buckets that hold the keys of ``touched`` and commit them as one snapshot; False if it was done before.

    ``change(stored)`` gives the new rows of these buckets from the stored ones (None before the first). Buckets above
    ``bucket_bytes`` are split in two as they are written. ``through`` numbers the batches of a stream: one that the
    table has seen is skipped.
    """
    table = Snapshots(spark, path)
    manifest = table.manifest()
    if through is not None and manifest["through"] >= through:
        return False
    # One short name per bucket.
    names = [r[0] for r in touched.select(_bucket(keys, manifest["buckets"]).alias("b")).distinct().collect()]
    old = {b: manifest["buckets"][b] for b in names if b in manifest["buckets"]}
    splitting = [b for b, folder in old.items() if table.size(folder) > bucket_bytes]
    rows = change(table.read(manifest, old))
    schema = manifest["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    folder = f"{manifest['version'] + 1}-{uuid.uuid4().hex}"
    # A bucket goes into one file; split by size, it fits a task.
    rows.withColumn(BUCKET, _bucket(keys, _split(manifest["buckets"], splitting))).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{table.path}/data/{folder}")
    written = {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in table._names(f"data/{folder}") if n.startswith(BUCKET)}
    kept = {b: f for b, f in manifest["buckets"].items() if b not in old}
    table.commit({"version": manifest["version"] + 1, "schema": schema, "buckets": kept | written,
                  "through": manifest["through"] if through is None else through})
    return True


def table_stream(events: DataFrame, path: str, checkpoint: str, keys, reduce_batch, merge, bucket_bytes: int = BUCKET_BYTES):
    """Writer that keeps a table; start it with a trigger and read it with :func:`read_table`.

    ``reduce_batch`` makes stored rows of a micro-batch, ``merge`` puts stored rows of old and new together; both work
    key by key. A batch rewrites the buckets it touches and is put in place as one snapshot, so cost follows the touched
    buckets, readers never see half a batch, and a batch that runs again after a failure is applied once.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        fresh = reduce_batch(batch)

        def change(stored: DataFrame | None) -> DataFrame:
            return merge(fresh if stored is None else stored.unionByName(fresh))

        update_table(batch.sparkSession, path, keys, fresh, change, batch_id, bucket_bytes)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def _with_keys(rows: DataFrame, of: DataFrame, keys, how: str) -> DataFrame:
    """Rows whose key is in ``of`` (``left_semi``) or is not (``left_anti``); NULL is a key."""
    own = of.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    return rows.join(own, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how)


def delete_from_table(spark: SparkSession, path: str, gone: DataFrame, keys) -> None:
    """Remove all rows of some keys from a kept table; readers see the table before or after."""
    update_table(spark, path, keys, gone, lambda stored: _with_keys(
        stored if stored is not None else read_table(spark, path).limit(0), gone, keys, "left_anti"))


def replace_in_table(spark: SparkSession, path: str, updates: DataFrame, keys, emptied: DataFrame | None = None) -> None:
    """Rewrite the rows of the keys of ``updates``; keys in ``emptied`` end without rows."""
    gone = updates.select(*keys) if emptied is None else updates.select(*keys).unionByName(emptied.select(*keys))

    def change(stored: DataFrame | None) -> DataFrame:
        return updates if stored is None else _with_keys(stored, gone, keys, "left_anti").unionByName(updates.select(*stored.columns))

    update_table(spark, path, keys, gone, change)
