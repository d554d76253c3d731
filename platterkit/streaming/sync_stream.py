"""Sync as a stream: snapshots arriving as files are folded into the catalogue's state, batch by batch."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from platterkit.operators.sync import latest

#: Parts of the state by a hash of the key; a batch rewrites those that its keys fall into.
BUCKETS = 256


def stream_upserts(spark: SparkSession, source: str, schema: StructType, key: str, order: str, state: str, checkpoint: str, files: int = 1, buckets: int = BUCKETS) -> StreamingQuery:
    """Starts a stream that keeps the latest row of each key of the Parquet files in ``source``, ``files`` of them a batch, in order of arrival.

    The state lies in ``<state>/batch=<n>/bucket=<b>``: each batch is reduced to its latest rows and merged with the newest earlier version of the buckets they fall into; the
    other buckets stay where they are. A batch that is run again writes its own versions anew from the same predecessors, so its result is the same. Versions
    older than these predecessors are removed. :func:`read_state` gives the whole.
    """

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = latest(batch, key, order).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = {r.bucket for r in fresh.select("bucket").distinct().collect()}  # at most ``buckets`` numbers
            written = {n: buckets for n, buckets in _written(session, state).items() if n < number}
            before = {b: n for b, n in _newest(written).items() if b in touched}
            rows = fresh
            if before:
                rows = rows.unionByName(_at(session, schema, state, before))
            merged = latest(rows, key, order)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={number}")
        finally:
            fresh.unpersist()
        _remove_older(session, state, written, before)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, schema: StructType, state: str) -> DataFrame:
    """The latest row of each key that a stream has folded into a state; none if there is no state yet."""
    now = _newest(_written(spark, state))
    return _at(spark, schema, state, now).drop("bucket") if now else spark.createDataFrame([], schema)


def _at(spark: SparkSession, schema: StructType, state: str, versions: dict[int, int]) -> DataFrame:
    """The rows of some buckets in their versions: whole batches are listed and pruned, as a path for each bucket would cost more than its rows."""
    wanted: dict[int, list[int]] = {}
    for b, n in versions.items():
        wanted.setdefault(n, []).append(b)
    rows = spark.read.schema(schema).option("basePath", state).parquet(*[f"{state}/batch={n}" for n in sorted(wanted)])
    held = reduce(or_, [(F.col("batch") == n) & F.col("bucket").isin(sorted(bs)) for n, bs in wanted.items()])
    return rows.where(held).select(*schema.fieldNames(), F.col("bucket").cast("int").alias("bucket"))


def _folder(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, at: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    fs, path = _folder(spark, at)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def _numbers(names: list[str], name: str) -> list[int]:
    return [int(n.split("=")[1]) for n in names if n.startswith(f"{name}=")]


def _written(spark: SparkSession, state: str) -> dict[int, list[int]]:
    """For each finished batch, in order, the buckets that are left of those it wrote."""
    batches = {n: _names(spark, f"{state}/batch={n}") for n in sorted(_numbers(_names(spark, state), "batch"))}
    return {n: _numbers(names, "bucket") for n, names in batches.items() if "_SUCCESS" in names}


def _newest(written: dict[int, list[int]]) -> dict[int, int]:
    """For each bucket the newest of these batches that wrote it."""
    return {b: n for n, buckets in written.items() for b in buckets}


def _remove_older(spark: SparkSession, state: str, written: dict[int, list[int]], before: dict[int, int]) -> None:
    """Removes the versions of buckets older than ``before``, and batches of which nothing is left."""
    for n, buckets in written.items():
        old = [b for b in buckets if n < before.get(b, n)]
        for at in [f"{state}/batch={n}"] if len(old) == len(buckets) else [f"{state}/batch={n}/bucket={b}" for b in old]:
            fs, path = _folder(spark, at)
            fs.delete(path, True)


def stream_counts(events: DataFrame, time: str, group: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows ``(start, <group>, n)`` of a stream or table of events in tumbling windows; rows later than ``late`` are dropped by a stream."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    counts = timed.withWatermark("__t", late) if events.isStreaming else timed
    return counts.groupBy(F.window("__t", window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
