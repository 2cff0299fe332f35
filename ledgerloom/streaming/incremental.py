"""Incremental jobs over append-only histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.history import latest, upsert
from ledgerloom.streaming.buckets import BucketTable

#: Hash buckets of a sink's table.
BUCKETS = 256


def monthly_totals(stream: DataFrame, day: str, value: str, keys: list[str], delay: str = "45 days") -> DataFrame:
    """Totals by month (``mes``) and keys, kept up to date in update mode. The watermark goes by months: rows of a month that began longer than the delay
    before the newest month are dropped; late_rows() counts them."""
    rows = stream.withColumn("mes", F.date_trunc("month", F.col(day).cast("timestamp"))).withWatermark("mes", delay)
    return rows.groupBy("mes", *keys).agg(F.sum(value).alias("importe"), F.count("*").alias("n"))


def late_rows(query) -> int:
    """What a query's stateful operators dropped as too late, over the progress reports that it keeps (a batch may be reported again); 0 if nothing was.

    Spark counts what reaches the state, so rows that a task had summed by key before count as one, and an aggregation counts them at each of its steps.
    """
    batches = {p["batchId"]: [int(s.get("numRowsDroppedByWatermark", 0)) for s in p["stateOperators"]] for p in query.recentProgress}
    return sum(map(sum, batches.values()))


def replace_sink(spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
    """A foreachBatch function that keeps the newest totals of each key under ``path``; for update mode. A batch rewrites the buckets that its keys fall in."""
    table = BucketTable(spark, path, keys, buckets)
    return _sink(table, lambda before, batch: batch if before is None else upsert(before.select(*batch.columns), batch, keys))


def latest_sink(spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS):
    """A foreachBatch function that keeps the latest row of each key under ``path``. A batch rewrites the buckets that its keys fall in; readers take the last
    complete version with current(); a replayed batch gives the same state."""

    def merge(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = latest(batch, keys, order)
        return rows if before is None else latest(before.select(*rows.columns).unionByName(rows), keys, order)

    return _sink(BucketTable(spark, path, keys, buckets), merge)


def _sink(table: BucketTable, merge):
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # it is read for its buckets and for its rows; a stateful query is not run twice
        try:
            table.apply(number, batch, merge)
        finally:
            batch.unpersist()

    return write


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The rows of the last complete version (below a number), or None."""
    return BucketTable(spark, path, []).read(before)


def run_available(stream: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Processes what is there, in batches, and ends; the query that has ended."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def new_files(spark: SparkSession, path: str, delay: str = "7 days") -> DataFrame:
    """A stream of files as they arrive, each path once within the delay; the checkpoint remembers what was read."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path"])
