"""Session and shared-folder helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "ledgerloom", cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the session is the caller's."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only where both are unset and the session is local, as in tests, a temporary folder becomes the context's checkpoint folder.
    """
    context = spark.sparkContext
    found, own = spark.conf.get("spark.checkpoint.dir", None), context._jsc.sc().getCheckpointDir()
    if found:
        if own.isEmpty():
            context.setCheckpointDir(found)
        return found
    if own.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        own = context._jsc.sc().getCheckpointDir()
    return own.get()


#: Of Python workers: memory of large arrays and of Arrow batches goes back to the system when it is freed, and few heaps are kept.
LEAN = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def lean_workers(spark: SparkSession) -> None:
    """Workers live as long as their executor, so what one stage has freed counts in all later ones if it is kept; settings of the caller's stay."""
    for name, value in LEAN.items():
        spark.sparkContext.environment.setdefault(name, value)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches of whole texts; a smaller setting of the caller's stays."""
    lean_workers(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch for what runs inside the block; the caller's setting comes back after it."""
    lean_workers(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing else writes there."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    return _table(df, scratch_path(df.sparkSession, name))


def _table(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that go when the block ends; what is read after it must not need them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        table = _table(df, path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, table: DataFrame) -> None:
        """Deletes one of the tables early."""
        _, path = self.paths.pop(id(table))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, table: DataFrame) -> DataFrame:
        """The table, which no longer goes with the others."""
        self.paths.pop(id(table))
        return table

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table, _ in list(self.paths.values()):
            self.drop(table)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
