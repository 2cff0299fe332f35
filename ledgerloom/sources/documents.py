"""Readers of files and JSON documents, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import clean_file_name
from ledgerloom.operators.history import upsert
from ledgerloom.streaming.buckets import BucketTable

#: Formats by mime type and by extension.
BY_MIME = {"image/jpeg": "JPG", "image/png": "PNG", "application/pdf": "PDF"}
BY_EXTENSION = {"jpg": "JPG", "jpeg": "JPG", "png": "PNG", "pdf": "PDF"}


#: Mime types by extension.
MIME_BY_EXTENSION = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "pdf": "application/pdf"}


def _known(table: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files as path, size and bytes, with name, extension and the mime type that the extension suggests. Spark's reader leaves out files without bytes."""
    raw = spark.read.format("binaryFile").load(path)
    name = clean_file_name(F.col("path"))["nombre"]
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return raw.withColumns({"nombre": name, "extension": extension, "mime": _known(MIME_BY_EXTENSION, extension)})


def register(rows: DataFrame, path: str = "path", size: str = "length", mime: str = "mime") -> DataFrame:
    """Files to ingest as register rows: ``nombre``, ``tamano``, ``formato``, ``estado`` and ``avisos``; a file that cannot be taken in stays, as FALLO_INGESTA with its ``error``."""
    name, kind = clean_file_name(F.col(path)), file_format(clean_file_name(F.col(path))["nombre"], F.col(mime))
    error = F.when(F.coalesce(F.col(size), F.lit(0)) == 0, "ARCHIVO_VACIO").when(kind["formato"].isNull(), "FORMATO_NO_SOPORTADO")
    return rows.select(
        path, name["nombre"].alias("nombre"), F.col(size).cast("long").alias("tamano"), kind["formato"].alias("formato"),
        F.when(error.isNull(), "INGESTADO").otherwise("FALLO_INGESTA").alias("estado"), error.alias("error"),
        F.filter(F.array(name["aviso"], kind["aviso"]), lambda x: x.isNotNull()).alias("avisos"),
    )


def with_events(current: DataFrame, events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Current states after status events: the last event of a document sets state, warnings and error where it has them; events of unknown documents do nothing."""
    columns = [c for c in current.columns if c != key]
    held = [c for c in columns if c in events.columns]
    last = events.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_new_{c}") for c in held))
    return current.join(last, key, "left").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) if c in held else F.col(c) for c in columns))


def document_json(doc: Column) -> Column:
    """A document as JSON with decimals as text; letters beyond ASCII stay as they are, NULL fields are left out."""
    return F.to_json(doc, {"ignoreNullFields": "true"})


def write_json(rows: DataFrame, doc: str, path: str) -> None:
    """One JSON text a line."""
    rows.select(document_json(F.col(doc)).alias("value")).write.text(path)


def export_metrics(rows: DataFrame, path: str, stamp: str, order: list[str]) -> str:
    """A metrics table, which is a few rows a series, as one CSV file with a header in a folder of its own; returns the folder."""
    at = f"{path.rstrip('/')}/metricas_{stamp}"
    rows.orderBy(*order).coalesce(1).write.option("header", True).csv(at)
    return at


def publish_layer(spark: SparkSession, tables: dict[str, DataFrame], path: str, by: dict[str, str]) -> None:
    """Tables for dashboards: Parquet, partitioned where ``by`` names a column, each also a temporary view of its name."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(by[name]) if name in by else writer).parquet(f"{path}/{name}")
        spark.read.parquet(f"{path}/{name}").createOrReplaceTempView(name)


def file_format(name: Column, mime: Column) -> Column:
    """struct<formato, aviso>: by mime type, else by extension; NULL is not supported."""
    by_mime, by_name = _known(BY_MIME, F.lower(mime)), _known(BY_EXTENSION, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))
    warning = F.when(by_mime.isNull() & by_name.isNotNull(), "usando_extension").when(by_mime != by_name, "mime_y_extension_distintos")
    return F.struct(F.coalesce(by_mime, by_name).alias("formato"), warning.alias("aviso"))


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files with one object or a list of them; unreadable ones keep their text in ``_corrupt``."""
    kept = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(kept).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def append_history(rows: DataFrame, path: str, day: str) -> None:
    """Appends to a history that is partitioned by day."""
    rows.withColumn("dia", F.to_date(day)).write.mode("append").partitionBy("dia").parquet(path)


def upsert_table(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> int:
    """Upserts rows into the table at a path: rows of their keys are replaced, others stay, and only the buckets of their keys are rewritten. A
    version counts when its record is written, so readers see all of an upsert or nothing, and the same upsert again changes nothing. Returns the buckets written.

    Null keys are keys; a key that the rows hold twice is an error. There is one writer at a time.
    """
    rows = rows.persist()
    try:
        if rows.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"rows of one upsert must differ in {keys}")
        table = BucketTable(rows.sparkSession, path, keys, buckets)
        number = (table.versions() or [-1])[-1] + 1
        return table.apply(number, rows, lambda before, new: new if before is None else upsert(before.select(*new.columns), new, keys))
    finally:
        rows.unpersist()


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table of upsert_table(); None before the first."""
    return BucketTable(spark, path, []).read()


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, options: dict[str, str] | None = None) -> DataFrame:
    """A SQL query's result. With a column of whole numbers (quoted as the database wants it) it is read in that many parts at once, and in one more
    for null keys; without bounds one query asks for the least and the largest number. Rows beyond given bounds are in the first and the last part.
    """
    given = {"url": url, "driver": "", **(options or {})}
    given = {k: v for k, v in given.items() if v}
    if not column:
        return spark.read.format("jdbc").options(**given).option("query", query).load()
    if bounds is None:
        found = spark.read.format("jdbc").options(**given).option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM ({query}) q").load().first()
        bounds = (int(found[0]), int(found[1])) if found[0] is not None else (0, 0)
    low, high = bounds
    n = max(1, min(parts, high - low + 1))
    cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
    ranges = [" AND ".join(filter(None, (f"{column} >= {a}" if a is not None else "", f"{column} < {b}" if b is not None else ""))) or f"{column} IS NOT NULL" for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
    properties = {k: v for k, v in given.items() if k != "url"}
    return spark.read.jdbc(url, f"({query}) q", predicates=[*ranges, f"{column} IS NULL"], properties=properties)
