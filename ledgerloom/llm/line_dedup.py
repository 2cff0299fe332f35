"""Line dedup by site-relative frequency. DataFrame functions only.

A line is boilerplate of a host when the share of the host's pages that hold it is above
``max_ratio`` and at least ``min_pages`` pages hold it. Boilerplate lines are dropped from every
page of that host; all other lines stay, in order.

Defined results: a null text stays null (no lines); blank lines are never boilerplate; a line that a
page repeats counts once for the page, and every repeat is dropped; pages with a null host form a
host of their own; repeated rows are pages of their own; a page of many lines takes time in proportion to them; other columns stay, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import shared_dir

MAX_RATIO = 0.1
MIN_PAGES = 5
#: More boilerplate lines than this are joined by shuffle (and split where a host is hot), fewer are broadcast.
BROADCAST_ROWS = 100_000


def _line_key(line: Column) -> Column:
    """128 bits of a line: two hashes with different seeds."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per host with boilerplate: ``_host``, ``_n``, the number of its boilerplate lines, and ``_table``: as many slots as lines, each an array of the
    keys whose hash falls in it, so that a line is looked up in one slot.

    A host has at most (distinct lines a page) / max_ratio such lines, so the arrays are small
    whatever the host's size. Counting combines on the map side; the key of the shuffle has the line
    in it, so a hot host spreads over all tasks.
    """
    own = pages.select(F.col(f"`{host}`").alias("_host"), F.col(f"`{text}`").alias("_text"))
    totals = own.groupBy("_host").agg(F.count("*").alias("_pages"))
    held = F.transform(F.filter(F.array_distinct(_lines(F.col("_text"))), lambda x: F.trim(x) != ""), _line_key)
    counts = own.select("_host", F.explode(held).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_with")).where(F.col("_with") >= min_pages)
    found = (
        counts.join(totals, counts["_host"].eqNullSafe(totals["_host"]))
        .where(F.col("_with") / F.col("_pages") > max_ratio)
        .groupBy(counts["_host"])
        .agg(F.collect_list("_line").alias("_lines"))
        .withColumn("_n", F.size("_lines"))
    )
    none = F.lit(None).cast("struct<a: bigint, b: bigint>")
    slots = F.concat(F.transform("_lines", lambda x: F.struct(_slot(x, F.col("_n")).alias("slot"), x.alias("line"))), F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.struct(i.alias("slot"), none.alias("line"))))
    each = found.select("_host", "_n", F.inline(slots)).groupBy("_host", "_n", "slot").agg(F.collect_list("line").alias("keys"))
    table = F.transform(F.array_sort(F.collect_list(F.struct("slot", "keys"))), lambda s: s["keys"])
    return each.groupBy("_host", "_n").agg(table.alias("_table"))


def _slot(key: Column, n: Column) -> Column:
    return F.pmod(key["a"], n).cast("int")


def _known(line: Column, table: Column) -> Column:
    key = _line_key(line)
    return F.array_contains(F.element_at(table, _slot(key, F.size(table)) + 1), key)


def drop_boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, report: bool = False) -> DataFrame:
    """The pages with their boilerplate lines dropped; same columns, plus with ``report`` ``n_lines`` and ``n_dropped``."""
    shared_dir(pages.sparkSession)
    found = boilerplate(pages, host, text, max_ratio, min_pages).checkpoint()
    lines = found.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    small = F.broadcast(found) if lines <= BROADCAST_ROWS else found
    p = pages.alias("p")
    joined = p.join(small.alias("b"), F.col(f"p.`{host}`").eqNullSafe(F.col("b._host")), "left")
    all_lines = _lines(F.col(f"p.`{text}`"))
    kept = F.when(F.col("b._n").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~_known(x, F.col("b._table"))))
    columns = [F.when(F.col("b._n").isNull(), F.col(f"p.`{c}`")).otherwise(F.array_join(kept, "\n")).alias(c) if c == text else F.col(f"p.`{c}`") for c in pages.columns]
    if report:
        size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
        n = F.when(F.col(f"p.`{text}`").isNull(), F.lit(0).cast("long"))
        columns += [n.otherwise(size(all_lines)).alias("n_lines"), n.otherwise(size(all_lines) - size(kept)).alias("n_dropped")]
    return joined.select(*columns)


def op8_line_dedup(spark, sf_dir):
    """Every document with its source as host: ids, line counts and the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_boilerplate(docs, "source", "text", report=True).select("doc_id", "source", "n_lines", "n_dropped", "text")


SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
held AS (SELECT source, unnest(list_distinct(ls)) AS line FROM pages),
counts AS (SELECT source, line, count(*) AS n FROM held WHERE trim(line) <> '' GROUP BY source, line HAVING count(*) >= {MIN_PAGES}),
bad AS (SELECT c.source, list(c.line) AS bs FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n / t.n > {MAX_RATIO} GROUP BY c.source),
kept AS (SELECT p.doc_id, p.source, p.ls, CASE WHEN b.bs IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(b.bs, x)) END AS ks
         FROM pages p LEFT JOIN bad b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(len(ls) - len(ks), 0) AS BIGINT) AS n_dropped,
       array_to_string(ks, chr(10)) AS text FROM kept
"""
