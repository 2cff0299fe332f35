"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus. Its mean repetition rate is
share x budget / size, where size is the characters it has and the budget is ``epochs`` times the
characters of all pools. A document's number of copies is a Poisson draw at that mean: the
distribution function is inverted at a uniform number that comes from a hash of seed and document
key, so a lost task draws the same numbers again. Copies are dealt over all tasks by a hash of their
own and sorted by it, which is a global shuffle without a sampling pass.

Sources without a weight share the pool ``other``, so there are no more pools than weights plus one.
A mean above MAX_PART is the sum of several smaller independent draws (exp(-mean) would vanish).

Defined results: a null source is in ``other``; a null text has size 0; a pool of size 0 has rate 0; a pool with
weight 0 has no copies; rows of a null key, and rows of a key that several have, draw by a hash of the whole row, and
equal ones by their number among these, so all draw apart; texts of any length are copied whole; other columns stay, whatever their names; an empty table gives
an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import written

OTHER = "other"
SEED = 17
MAX_PART = 256.0
#: Equal rows that are numbered in one piece.
PIECE = 1_000
#: The mixture that op1 and the pipeline aim at: shares in proportion to these.
WEIGHTS = {"src0": 4.0} | {f"src{i}": 1.0 for i in range(1, 20)} | {OTHER: 1.0}


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source: str, text: str, weights: dict[str, float], epochs: float = 1.0) -> DataFrame:
    """One row per pool: ``_pool``, ``_rate``, the number of draws ``_parts`` and the distribution function ``_cdf`` of one draw."""
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite, not negative and not all 0")
    total_weight = sum(weights.values())
    share = F.lit(0.0)
    for name, w in weights.items():
        share = F.when(F.col("_pool") == name, F.lit(w / total_weight)).otherwise(share)
    sizes = docs.select(pool(F.col(source), weights).alias("_pool"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n")).groupBy("_pool").agg(F.sum("_n").alias("_size"))
    all_sizes = sizes.agg(F.sum("_size").alias("_total"), F.collect_list(F.struct("_pool", "_size")).alias("_each"))
    rate = F.when(F.col("_size") > 0, share * F.col("_total") * F.lit(float(epochs)) / F.col("_size")).otherwise(F.lit(0.0))
    mean = F.col("_mean")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + acc["p"] * mean / k).alias("c"))
    return (
        all_sizes.select("_total", F.inline("_each"))
        .select("_pool", rate.alias("_rate"))
        .withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MAX_PART)).cast("int"))
        .withColumn("_mean", F.col("_rate") / F.col("_parts"))
        .withColumn("_cdf", F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["c"]))
        .drop("_mean")
    )


def pool(source: Column, weights: dict[str, float]) -> Column:
    return F.when(source.isin(*weights), source).otherwise(F.lit(OTHER))


def named(docs: DataFrame, key: str) -> DataFrame:
    """The columns as ``_c0``, ``_c1`` and so on, and ``_name``, by which a row draws: the key where it is the row's alone, else a hash of the row and a number among equal rows."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)), F.col(f"`{key}`").cast("string").alias("_key"))
    repeated = rows.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_rows")).where("_rows > 1").select(F.col("_key").alias("_again"))
    repeated = written(repeated, "mixing-repeated")  # keys alone
    own, none = rows.where("_key is not null"), rows.where("_key is null")
    if repeated.limit(1).count():
        again = F.col("_key") == F.col("_again")
        none = none.unionByName(own.join(repeated, again, "left_semi"))
        own = own.join(repeated, again, "left_anti")
    return own.withColumnRenamed("_key", "_name").unionByName(_numbered(none))


def _numbered(rows: DataFrame) -> DataFrame:
    """Equal rows are counted before the shuffle and dealt out again in pieces of PIECE, so no task has all of a hot row."""
    columns = [c for c in rows.columns if c != "_key"]
    said = F.to_json(F.struct(*columns))
    counted = rows.groupBy("_key", F.xxhash64(said).alias("_a"), F.xxhash64(F.lit(7), said).alias("_b")).agg(*(F.any_value(c).alias(c) for c in columns), F.count("*").alias("_n"))
    pieces = counted.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / PIECE)))).repartition("_a", "_b", "_piece")
    each = pieces.withColumn("_i", F.explode(F.sequence(F.col("_piece") * PIECE + 1, F.least("_n", (F.col("_piece") + 1) * PIECE))))
    return each.select(*columns, F.concat_ws("|", F.coalesce("_key", F.lit("")), F.hex("_a"), F.hex("_b"), "_i").alias("_name"))


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = SEED, report: bool = False) -> DataFrame:
    """The mixed corpus in random order; same columns, plus with ``report`` ``copy`` (from 1), ``n_copies`` and ``shuffle_key``."""
    weights = weights or WEIGHTS
    found = rates(docs, source, text, weights, epochs)  # len(weights) + 1 rows at most, so it is broadcast
    at = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    d = named(docs, key).withColumn("_pool", pool(F.col(at[source]), weights))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: F.size(F.filter(F.col("_cdf"), lambda c: c <= F.element_at(F.col("_u"), j))))
    drawn = (
        d.join(F.broadcast(found), "_pool")
        .withColumn("_u", F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: unit_hash(F.lit(seed), F.col("_name"), j)))
        .withColumn("_n", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
        .where("_n > 0 and _rate > 0")
        .select(*at.values(), "_name", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
        .withColumn("_key", F.md5(F.concat_ws(":", F.lit("shuffle"), F.lit(seed), F.col("_name"), F.col("_copy"))))
    )
    shuffled = drawn.repartition(F.col("_key")).sortWithinPartitions("_key")
    extra = [F.col("_copy").alias("copy"), F.col("_n").alias("n_copies"), F.col("_key").alias("shuffle_key")] if report else []
    return shuffled.select(*(F.col(a).alias(c) for c, a in at.items()), *extra)


def op1_mix_sources(spark, sf_dir):
    """The mixed corpus of ``documents``: every copy as a row, whole."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, report=True).select("doc_id", "source", "lang", "copy", "n_copies", "shuffle_key", "text")


_CASE = " ".join(f"WHEN '{k}' THEN {w / sum(WEIGHTS.values())!r}" for k, w in WEIGHTS.items())
_NAMES = ", ".join(f"'{k}'" for k in WEIGHTS)
SQL = f"""
WITH d AS (SELECT *, CASE WHEN source IN ({_NAMES}) THEN source ELSE '{OTHER}' END AS pool FROM documents),
sizes AS (SELECT pool, sum(coalesce(length(text), 0)) AS size FROM d GROUP BY pool),
rate AS (SELECT pool, CASE WHEN size > 0 THEN (CASE pool {_CASE} ELSE 0.0 END) * (SELECT sum(size) FROM sizes)::DOUBLE / size::DOUBLE ELSE 0.0 END AS rate FROM sizes),
terms AS (SELECT pool, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rate, range(0, 200) r(k) WHERE rate > 0),
cdf AS (SELECT pool, list(c ORDER BY k) AS cs FROM (SELECT pool, k, sum(p) OVER (PARTITION BY pool ORDER BY k) AS c FROM terms) GROUP BY pool),
u AS (SELECT d.doc_id, d.source, d.lang, d.text, cs,
      ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM d JOIN cdf USING (pool)),
n AS (SELECT *, CAST(len(list_filter(cs, lambda c: c <= u)) AS INTEGER) AS n_copies FROM u),
copies AS (SELECT *, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy FROM n WHERE n_copies > 0)
SELECT doc_id, source, lang, copy, n_copies, md5('shuffle:{SEED}:' || doc_id || ':' || copy) AS shuffle_key, text FROM copies
"""
