"""Histories and current states: latest rows, upserts, replacements, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str], where: Column | None = None) -> DataFrame:
    """The row with the largest ``order`` of each key; combines on the map side, without a sort."""
    kept = rows if where is None else rows.where(where)
    others = [c for c in rows.columns if c not in keys]
    return kept.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def latest_or_any(rows: DataFrame, keys: list[str], order: list[str], ok: str, others: DataFrame | None = None, there: str = "_there") -> DataFrame:
    """The latest row that is ok, else the latest of any kind, with ``fallback``; one aggregation. With ``others``, rows of keys, a column tells whether
    the key is among them, from the same aggregation; keys that only these have give no row."""
    held, good = F.struct(*[c for c in rows.columns if c not in keys]), F.struct(F.coalesce(F.col(ok), F.lit(False)).alias("_ok"), *order)
    if others is None:
        best = rows.groupBy(*keys).agg(F.max_by(held, good).alias("_row"))
    else:
        both = rows.select(*keys, held.alias("_held"), good.alias("_good"), F.lit(False).alias(there)).unionByName(others.select(*keys, F.lit(True).alias(there)), allowMissingColumns=True)
        best = both.groupBy(*keys).agg(F.max_by("_held", "_good").alias("_row"), F.max(there).alias(there)).where("_row is not null")
    return best.select(*keys, "_row.*", *([] if others is None else [there])).withColumn("fallback", ~F.coalesce(F.col(ok), F.lit(False)))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The current rows with those of the same key replaced by the changes, and new ones added; null keys are keys."""
    new = changes.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
    return current.join(new, same, "left_anti").unionByName(changes)


def replace_children(children: DataFrame, new: DataFrame, parent: str, touched: DataFrame) -> DataFrame:
    """All children of the touched parents are replaced."""
    return children.join(touched.select(parent).distinct(), parent, "left_anti").unionByName(new)


def delete_not_ok(current: DataFrame, last: DataFrame, key: str, ok: str) -> DataFrame:
    """Current rows go where the key's last run wasn't ok."""
    return current.join(last.where(~F.coalesce(F.col(ok), F.lit(False))).select(key), key, "left_anti")


def update_if_ok(current: DataFrame, changes: DataFrame, key: str, ok: str) -> DataFrame:
    """Current rows take the values of an ok change of their key, where it has them; changes that are not ok, or of unknown keys, do nothing."""
    columns = [c for c in current.columns if c != key]
    new = changes.where(F.coalesce(F.col(ok), F.lit(False))).select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return current.join(new, key, "left").select(key, *(F.coalesce(f"_new_{c}", c).alias(c) for c in columns))


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after rows were deleted. ``gone`` has the deleted keys of first tables; a link (parent, its key, child, its foreign key, rule) says
    what happens to children, in order: CASCADE deletes them, SET NULL empties the foreign key, RESTRICT keeps parents that have children.
    A child's own deleted keys go on to later links from it, under the key that the link names."""
    tables, gone = dict(tables), dict(gone)
    for parent, key, child, foreign, rule in links:
        if rule == "RESTRICT" and parent in gone:
            gone[parent] = gone[parent].join(tables[child].select(F.col(foreign).alias(key)), key, "left_anti")
    for table, keys in gone.items():
        tables[table] = tables[table].join(keys, keys.columns, "left_anti")
    for parent, key, child, foreign, rule in links:
        if parent not in gone:
            continue
        lost = gone[parent].select(F.col(key).alias(foreign)).distinct()
        if rule == "CASCADE":
            gone[child] = tables[child].join(lost, foreign, "left_semi")
            tables[child] = tables[child].join(lost, foreign, "left_anti")
        elif rule == "SET NULL":
            marked = tables[child].join(lost.withColumn("_lost", F.lit(True)), foreign, "left")
            tables[child] = marked.withColumn(foreign, F.when(F.col("_lost").isNull(), F.col(foreign))).select(*tables[child].columns)
    return tables


def restricted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of a given set of ids; Spark broadcasts the ids where they are few."""
    return rows.join(ids.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children with a key that no parent has."""
    return children.where(F.col(key).isNotNull()).join(parents.select(key), key, "left_anti")


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row per violated rule: key and ``rule``; a rule that is NULL isn't violated."""
    broken = F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def get_or_create(names: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """Known names with their keys and new names with a hash as key, so no global numbering is needed."""
    new = names.select(name).where(F.col(name).isNotNull()).distinct().join(known, name, "left_anti")
    return known.select(key, name).unionByName(new.select(F.xxhash64(name).alias(key), name))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
