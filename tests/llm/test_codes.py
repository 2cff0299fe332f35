"""Vector codes against plain Python."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, _key int"


def plain(rows, entries=256, rounds=4):
    """The contract row by row, in whole numbers of any size."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    whole = lambda x: int(x) * 1024 if abs(x) >= 2**42 else math.floor(1024 * x)
    kept = sorted(((i, [whole(x) for x in v] + [0] * (width - len(v)), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = width // 4
    books = [[v[p * m : (p + 1) * m] for _, v, _ in kept[:entries]] for p in range(4)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(4):
            own = [[] for _ in books[p]]
            for _, v, _ in kept:
                own[nearest(p, v[p * m : (p + 1) * m])[1]].append(v[p * m : (p + 1) * m])
            new.append([[sum(c) // len(x) for c in zip(*x, strict=True)] if x else e for x, e in zip(own, books[p], strict=True)])
        books = new
    coded = []
    for i, v, lab in kept:
        found = [nearest(p, v[p * m : (p + 1) * m]) for p in range(4)]
        coded.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for *_, e, lab in coded:
        sums[lab] = sums.get(lab, 0) + e
    fits = lambda e: e if e < 2**63 else None
    bad = {lab for *_, e, lab in coded if e >= 2**63}
    return [(i, c, fits(e), None if lab in bad else fits(sums[lab]), digest) for i, c, e, lab in coded]


def found(spark, rows, tmp):
    spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    return [tuple(r) for r in V.op13_vector_codes(spark, str(tmp)).collect()]


def in_order(rows):
    return sorted(rows, key=str)


def test_codes_against_plain(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(8)], rng.choice([None, 0, 1])) for i in range(400)]
    rows += [(7, [0.5] * 8, 1)] * 40 + [(1000 + i, rows[5][1], 0) for i in range(60)]  # repeated rows and copies
    rows += [(2000, None, 1), (2001, [None] + [0.0] * 7, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] * 8, 0), (None, [-0.0004] * 8, None), (2004, [-0.0] * 8, 2)]
    assert in_order(found(spark, rows, tmp_path)) == in_order(plain(rows))


def test_few_short_and_huge_vectors(spark, tmp_path):
    few = [(3, [0.1, -0.1, 0.25, 1.0, 5.0], 1), (1, [2.0], None), (2, [], None), (2, [0.1], 4)]
    assert in_order(found(spark, few, tmp_path)) == in_order(plain(few))
    huge = [(i, [x, -x, x / 3, 1.0], i % 2) for i, x in enumerate([1e30, 3e38, -7e20, 1e306, 0.5, 1e6])] + [(9, [1e7] * 4, 5), (10, [4e8] * 4, 5)]
    assert in_order(found(spark, huge, tmp_path)) == in_order(plain(huge))
    assert found(spark, [(1, None, 1)], tmp_path) == [] and found(spark, [], tmp_path) == []
    assert found(spark, [(1, [], 1)], tmp_path) == [(1, "00000000", 0, 0, hashlib.sha256(b"").hexdigest())]


def test_walk_finds_the_nearest_of_all_entries(monkeypatch):
    """Few and many values a dimension, so that prefixes are shared and subtrees are split; ties go to the lower index."""
    monkeypatch.setattr(V, "LEAVES", 8)
    rng = np.random.default_rng(4)
    for values, kind in ((2, np.int32), (5, np.int64), (400, np.int32), (3, object)):
        x = np.unique(rng.integers(0, values, (300, 5)), axis=0).astype(kind)
        e = rng.integers(0, values, (20, 5)).astype(kind)
        far = ((x[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
        code, distance = V.walk(x, e)
        assert code.tolist() == [int(np.argmin(r)) for r in far] and distance.tolist() == far.min(axis=1).tolist()


def test_other_sizes(spark):
    rows = spark.range(50).select(F.col("id").alias("k"), F.array(*(F.sin(F.col("id") * (j + 1)) for j in range(12))).alias("v"), F.lit(1).alias("l"))
    coded, books = V.compress(rows, "k", "v", "l", entries=16, rounds=2)
    want = plain([(r["k"], r["v"], 1) for r in rows.collect()], entries=16, rounds=2)
    assert in_order((r["_key"], r["code"], r["error"]) for r in coded.collect()) == in_order(w[:3] for w in want)
    assert [len(b) for b in books] == [16] * 4
