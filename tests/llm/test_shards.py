"""A class that every task holds has its neighbours in parts of a bounded size."""

import random

from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join as J
from ledgerloom.session import Scratch


def test_neighbours_of_a_hot_class_are_cut(spark, monkeypatch):
    """One class in each of many tasks, 200 near copies each: without a cut all would be one group."""
    monkeypatch.setattr(J, "NEIGHBOURS", 100)
    pairs = spark.range(8000).select(F.lit(1).cast("long").alias("rep"), F.col("id").alias("x")).union(spark.range(50).select((F.col("id") + 10).alias("rep"), (F.col("id") * 3).alias("x"))).repartition(7)
    with Scratch(spark) as scratch:
        parts = J._near(pairs, scratch)
        sizes = [r["count"] for r in parts.groupBy("rep", "part").count().collect()]
        assert parts.count() == 8050 and max(sizes) < 200 and parts.where("rep <> 1 and part <> 0").count() == 0


def test_groups_stay_bounded_and_the_result_exact(spark, monkeypatch):
    monkeypatch.setattr(J, "NEIGHBOURS", 20)
    monkeypatch.setattr(J, "SHARD", 60)
    rng, base = random.Random(8), [f"w{i}" for i in range(200)]
    texts = []
    for task in range(12):
        texts.append(base)
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(200)] = f"c{rng.randrange(10**6)}"
            texts.append(copy)
    seen = []
    real = J._within
    monkeypatch.setattr(J, "_within", lambda n, num, den: seen.append(1) or real(n, num, den))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(12)
    rows = J.join_documents(docs, num=90).collect()
    assert seen and {r["component_id"] for r in rows} == {0} and len(rows) == len(texts)
