"""Results that were once cut, against brute force."""

import math

import numpy as np

from ledgerloom.llm import text_search, toxicity


def test_search_from_outside(spark):
    """A term of one document counts; rows of one query id are one query; equal documents are all found."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (2, "gamma delta"), (None, "gamma"), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(9, "gamma"), (9, "gamma"), (8, "alpha"), (7, None), (6, "zeta")], "doc_id long, text string")
    found = text_search.search(docs, queries).orderBy("query_id", "rank").collect()
    n, mean, length = 5, 6 / 5, 2
    score = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / mean))
    assert [(r["query_id"], r["doc_id"], round(r["score"], 6)) for r in found] == [(8, 1, round(score(1), 6)), (9, 2, round(score(2), 6)), (9, 2, round(score(2), 6))]


def test_search_finds_what_only_weak_terms_share(spark, monkeypatch):
    monkeypatch.setattr(text_search, "SHARD", 7)
    monkeypatch.setattr(text_search, "MOST_TERMS", 20)
    monkeypatch.setattr(text_search, "LEVELS", (1, 2, 4))
    telling = " ".join(f"t{i} t{i}" for i in range(16))
    rows = [(0, f"{telling} weak"), (1, telling), (2, "weak"), *((10 + i, f"weak filler{i}") for i in range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [r["doc_id"] for r in text_search.search(docs, docs.where("doc_id = 0"), k=30).orderBy("rank").collect()]
    assert found[:2] == [1, 2] and set(found) == {i for i, _ in rows} - {0}
    cut = text_search.search(docs, docs.where("doc_id = 0"), terms=16, k=30).collect()
    assert [r["doc_id"] for r in cut] == [1]


def test_a_long_text_leaves_its_class(spark):
    rows = [(i, "vile awful hateful words " * (2_000 if i == 1 else 4) if i % 2 else f"kind calm friendly words {i} " * 4) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (0, 0), (2, 0)], "doc_id long, toxic int")
    contents, _ = toxicity.learn(docs, labels, "toxic", lambda key: key.isNotNull(), "doc_id", "text")
    assert contents is not None


def test_common_terms_change_no_result(monkeypatch):
    """A shard with a matrix of common terms, in any order of places, finds what the sum of all impacts finds."""
    monkeypatch.setattr(text_search, "BLOCK", 4)
    rng = np.random.default_rng(3)
    for n in (1, 5, 90):
        held = rng.random((n, 30)) < np.linspace(0.02, 0.9, 30)
        row, term = np.nonzero(held)
        tf, impact, doc = rng.integers(1, 5, len(row)), np.round(rng.random(len(row)), 1), rng.permutation(n) * 3
        common = text_search.common_terms(term, n, 30)
        assert n < 90 or 5 < len(common) < 30
        order = text_search.placed(doc, row, term, tf, common, 30)
        assert sorted(order) == list(range(n))
        rank = np.argsort(order)
        shard = text_search.Shard(doc[order], rank[row], term, impact, 30, common)
        group = [np.flatnonzero(rng.random(30) < 0.4) for _ in range(20)]
        for asked, share, most in zip(group, *shard.shares(group), strict=True):
            total = np.zeros(n)
            np.add.at(total, row[np.isin(term, asked)], impact[np.isin(term, asked)])
            want = sorted((-round(s, 9), d) for s, d in zip(total.tolist(), doc.tolist(), strict=True) if s > 0 and d != 6)[:7]
            scores, ids = shard.best(asked, share, most, 7, 6, *text_search.NONE)
            assert [(-round(s, 9), d) for s, d in zip(scores.tolist(), ids.tolist(), strict=True)] == want
            floor = -want[len(want) // 2][0] if want else 0.0
            scores, ids = shard.best(asked, share, most, 7, 6, *text_search.NONE, floor)
            over = [(s, d) for s, d in want if -s >= floor]
            assert [(-round(s, 9), d) for s, d in zip(scores.tolist(), ids.tolist(), strict=True)][: len(over)] == over
