"""Null and repeated keys, repeated rows, long pages, lost writers: what once gave wrong or slow results."""

import random
import time
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import line_dedup, mixing, token_rollup, vector_search
from ledgerloom.session import scratch_path


# op5


def nearest_ids(rows, k=5):
    """{query: [(id, score)]} over all rows by id: the best of their vectors."""
    usable = [(i, np.asarray(v, dtype=float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in {i for i, _ in usable if i % 20 == 0}:
        best = defaultdict(lambda: -9.0)
        for qi, qv in usable:
            if qi == q:
                for i, v in usable:
                    if i != q and len(v) == len(qv):
                        best[i] = max(best[i], float(qv @ v / np.sqrt(qv @ qv) / np.sqrt(v @ v)))
        if best:
            out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def found(spark, rows, parts=3):
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    got = defaultdict(list)
    for r in vector_search.search(t, t.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


@pytest.mark.parametrize("own", [1, 2, 8])
def test_rows_of_a_query_that_repeat(spark, own):
    rng = np.random.default_rng(own)
    x = np.round(rng.standard_normal((120, 8)), 3)
    rows = [(i, x[i].tolist()) for i in range(120) for _ in range(own if i == 40 else 1)] + [(44, x[44].tolist())] * 6 + [(4, x[5].tolist()), (40, x[9].tolist()), (60, x[61].tolist())]
    got, want = found(spark, rows), nearest_ids(rows)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert len({v for v, _ in got[q]}) == 5 and q not in dict(got[q])
        for v, score in got[q]:
            assert score == pytest.approx(dict(near).get(v, score), abs=1e-12)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_ties_and_lengths_and_few(spark):
    """Equal vectors by id; lengths apart; fewer candidates than k; vectors that take no part."""
    rows = [(i, [1.0, 0.0, 2.0]) for i in (20, 7, 3, 9, 1, 5, 30)] + [(40, [1.0, 2.0]), (41, [2.0, 4.0]), (42, [0.0, 1.0]), (60, [5.0]), (80, None), (100, [0.0] * 3), (120, [float("inf")] * 3), (None, [1.0] * 3)]
    got = found(spark, rows)
    assert [v for v, _ in got[20]] == [1, 3, 5, 7, 9] and [v for v, _ in got[40]] == [41, 42] and got.keys() == {20, 40}
    assert got[40][0][1] == pytest.approx(1.0) and found(spark, [(20, [1.0])]) == {}


# op7


def rollup_of(spark):
    return token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"))


def batch(spark, n=3):
    return token_rollup.inserts(spark.createDataFrame([("a", "en", "v", n)], "source string, lang string, version string, n_tokens long"))


def figures(rollup):
    return [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()]


def lose(spark, rollup, name):
    """The record of a batch as a lost driver leaves it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{rollup.path}/commits/{name}/_SUCCESS")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)


def test_a_lost_record_is_not_counted(spark):
    rollup = rollup_of(spark)
    rollup.commit("one", batch(spark))
    lose(spark, rollup, "one")
    assert figures(rollup) == []
    rollup.compact()
    assert figures(rollup) == []
    assert rollup.commit("one", batch(spark)) and figures(rollup) == [(1, 3)]
    rollup.compact()
    assert not rollup.commit("one", batch(spark)) and figures(rollup) == [(1, 3)]


def test_a_batch_in_a_snapshot_counts_once(spark):
    """The record is lost after the snapshot and written again by a replay."""
    rollup = rollup_of(spark)
    rollup.commit("one", batch(spark))
    rollup.compact()
    lose(spark, rollup, "one")
    assert rollup.commit("one", batch(spark)) and figures(rollup) == [(1, 3)]
    rollup.compact()
    assert figures(rollup) == [(1, 3)]


def test_commits_beside_a_snapshot(spark, monkeypatch):
    """A batch that is committed while a snapshot is written is in neither of its tables, and counts once."""
    rollup = rollup_of(spark)
    rollup.commit("one", batch(spark))
    state = rollup._state

    def late():
        found = state()
        monkeypatch.setattr(rollup, "_state", state)
        rollup.commit("two", batch(spark, 10))
        return found

    monkeypatch.setattr(rollup, "_state", late)
    rollup.compact()
    assert figures(rollup) == [(2, 13)]
    rollup.compact()
    assert figures(rollup) == [(2, 13)]


def test_totals_of_two_tokenizers_against_the_libraries(spark, sf):
    """What op7 sums up, document by document."""
    library, pieces = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    first, want = {}, defaultdict(lambda: [0, 0])
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang").orderBy("doc_id").collect()
    for r in rows:
        if r["text"] is None or first.setdefault(r["text"], r["doc_id"]) == r["doc_id"]:
            text = r["text"] or ""
            for version, n in (("word_bpe_49k", len(library.encode(text, add_special_tokens=False).ids) + 1), ("piece_bpe_32k", len(pieces.encode(text)))):
                total = want[r["source"], r["lang"], version]
                total[0], total[1] = total[0] + 1, total[1] + n
    got = {(r["source"], r["lang"], r["version"]): [r["n_docs"], r["n_tokens"]] for r in token_rollup.op7_token_counts(spark, sf).collect()}
    assert got == dict(want) and len(first) < len(rows)


# op1


def test_rows_without_a_key_of_their_own_draw_apart(spark):
    """One text 6,000 times without a key and 3,000 times with one key: copies near the wanted rate, dealt over all partitions."""
    rows = spark.range(12_000).select(F.when(F.col("id") < 6000, None).when(F.col("id") < 9000, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 9000, "same text").otherwise("some text").alias("text"), F.lit("src0").alias("source"), F.lit(1).alias("_key"), F.lit(2).alias("_n"))
    setting = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = mixing.mix(rows, weights={"src0": 1.0}, epochs=0.5)
        sizes = [len(p) for p in mixed.select("doc_id").rdd.glom().collect()]
        again = sorted(r["doc_id"] or 0 for r in mixing.mix(rows.repartition(3), weights={"src0": 1.0}, epochs=0.5).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", setting)
    assert mixed.columns == rows.columns and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert sorted(r["doc_id"] or 0 for r in mixed.collect()) == again
    for kept, of in ((sum(i == 0 for i in again), 6000), (sum(i == 7 for i in again), 3000), (len(again), 12_000)):
        assert abs(kept - of / 2) < 5 * (of / 2) ** 0.5


def test_weights_hold_with_repeated_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice(["a b c", "d e f", None]), rng.choice(["src0", "src1"])) for _ in range(8000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"src0": 3.0, "src1": 1.0}).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    size = {r["source"]: r["n"] for r in mixed}
    assert size["src0"] / sum(size.values()) == pytest.approx(0.75, abs=0.02)


# op8


def pages_of(spark, lines):
    return spark.range(8).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(lines)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n").alias("text")).repartition(4)


def test_time_is_in_proportion_to_lines(spark):
    def took(lines):
        began = time.time()
        assert line_dedup.drop_boilerplate(pages_of(spark, lines), "source", "text").where("text <> ''").count() == 0
        return time.time() - began

    took(1000)
    assert took(64_000) < 3 * took(16_000) + 20


def test_many_boilerplate_lines_against_plain(spark):
    rng = random.Random(5)
    common = [f"menu {i}" for i in range(40)]
    rows = []
    for i in range(60):
        host = rng.choice(["a", "b", None])
        rows.append((i, host, "\n".join(rng.choice([*common[: 20 if host == "a" else 40], f"own {i} {j}", "", " "]) for j in range(rng.randint(0, 60))) if i % 17 else None, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _n string").repartition(4)
    got = {r["doc_id"]: (r["text"], r["_n"]) for r in line_dedup.drop_boilerplate(docs, "source", "text").collect()}
    for i, host, text, _ in rows:
        mine = [set((t or "").split("\n")) for _, h, t, _ in rows if h == host]
        bad = {x for x in set().union(*mine) if x.strip() and sum(x in m for m in mine) >= 5 and sum(x in m for m in mine) / len(mine) > 0.1}
        assert got[i] == (None if text is None else "\n".join(x for x in text.split("\n") if x not in bad), "x")
