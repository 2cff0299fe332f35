"""Operators of the llm subpackage on small fixtures: SQL, brute force, exact round trips and edge cases."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, catalog, jaccard_join, language_id, line_dedup, mixing, quality, text_search, token_rollup, toxicity, vector_search
from ledgerloom.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _text string"


def edge_docs(spark):
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, "one two", "en", None), (3, "one two", "en", None), (None, "hello world again and again", "en", "a"), (5, "word " * 30_000, "de", "src0"), (6, "x\n\nx\n" * 5, "fr", "src0"), (7, "12 34", None, "b")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "clash") for i, t, g, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = con.sql(catalog.SQL[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for d in (docs, docs.limit(0)):
        n = d.count()
        assert line_dedup.drop_boilerplate(d, "source", "text", 0.1, 2).count() == n
        assert mixing.mix(d, weights={"a": 1.0, "other": 1.0}).columns == docs.columns
        assert language_id.identify(d, d).count() == n
        assert bpe.digests(d).count() == n
        assert jaccard_join.join_documents(d).count() == n
        assert quality.classify(d, labels, "quality", lambda k: k.isNotNull()).count() == n
        assert toxicity.classify(d, labels, "toxic", lambda k: k.isNotNull()).count() == n
        assert text_search.search(d, d).where("rank > 10").count() == 0
    found = {r["_lang"]["lang"] for r in language_id.identify(docs, docs).where("doc_id in (1, 2, 7)").collect()}
    assert found == {"und"}


def test_bpe_is_tiktoken():
    path, pattern = bpe.default_vocabulary()
    c = bpe.Codec(path, pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rnd = random.Random(3)
    for _ in range(300):
        s = "".join(rnd.choice("aeinthers  \n\té12日😀'!\x1c　") for _ in range(rnd.choice([0, 1, 9, 200]))) + rnd.choice(["", "e" * 300])
        ids = np.frombuffer(c.encode(s), dtype="<u4").tolist()
        assert ids == enc.encode_ordinary(s)
        assert c.decode(c.encode(s)) == s.encode()


def components_of(sets, num, den):
    """Smallest index of each set's component, by comparing all pairs."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and den * len(a & b) >= num * len(a | b):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(sets))]


def similar_texts(rnd, n):
    """Word lists: copies with changes, and a large group of copies that differ from each other."""
    texts = []
    for _ in range(40):
        texts.append([f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 2, 5, 12, 40, 120]))])
        for _ in range(rnd.choice([0, 1, 5])):
            copy = list(rnd.choice(texts))
            for _ in range(rnd.choice([1, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = f"changed{rnd.randrange(3)}"
            texts.append(copy)
    base = [f"b{rnd.randrange(400)}" for _ in range(150)]
    for _ in range(40):
        copy = list(base)
        for _ in range(rnd.choice([2, 4, 6])):
            copy[rnd.randrange(len(copy))] = f"z{rnd.randrange(1000)}"
        texts.append(copy)
    return texts, [frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)]) for w in texts]


@pytest.mark.parametrize("num, n, small", [(90, 3, False), (90, 3, True), (80, 5, True), (60, 1, True), (50, 1, True)])
def test_jaccard_join(spark, monkeypatch, num, n, small):
    if small:  # every path: many shards, many labels of a signature, classes that hand over
        for name, value in (("SHARD", 6), ("LABELS", 2), ("NEIGHBOURS", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    texts, sets = similar_texts(random.Random(num + n), n)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard_join.join_documents(docs, n=n, num=num).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(components_of(sets, num, 100), map(len, sets), strict=True))


def test_signatures_meet():
    """Every similar pair of unequal sets shares a signature, whatever the frequent elements."""
    rng = np.random.default_rng(4)
    for num in (50, 80, 90):
        met = 0
        for _ in range(400):
            a = np.unique(rng.integers(-(1 << 62), 1 << 62, rng.choice([2, 5, 10, 30, 100, 400])))
            keep = a[rng.random(len(a)) > (100 - num) / 250]
            b = np.unique(np.concatenate([keep, rng.integers(-(1 << 62), 1 << 62, rng.integers(0, 1 + len(a) * (100 - num) // 250))]))
            avoid = np.sort(rng.permutation(a)[: len(a) // 2])
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= num * (len(a) + len(b) - shared) and shared < max(len(a), len(b)):
                met += 1
                assert len(np.intersect1d(jaccard_join.signatures(a, avoid, num, 100), jaccard_join.signatures(b, avoid, num, 100)))
        assert met > 50


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    rows = [(i, x[i].tolist()) for i in range(400)] + [(1000, x[0].tolist()), (1001, None), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0]), (None, x[1].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vector_search.search(t, t.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got[0][0] == (1000, pytest.approx(1.0)) and 1002 not in got
    ids, y = np.array([*range(400), 1000]), np.vstack([x, x[:1]])
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    hit = sum(len({v for v, _ in got[q]} & {int(i) for i in ids[np.argsort(-(y @ y[k]) + 9 * (ids == q))][:5]}) for k, q in enumerate(ids) if q % 20 == 0)
    assert hit >= 0.9 * 5 * len(got)
    assert vector_search.search(t.limit(0), t.limit(0)).count() == 0


def test_wand_is_exhaustive():
    rnd = random.Random(5)
    for _ in range(50):
        lists = []
        for _ in range(rnd.randrange(1, 6)):
            ids = sorted(rnd.sample(range(600), rnd.randrange(1, 400)))
            lists.append((rnd.random() * 5, text_search.Postings(np.array(ids, dtype=np.int64).tobytes(), np.array([rnd.choice([0.5, 1.0, rnd.random() * 2]) for _ in ids]).tobytes())))
        scores = defaultdict(float)
        for w, p in lists:
            for i, v in zip(p.ids, p.impacts, strict=True):
                scores[i] += w * v
        want = sorted((-round(s, 9), i) for i, s in scores.items() if i != 7)[:10]
        assert [i for _, i in sorted((-s, i) for s, i in text_search.wand(lists, 10, 7))] == [i for _, i in want]


def test_rollup_is_idempotent(spark):
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    rows = spark.createDataFrame([("a", None, "v", 3), ("a", None, "v", 4), (None, "en", "v", None)], "source string, lang string, version string, n_tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit("1", token_rollup.inserts(rows)) and not rollup.commit("1", token_rollup.inserts(rows))
    assert rollup.commit("2", token_rollup.deletes(rows.where("n_tokens = 3"))) and rollup.commit("3", token_rollup.inserts(rows.limit(0)))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == sorted([("a", None, "v", 1, 4), (None, "en", "v", 1, 0)], key=str)


def test_rollup_compacts(spark):
    docs = spark.createDataFrame([("a", "en", "Hello world, hello"), ("a", "en", None), ("b", None, "12 drummers")], "source string, lang string, text string")
    path, pattern = bpe.default_vocabulary()
    rows = token_rollup.counted(docs, {"bpe": F.coalesce(F.octet_length(bpe.encoder()("text")), F.lit(0)) / 4})
    rollup = token_rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("1", token_rollup.inserts(rows))
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    size = lambda t: len(enc.encode_ordinary(t))
    want = {("a", "en", "bpe", 2, size("Hello world, hello")), ("b", None, "bpe", 1, size("12 drummers"))}
    assert set(map(tuple, rollup.totals().collect())) == want
    rollup.compact()
    assert set(map(tuple, rollup.totals().collect())) == want and not rollup.commit("1", token_rollup.inserts(rows))
    rollup.commit("2", token_rollup.deletes(rows.where("source = 'b'")))
    rollup.compact()
    assert set(map(tuple, rollup.totals().collect())) == {x for x in want if x[0] == "a"}


def test_mixing_hits_the_weights(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 15_000, "a").otherwise("b").alias("source"), F.lit("xxxx").alias("text"))
    n = {r["source"]: r["count"] for r in mixing.mix(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()}
    assert abs(n["a"] - 10_000) < 500 and abs(n["b"] - 10_000) < 500


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = catalog.QUERIES["op9_language_id"](spark, sf).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
