"""Learning and scores of op3 and op10 against plain versions, and floors of their held-out quality."""

import math
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.language_id import learned_from

# op3


def plain_dictionaries(toxic, ordinary):
    """Contents of both dictionaries from lists of words of documents."""
    t, o = Counter(), Counter()
    for counts, docs in ((t, toxic), (o, ordinary)):
        for words in docs:
            counts.update({b for w in set(words) for b in toxicity._beginnings(w)})
    nt, no, odds = len(toxic), len(ordinary), {}

    def term(a, b):
        return a * math.log(a / b) if a > 0 else 0.0

    for b, n in t.items():
        x = math.log((n + 0.5) / (nt + 1)) - math.log((o[b] + 0.5) / (no + 1))
        p = (n + o[b]) / (nt + no)
        if n >= toxicity.MIN_DOCS and x > toxicity.MIN_ODDS and 2 * (term(n, nt * p) + term(o[b], no * p) + term(nt - n, nt * (1 - p)) + term(no - o[b], no * (1 - p))) > toxicity.MIN_RATIO:
            odds[b] = x
    seen, plain = Counter(w for d in toxic for w in d), Counter(w for d in ordinary for w in d)
    weight = {w: max(odds.get(b, 0.0) for b in toxicity._beginnings(w)) * math.log1p(n) for w, n in seen.items() if w}
    bad = sorted((w for w, x in weight.items() if x > 0), key=lambda w: (-round(weight[w], 9), w))
    base = [w for w, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0])) if w and weight.get(w, 0.0) <= 0]
    first, special = toxicity._fill(base, toxicity.BASE_BYTES), toxicity._fill(bad, toxicity.TOXIC_BYTES)
    return b" " * len(special) + first, special + first


def learnable(spark, sf, folds, out, label):
    """{doc_id: (text, label)} of the rows that may be learned from, and {doc_id: label} of the held-out ones."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").where(f"{label} is not null").select("doc_id", "text", label, learned_from(docs["doc_id"], folds, out)[0].alias("may")).collect()
    return {r["doc_id"]: (r["text"] or "", r[label]) for r in rows if r["may"]}, {r["doc_id"]: r[label] for r in rows if not r["may"]}


def test_toxicity_is_learned_and_scored_as_plainly(spark):
    sf = "/root/testdata/sf0.01"
    known, _ = learnable(spark, sf, 5, 0, "toxic")
    words = {y: [toxicity.words_of(t) for t, label in known.values() if label == y] for y in (0, 1)}
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    contents, trees = toxicity.learn(docs, labels, "toxic", lambda k: learned_from(k, 5, 0)[0], "doc_id", "text")
    want = plain_dictionaries(words[1], words[0])
    assert contents[0] == want[0] and sorted(contents[1].split()) == sorted(want[1].split())
    windows = toxicity.Windows(*contents)
    scored = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = np.array([windows.statistics(r["text"])])
        score = 1 / (1 + math.exp(-plain_margin(trees, x[0])))
        assert scored[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-12) and scored[r["doc_id"]]["predicted"] == int(score >= 0.5)
    assert len(scored) == docs.count()


def test_words_at_the_end_of_a_long_text_are_learned(spark):
    """A text of 3 million characters tells by its last words."""
    long_ = "calm " * 600_000 + "vile awful"
    docs = spark.createDataFrame([(i, long_ if i % 2 else "calm and kind") for i in range(24)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, toxic int")
    contents, _ = toxicity.learn(docs, labels, "toxic", lambda k: k.isNotNull(), "doc_id", "text")
    assert {b"vile", b"awful"} <= set(contents[1].split()) and b"vile" not in contents[0].split()


def area(scores, truth):
    """Share of pairs of both classes in the right order, ties by half."""
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(truth)[order]
    rank = np.searchsorted(s, s, side="left") + (np.searchsorted(s, s, side="right") - np.searchsorted(s, s, side="left") + 1) / 2
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_quality_of_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    _, truth = learnable(spark, sf, 5, 0, "toxic")
    rows = [r for r in toxicity.op3_toxicity(spark, sf).collect() if r["doc_id"] in truth]
    assert all(r["held_out"] for r in rows) and len(rows) == len(truth) > 500
    y = np.array([truth[r["doc_id"]] for r in rows])
    predicted = np.array([r["predicted"] for r in rows])
    assert area([r["score"] for r in rows], y) >= 0.93 and predicted[y == 1].mean() >= 0.65 and predicted[y == 0].mean() <= 0.04


# op10


def plain_margin(trees, x):
    """A walk down every tree, one node at a time."""
    total = trees.base
    for root in trees.roots:
        node = int(root)
        while trees.left[node] != node:
            node = int(trees.right[node] if x[trees.feature[node]] > trees.threshold[node] else trees.left[node])
        total += trees.value[node]
    return total


def plain_statistics(text):
    """FEATURES, one character and word at a time."""
    if not text:
        return [0.0] * len(quality.FEATURES)
    raw = text.encode("utf-8", "ignore")
    share = lambda test: sum(map(test, raw)) / len(raw)
    among = lambda chars: share(lambda c: c in chars)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    if not words:
        return [math.log1p(len(text)), *[0.0] * (len(quality.FEATURES) - 1)]
    n, sizes = len(words), [len(w) for w in words]
    mean = sum(sizes) / n
    counts = Counter(words)
    return [
        math.log1p(len(text)), math.log1p(n), mean, math.sqrt(sum((s - mean) ** 2 for s in sizes) / n),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), among(b" \t\r"), among(b"\n"), share(lambda c: c >= 128), among(b"!"), among(b"?"), among(b"|"), among(b"#$%&*@^~=+<>_{}[]/\\"), among(b"."), among(b",;:"),
        len(counts) / n, max(counts.values()) / n, sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, sum(w.isupper() for w in words) / n, sum(s > 20 for s in sizes) / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), sum(not w[-1].isalnum() for w in words) / n,
    ]


def test_statistics_are_the_plain_ones(spark, sf):
    texts = [None, "", " \n ", "A a A\n\nA a A", "x|y #1 ¡olé! ¿qué?\n" * 3] + [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), rel=1e-9, abs=1e-12)


def plain_fit(x, y, trees, depth, bins):
    """Boosting by the best split of binned features, all splits tried one by one; the margins of the rows."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))

    def grow(rows, left):
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-3, None)
        if left and len(rows) >= 2 * quality.LEAF:
            for j, e in enumerate(edges):
                for k, cut in enumerate(e):
                    low = x[rows, j] <= cut
                    if min(low.sum(), (~low).sum()) >= quality.LEAF:
                        gl, hl = g[rows][low].sum(), h[rows][low].sum()
                        gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                        if gain > best[0] + 1e-9:
                            best = gain, (j, cut)
        if best[1] is None:
            margin[rows] += quality.RATE * gs / (hs + 1)
            return
        low = x[rows, best[1][0]] <= best[1][1]
        grow(rows[low], left - 1)
        grow(rows[~low], left - 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        grow(np.arange(len(y)), depth)
    return margin


def test_trees_are_fitted_as_plainly(monkeypatch):
    monkeypatch.setattr(quality, "TREES", 6)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((160, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.standard_normal(160) > 0).astype(float)
    trees = quality.fit(x, y)
    assert np.allclose(trees.margin(x), plain_fit(x, y, 6, quality.DEPTH, quality.BINS), atol=1e-9)
    assert np.allclose(trees.margin(x), [plain_margin(trees, r) for r in x])


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    _, truth = learnable(spark, sf, 4, 2, "quality")
    rows = [r for r in quality.op10_quality(spark, sf).collect() if r["doc_id"] in truth]
    y = np.array([truth[r["doc_id"]] for r in rows])
    assert all(r["held_out"] for r in rows) and area([r["score"] for r in rows], y) >= 0.99 and (np.array([r["predicted"] for r in rows]) == y).mean() >= 0.98
