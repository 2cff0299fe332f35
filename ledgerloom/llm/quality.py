"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass turns each whole text into FEATURES and writes them to the shared folder. The trees are
fitted with numpy on at most MAX_TRAIN labelled rows (those with the smallest hash of their key), by logistic
loss on binned features; the trees are flattened into arrays, and scoring walks all rows of a batch
down all trees at once.

Defined results: null and empty texts have all statistics 0 and get the score of such a row; where
no labelled rows of both classes can be learned from, every score is the share of label 1 (0.5 without
labels); of several labels of a key the largest counts; repeated rows get equal scores; rows with a null
key are scored and never learned from; texts of any length are taken whole; only key and text are read, whatever other columns are
named; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.language_id import learned_from
from ledgerloom.session import text_batches, written

#: Most labelled rows that the trees are fitted on.
MAX_TRAIN = 20_000
BINS, TREES, DEPTH, RATE, LEAF = 64, 60, 4, 0.2, 8
FEATURES = [
    "chars", "words", "word_mean", "word_sd", "upper", "digit", "space", "newline", "other_byte", "bang", "query", "pipe", "symbol", "stop", "comma",
    "distinct", "most_frequent", "adjacent_equal", "upper_words", "long_words", "line_words", "repeated_lines", "line_ends", "word_ends",
]
_KIND = np.full(256, 15, dtype=np.uint8)
_KIND[128:] = 0
for _k, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b"!", b"?", b"|", b"#$%&*@^~=+<>_{}[]/\\", b".", b",;:"], start=1):
    _KIND[np.frombuffer(_chars, dtype=np.uint8)] = _k


def statistics(text: str | None) -> list[float]:
    """The FEATURES of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "ignore"), dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=16) / max(1, len(raw))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if not n:
        return [np.log1p(len(text)), *[0.0] * (len(FEATURES) - 1)]
    lengths, counts = np.fromiter(map(len, words), dtype=np.float64, count=n), Counter(words)
    return [
        float(np.log1p(len(text))), float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        kinds[1], kinds[2], kinds[3], kinds[4], kinds[0], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], kinds[10],
        len(counts) / n, max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, sum(map(str.isupper, words)) / n, float((lengths > 20).mean()),
        n / len(lines), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), sum(not w[-1].isalnum() for w in words) / n,
    ]


@F.pandas_udf(T.ArrayType(T.FloatType()))
def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([statistics(t) for t in texts])


class Trees:
    """Trees as flat arrays: a node's feature, threshold, children (itself for a leaf) and value."""

    def __init__(self, base: float):
        self.base, self.roots = base, np.zeros(0, dtype=np.int32)
        self.feature = self.left = self.right = np.zeros(0, dtype=np.int32)
        self.threshold = self.value = np.zeros(0)

    def add(self, nodes: list[tuple[int, float, int, int, float]]) -> None:
        at = len(self.feature)
        f, t, a, b, v = (np.array(x) for x in zip(*nodes, strict=True))
        self.roots = np.append(self.roots, at).astype(np.int32)
        self.feature, self.threshold = np.append(self.feature, f).astype(np.int32), np.append(self.threshold, t)
        self.left, self.right = np.append(self.left, a + at).astype(np.int32), np.append(self.right, b + at).astype(np.int32)
        self.value = np.append(self.value, v)

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if not len(self.roots):
            return total
        for begin in range(0, len(x), 4096):
            part = x[begin : begin + 4096]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            rows = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                node = np.where(part[rows, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            total[begin : begin + 4096] += self.value[node].sum(axis=1)
        return total


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees on x (rows x features) and 0/1 labels."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Trees(float(np.log((share * 0.998 + 0.001) / (1 - share * 0.998 - 0.001))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    trees, columns = Trees(float(np.log(share / (1 - share)))), x.shape[1]
    offset = np.arange(columns) * BINS
    margin = np.full(len(y), trees.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        nodes: list[tuple[int, float, int, int, float]] = []

        def grow(rows: np.ndarray, depth: int, g=g, h=h, nodes=nodes) -> int:
            at, gs, hs = len(nodes), g[rows].sum(), h[rows].sum()
            value = RATE * gs / (hs + 1.0)
            nodes.append((0, np.inf, at, at, value))
            if depth == DEPTH or len(rows) < 2 * LEAF:
                margin[rows] += value
                return at
            flat = (binned[rows] + offset).ravel()
            sums = [np.bincount(flat, weights=np.repeat(w, columns), minlength=columns * BINS).reshape(columns, BINS).cumsum(axis=1)[:, :-1] for w in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -np.inf
            j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
            if not gain[j, k] > 1e-3 or k >= len(edges[j]):
                margin[rows] += value
                return at
            below = binned[rows, j] <= k
            left, right = grow(rows[below], depth + 1), grow(rows[~below], depth + 1)
            nodes[at] = (int(j), float(edges[j][k]), left, right, 0.0)
            return at

        grow(np.arange(len(y)), 0)
        trees.add(nodes)
    return trees


def scorer(spark, trees: Trees):
    """A column function: array of FEATURES -> score."""
    model = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(1 / (1 + np.exp(-model.value.margin(np.stack(x.to_numpy()).astype(np.float64))))) if len(x) else pd.Series([], dtype=float)

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str, may_learn, key: str = "doc_id", text: str = "text", max_train: int = MAX_TRAIN) -> DataFrame:
    """Key, FEATURES and score of every document; learned from labelled rows where ``may_learn`` (a function of the key column) holds."""
    text_batches(docs.sparkSession)
    rows = written(docs.select(F.col(key), features(F.col(f"`{text}`")).alias("features")), "quality-features")
    known = labels.where(may_learn(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).cast("double").alias("_label"))
    sample = known.orderBy(F.xxhash64("_key"), "_key").limit(max_train)
    train = rows.join(F.broadcast(sample), rows[key] == F.col("_key")).groupBy("_key", "_label").agg(F.min("features").alias("features")).toPandas()  # max_train rows at most
    train = train.sort_values("_key")
    x = np.stack(train["features"].to_numpy()).astype(np.float64) if len(train) else np.zeros((0, len(FEATURES)))
    trees = fit(x, train["_label"].to_numpy(dtype=np.float64))
    return rows.withColumn("score", scorer(docs.sparkSession, trees)("features"))


def op10_quality(spark, sf_dir):
    """Every document's quality score, learned from three of four folds."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs, labels, "quality", lambda key: learned_from(key, 4, 2)[0])
    return scored.select("doc_id", learned_from(F.col("doc_id"), 4, 2)[1].alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
