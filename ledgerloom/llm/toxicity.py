"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled documents: one on ordinary
text, one on toxic text. A document's words are cut into windows; each window is compressed with either
dictionary, and the bytes that the toxic dictionary saves are its gain. How many windows gain at
least 1, 2, 3 ... bytes, in number and share, goes with the document's bytes a byte under the
ordinary dictionary into boosted trees that calibrate the thresholds on the same sample.

Training: word beginnings and whole words that stand in a larger share of toxic than of ordinary sample documents
(log-likelihood ratio and log odds above fixed bounds) select the toxic dictionary's words; the
ordinary dictionary's words are the most frequent other ones. Both dictionaries end with the same ordinary words
at the same distances, so a gain comes from toxic words only. Contents are raw dictionaries. Words are counted by Spark over the whole
texts of the sample; the driver gets the words that tell, those that fit into the dictionaries, and a row of statistics a sample document.

Defined results: null and empty texts have no windows and get the score of a document with no gain; without
labelled rows of both classes every score is the share of label 1 (0.5 without labels); of several
labels of a key the largest counts, of several texts of a key one (that of the smallest hash); rows with a null key are scored, never learned from; repeated rows get
equal scores; texts of any length are scored whole; a column that is named as ``into`` is replaced, other columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.language_id import learned_from
from ledgerloom.llm.quality import Trees, fit
from ledgerloom.session import Scratch, arrow_rows, text_batches

#: Most labelled documents of a class that are learned from; their texts are taken whole.
MAX_TRAIN = 3_000
#: Texts of an Arrow batch.
BATCH = 1_000
WORDS = 4  # of a window
BASE_BYTES, TOXIC_BYTES = 12_000, 6_000
MIN_DOCS, MIN_ODDS, MIN_RATIO = 4, 1.2, 24.0
TOP = 9  # largest gain that is told apart
STRIP = ".,;:!?#$%&*|\"'()"


def words_of(text: str | None) -> list[str]:
    return [w.strip(STRIP) for w in text.lower().split()] if text else []


def _beginnings(word: str) -> list[str]:
    return [f" {word[:k]}" for k in range(3, min(len(word), 9) + 1)] + ([f" {word} "] if word else [])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (label, text) -> (beginning or word, kind, toxic and ordinary counts): documents that have a beginning, times that a word stands in them."""
    for batch in batches:
        for label, text in zip(batch["_label"], batch["_text"], strict=True):
            words = Counter(words_of(text))
            starts = list({b for w in words for b in _beginnings(w)})
            terms, n = [*starts, *words], np.array([1] * len(starts) + list(words.values()), dtype=np.int64)
            none = np.zeros(len(terms), dtype=np.int64)
            yield pd.DataFrame({"term": terms, "word": [False] * len(starts) + [True] * len(words), "toxic": n if label == 1 else none, "ordinary": none if label == 1 else n})


def odds_of(counts: DataFrame, toxic: int, ordinary: int) -> DataFrame:
    """Word beginnings (``term``) that tell toxic from ordinary documents, with their log odds; counts are documents that have them, of so many."""
    a, b = F.col("toxic").cast("double"), F.col("ordinary").cast("double")
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (ordinary + 1))
    p = (a + b) / (toxic + ordinary)
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (part(a, toxic * p) + part(b, ordinary * p) + part(toxic - a, toxic * (1 - p)) + part(ordinary - b, ordinary * (1 - p)))
    return counts.where(a >= MIN_DOCS).withColumn("odds", odds).where((F.col("odds") > MIN_ODDS) & (ratio > MIN_RATIO)).select("term", "odds")


def _fill(words: list[str], most: int) -> bytes:
    """The first words that fit, the first of them last (nearest to the text)."""
    taken, size = [], 1
    for w in words:
        size += len(w.encode()) + 1
        if size > most:
            break
        taken.append(w)
    return f" {' '.join(reversed(taken))} ".encode()


def train_dictionaries(sample: DataFrame, toxic: int, ordinary: int) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary, from rows (``_label``, ``_text``) of so many documents."""
    spark = sample.sparkSession
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("word", T.BooleanType()), *longs("toxic", "ordinary")])
    with Scratch(spark) as scratch:
        counts = scratch.written(sample.mapInPandas(_counted, schema).groupBy("term", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "toxicity-counts")
        odds = {r["term"]: r["odds"] for r in odds_of(counts.where("not word"), toxic, ordinary).collect()}  # few of the beginnings tell
        known = spark.sparkContext.broadcast(odds)

        @F.pandas_udf(T.DoubleType())
        def telling(words: pd.Series) -> pd.Series:
            return words.map(lambda w: max((known.value.get(b, 0.0) for b in _beginnings(w)), default=0.0)).astype(float)

        words = counts.where("word and term <> ''").withColumn("weight", F.when(F.col("toxic") > 0, telling("term")).otherwise(0.0) * F.log1p("toxic"))
        # A word has a byte and a space at least, so these are all that can fit.
        base = [r["term"] for r in words.where("ordinary > 0 and weight <= 0").orderBy(F.desc("ordinary"), "term").limit(BASE_BYTES // 2).collect()]
        bad = [r["term"] for r in words.where("weight > 0").orderBy(F.desc("weight"), "term").limit(TOXIC_BYTES // 2).collect()]
    ordinary_words, special = _fill(base, BASE_BYTES), _fill(bad, TOXIC_BYTES)
    return b" " * len(special) + ordinary_words, special + ordinary_words


class Windows:
    """Compresses windows with either dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compress = []
        for content in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0)
            d.precompute_compress(compression_params=p)
            self.compress.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)

    def statistics(self, text: str | None) -> list[float]:
        words, (plain, toxic) = words_of(text), self.compress
        parts = [f" {' '.join(words[i : i + WORDS])} ".encode("utf-8", "ignore") for i in range(0, len(words), WORDS)] or [b" "]
        before = list(map(len, map(plain, parts)))
        gain = np.array(before) - np.fromiter(map(len, map(toxic, parts)), dtype=np.int64, count=len(parts))
        tail = np.bincount(np.clip(gain, 0, TOP), minlength=TOP + 1)[::-1].cumsum()[::-1][1:]
        return [*(tail / len(parts)), *np.log1p(tail), float(gain.max()), float(gain.mean()), sum(before) / sum(map(len, parts)), math.log1p(len(parts))]


def learn(docs: DataFrame, labels: DataFrame, label: str, may_learn, key: str, text: str, max_train: int = MAX_TRAIN) -> tuple[tuple[bytes, bytes] | None, Trees]:
    """Dictionaries (None without both classes) and calibration, from at most ``max_train`` documents of a class, whose texts are taken whole."""
    spark = docs.sparkSession
    known = labels.where(may_learn(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    picked = [known.where(F.col("_label") == y).orderBy(F.xxhash64("_key"), "_key").limit(max_train) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 x max_train rows at most
    rows = docs.select(F.col(key).alias("_own"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(chosen, F.col("_own") == F.col("_key"))
    rows = rows.groupBy("_key", "_label").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), F.col("_text"))).alias("_text"))
    with Scratch(spark) as scratch, arrow_rows(spark, BATCH):
        sample = scratch.written(rows, "toxicity-sample")
        n = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
        ones, zeros = (sum(c for y, c in n.items() if (y == 1) == one) for one in (True, False))
        if not ones or not zeros:
            return None, fit(np.zeros((ones + zeros, 0)), np.array([1.0] * ones + [0.0] * zeros))
        contents = train_dictionaries(sample, ones, zeros)
        shared = spark.sparkContext.broadcast(contents)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            windows = Windows(*shared.value)
            for texts in batches:
                yield pd.Series([windows.statistics(t) for t in texts], dtype=object)

        found = sample.select("_label", F.xxhash64("_key").alias("_h"), F.col("_key").cast("string").alias("_name"), statistics("_text").alias("x")).orderBy("_label", "_h", "_name").collect()  # numbers of 2 x max_train rows at most
    return contents, fit(np.array([r["x"] for r in found]), np.array([float(r["_label"] == 1) for r in found]))


def scorer(spark, contents: tuple[bytes, bytes] | None, trees: Trees):
    """A column function: text -> score."""
    model = spark.sparkContext.broadcast((contents, trees))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        contents, trees = model.value
        windows = Windows(*contents) if contents else None
        for texts in batches:
            x = np.array([windows.statistics(t) for t in texts]) if windows else np.zeros((len(texts), 0))
            yield pd.Series(1 / (1 + np.exp(-trees.margin(x)))) if len(texts) else pd.Series([], dtype=float)

    return score


def classify(docs: DataFrame, labels: DataFrame, label: str, may_learn, key: str = "doc_id", text: str = "text", into: str = "score", **bounds: int) -> DataFrame:
    """The documents with the column ``into``; learned from labelled rows where ``may_learn`` (a function of the key column) holds. Arrow batches are bounded in the session."""
    text_batches(docs.sparkSession, BATCH)
    return docs.withColumn(into, scorer(docs.sparkSession, *learn(docs, labels, label, may_learn, key, text, **bounds))(F.col(f"`{text}`")))


def op3_toxicity(spark, sf_dir):
    """Every document's toxicity score, learned from four of five folds."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs.select("doc_id", "text"), labels, "toxic", lambda key: learned_from(key, 5, 0)[0])
    return scored.select("doc_id", learned_from(F.col("doc_id"), 5, 0)[1].alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
