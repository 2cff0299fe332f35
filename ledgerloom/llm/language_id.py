"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased text, counted over every
training document. A document is a mixture of languages: expectation-maximisation estimates its
proportions from the likelihoods of its trigrams. Then language sets are tried in the order of the
proportions, one language more at a time, and a further language is kept only while the likelihood
gains more than the penalty of one more language. The prediction is the largest proportion in the selected
set, the score is that proportion.

Defined results: a text that is null, empty or without a letter is ``und`` with score 0; so is every text where
nothing could be learned; texts shorter than a trigram are padded with spaces; equal proportions go to
the language that sorts first; repeated rows get equal results; texts of any length are taken whole; a column that is named
as ``into`` is replaced, other columns stay; of more than MAX_LANGUAGES languages those of the most text are learned; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import Scratch, text_batches

BUCKETS = 1 << 15
#: The learned table has BUCKETS x languages numbers; of more languages than this, those of the most text are learned.
MAX_LANGUAGES = 256
UND = "und"
#: Gain of log-likelihood that a further language needs, times the log of the number of trigrams.
PENALTY = 12.0
FULL_STEPS, SET_STEPS = 8, 6
#: Trigrams that are put through EM together.
ENTRIES = 150_000
LETTER = regex.compile(r"\p{L}")
COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "ignore"), dtype=np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(2654435761)) ^ (b[1:-1] * np.uint32(2246822519)) ^ (b[2:] * np.uint32(3266489917))
    h ^= h >> np.uint32(15)
    return (h * np.uint32(668265263)) >> np.uint32(17)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            if text and LETTER.search(text):
                if lang not in seen:
                    seen[lang] = np.zeros(BUCKETS, dtype=np.int64)
                seen[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and the BUCKETS x languages table of trigram probabilities, from all rows with text and language."""
    text_batches(docs.sparkSession, 250)
    own = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.written(own.mapInPandas(_count, COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
        langs = sorted(r["lang"] for r in rows.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect())
        counts = rows.where(F.col("lang").isin(langs)).toArrow()  # BUCKETS x most rows at most
    table = np.full((BUCKETS, len(langs)), 0.5)
    place = np.searchsorted(np.array(langs, dtype=object), counts.column("lang").to_numpy(zero_copy_only=False)) if langs else np.zeros(0, dtype=np.int64)
    table[counts.column("bucket").to_numpy(), place] += counts.column("n").to_numpy()
    return langs, (table / table.sum(axis=0, keepdims=True)).astype(np.float32)


def _em(p: np.ndarray, n: np.ndarray, starts: np.ndarray, doc: np.ndarray, total: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document; p: trigrams x languages, share: documents x languages."""
    for _ in range(steps):
        r = p * share[doc]
        r *= (n / r.sum(axis=1))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / total[:, None]
    mixed = (p * share[doc]).sum(axis=1)
    return share, np.add.reduceat(n * np.log(mixed), starts)


def infer(texts: list[str], table: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The proportions of the selected languages, 0 for all others; a row per text."""
    languages, out = table.shape[1], np.zeros((len(texts), table.shape[1]))
    group: list[tuple[int, np.ndarray, np.ndarray]] = []

    def solve() -> None:
        if not group:
            return
        sizes = np.array([len(g[1]) for g in group])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        p = table[np.concatenate([g[1] for g in group])]
        n = np.concatenate([g[2] for g in group]).astype(np.float32)
        doc = np.repeat(np.arange(len(group)), sizes)
        total = np.add.reduceat(n, starts)
        share, _ = _em(p, n, starts, doc, total, np.full((len(group), languages), 1 / languages, dtype=np.float32), FULL_STEPS)
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.zeros_like(share)
        best[np.arange(len(group)), order[:, 0]] = 1
        fit = np.add.reduceat(n * np.log((p * best[doc]).sum(axis=1)), starts)
        open_ = np.arange(len(group))
        for k in range(2, languages + 1):  # only documents that gained by the last language go on
            keep = np.isin(doc, open_)
            at, size = np.searchsorted(open_, doc[keep]), sizes[open_]
            chosen = np.zeros((len(open_), languages), dtype=np.float32)
            np.put_along_axis(chosen, order[open_, :k], 1 / k, axis=1)
            tried, now = _em(p[keep], n[keep], np.concatenate([[0], np.cumsum(size)[:-1]]), at, total[open_], chosen, SET_STEPS)
            gained = now - fit[open_] > penalty * np.log(total[open_])
            open_ = open_[gained]
            if not len(open_):
                break
            best[open_], fit[open_] = tried[gained], now[gained]
        out[[g[0] for g in group]] = best
        group.clear()

    entries = 0
    for i, text in enumerate(texts):
        if text and LETTER.search(text):
            counts = np.bincount(trigrams(text), minlength=BUCKETS)
            at = np.flatnonzero(counts)
            group.append((i, at, counts[at]))
            entries += len(at)
            if entries >= ENTRIES:
                solve()
                entries = 0
    solve()
    return out


PREDICTED = T.StructType(
    [T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType()))]
)


def predictor(spark, langs: list[str], table: np.ndarray, penalty: float = PENALTY):
    """A column function: text -> struct of PREDICTED. The model is at most MAX_LANGUAGES x BUCKETS numbers."""
    model = spark.sparkContext.broadcast((langs, table))

    @F.pandas_udf(PREDICTED)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, probabilities = model.value
        for texts in batches:
            shares = infer(list(texts), probabilities, penalty) if names else np.zeros((len(texts), 1))
            rows = []
            for s in shares:
                at = [int(i) for i in np.argsort(-s, kind="stable") if s[i] > 0]
                rows.append((names[at[0]], float(min(1.0, s[at[0]])), [names[i] for i in at], [float(s[i]) for i in at]) if at else (UND, 0.0, [], []))
            yield pd.DataFrame(rows, columns=["lang", "score", "langs", "shares"])

    return predict


def learned_from(key: Column, folds: int, out: int) -> tuple[Column, Column]:
    """Two booleans: may be learned from, is held out. A null key is neither."""
    fold = F.crc32(key.cast("string").cast("binary")) % folds
    return F.coalesce(fold != out, F.lit(False)), F.coalesce(fold == out, F.lit(False))


def identify(docs: DataFrame, train: DataFrame, text: str = "text", lang: str = "lang", into: str = "_lang", most: int = MAX_LANGUAGES) -> DataFrame:
    """The documents with a column ``into``, a struct of PREDICTED; the languages, ``most`` at most, are learned from ``train``."""
    langs, table = learn(train, text, lang, most)
    return docs.withColumn(into, predictor(docs.sparkSession, langs, table)(F.col(f"`{text}`")))


def op9_language_id(spark, sf_dir):
    """Every document's predicted language, learned from two of three folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learn_it, held_out = learned_from(F.col("doc_id"), 3, 1)
    return identify(docs, docs.where(learn_it)).select(
        "doc_id", held_out.alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"), F.col("_lang.langs").alias("langs"), F.col("_lang.shares").alias("shares")
    )
