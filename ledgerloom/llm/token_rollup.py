"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of changes (inserts, deletes, revised
counts) is summed by key and written as one attempt; a commit record, written after it, makes the attempt count. A record counts once it is
complete; a batch whose id has one is not applied again, and attempts without one (lost drivers, failed writes) are never read,
so a batch may be replayed at any time. A snapshot holds the sums of a fixed list of batches: what is committed while it
is written stays outside it and is added by readers.

Defined results: null keys are keys of their own; null counts are 0; keys whose totals are all 0 are left out; an
empty batch commits and changes nothing; repeated rows in a batch count each time; texts of any length count, as only counts come here; other columns are ignored. Two writers
may commit different batches at once; of two that commit one batch at once, the later record holds, so its attempt alone counts.
"""

from __future__ import annotations

import functools
import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import token_files
from ledgerloom.session import Scratch, arrow_rows, scratch_path

KEYS = ("source", "lang", "version")
MEASURES = ("n_docs", "n_tokens")
COMMITS = T.StructType([T.StructField("batch", T.StringType()), T.StructField("attempt", T.StringType())])


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add the documents of the rows (KEYS and ``n_tokens``)."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take the documents of the rows away."""
    return inserts(rows).withColumns({m: -F.col(m) for m in MEASURES})


def revisions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Changes that replace a document's count ``old`` by ``new``."""
    change = F.coalesce(F.col(new).cast("long"), F.lit(0)) - F.coalesce(F.col(old).cast("long"), F.lit(0))
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), change.alias("n_tokens"))


class TokenRollup:
    """The rollup at a path that all machines reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("attempt", T.StringType())])

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _names(self, folder: str) -> list[str]:
        if not self._exists(f"{self.path}/{folder}"):
            return []
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]

    def committed(self) -> DataFrame:
        """Batches and their attempts, of complete records alone."""
        done = [f"{self.path}/commits/{n}" for n in self._names("commits") if self._exists(f"{self.path}/commits/{n}/_SUCCESS")]
        return self.spark.read.schema(COMMITS).parquet(*done) if done else self.spark.createDataFrame([], COMMITS)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies the batch; false if it was applied before."""
        record = f"{self.path}/commits/{batch}"
        if self._exists(f"{record}/_SUCCESS"):
            return False
        attempt = uuid.uuid4().hex
        deltas = changes.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).withColumn("attempt", F.lit(attempt))
        deltas.write.parquet(f"{self.path}/deltas/{attempt}")
        # A record that a lost driver left without _SUCCESS is replaced, so there is one attempt a batch.
        self.spark.createDataFrame([(batch, attempt)], COMMITS).coalesce(1).write.mode("overwrite").parquet(record)
        return True

    def _snapshots(self) -> list[str]:
        """Whole snapshots, the oldest first; their names sort by time."""
        return sorted(n for n in self._names("snapshots") if self._exists(f"{self.path}/snapshots/{n}/commits/_SUCCESS"))

    def _state(self) -> tuple[list[str], list[tuple[str, str]], list[tuple[str, str]]]:
        """The last snapshot, (batch, attempt) of all commits, and of those that it lacks. Each is one name a batch."""
        last, all_ = self._snapshots()[-1:], [tuple(r) for r in self.committed().collect()]
        covered = {r[0] for s in last for r in self.spark.read.schema(COMMITS).parquet(f"{self.path}/snapshots/{s}/commits").select("batch").collect()}
        return last, all_, [c for c in all_ if c[0] not in covered]

    def _sums(self, last: list[str], open_: list[tuple[str, str]]) -> DataFrame:
        paths = [*(f"{self.path}/snapshots/{s}/totals" for s in last), *(f"{self.path}/deltas/{attempt}" for _, attempt in open_)]
        if not paths:
            return self.spark.createDataFrame([], self.schema).drop("attempt")
        parts = self.spark.read.schema(self.schema).parquet(*paths)
        return parts.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES)).where(" or ".join(f"{m} <> 0" for m in MEASURES))

    def compact(self) -> None:
        """Sums all committed deltas into a snapshot, after which totals() reads only it and what was committed later. Batches stay known."""
        at = f"{self.path}/snapshots/{time.time_ns():020d}-{uuid.uuid4().hex}"
        last, all_, open_ = self._state()  # one list for both tables: a commit from now on is in neither
        self._sums(last, open_).write.parquet(f"{at}/totals")
        self.spark.createDataFrame(all_, COMMITS).write.parquet(f"{at}/commits")  # last: a snapshot without it does not count

    def totals(self) -> DataFrame:
        """Sums by KEYS over the last snapshot and the deltas of batches that it lacks."""
        last, _, open_ = self._state()
        return self._sums(last, open_)


def counted(docs: DataFrame, versions: dict[str, Column]) -> DataFrame:
    """KEYS and ``n_tokens`` of every document under each tokenizer version, a column of counts: ``F.octet_length(bpe.encoder()("text")) / 4`` counts byte-level BPE."""
    each = F.array(*(F.struct(F.lit(v).alias("version"), n.cast("long").alias("n_tokens")) for v, n in versions.items()))
    return docs.select("source", "lang", F.inline(each))


#: The tokenizer versions of op7 and their files, named as in public_tokenizers.
WORDS, PIECES = "word_bpe_49k", "piece_bpe_32k"
FILES = {WORDS: "word_bpe_49k.json", PIECES: "piece_bpe_32k.model"}
#: Texts of an Arrow batch.
BATCH = 250


@functools.cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(paths: dict[str, str]):
    """A column function: text -> struct of the number of ids under WORDS and PIECES, without special tokens; a null text has none."""
    kind = T.StructType([T.StructField(v, T.LongType()) for v in (WORDS, PIECES)])

    @F.pandas_udf(kind)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, pieces = token_files.encoder(paths[WORDS]), _pieces(paths[PIECES])
        for batch in batches:
            texts = [t or "" for t in batch]
            yield pd.DataFrame({WORDS: [len(ids) // 4 for ids in encode(texts)], PIECES: list(map(len, pieces.encode(texts, num_threads=1))) if texts else []}, dtype="int64")

    return count


def op7_token_counts(spark, sf_dir):
    """Totals over ``documents`` after four batches: all documents inserted under two tokenizers, exact copies deleted
    (the smallest doc_id of a text stays; a null text is no copy), the counts of the first tokenizer revised to those with an end id for what is left, the deletes replayed."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = token_counts({v: public_tokenizers.path(f) for v, f in FILES.items()})

    def versions(rows: DataFrame) -> DataFrame:
        return counted(rows, {v: F.col(v) for v in FILES})

    with Scratch(spark) as scratch, arrow_rows(spark, BATCH):
        counts = scratch.written(docs.select("doc_id", "source", "lang", F.md5("text").alias("_text"), count("text").alias("_n")).select("doc_id", "source", "lang", "_text", "_n.*"), "token-counts")
        first = scratch.written(counts.groupBy("_text").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"), "token-copies")
        # Both sides are shuffled by the join alone, so a text of very many copies is split between tasks.
        kept = F.col("_first").isNull() | F.col("doc_id").eqNullSafe(F.col("_first"))
        marked = scratch.written(counts.join(first, "_text", "left").withColumn("kept", kept), "token-marked")
        rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
        rollup.commit("1-insert", inserts(versions(marked)))
        rollup.commit("2-delete", deletes(versions(marked.where("not kept"))))
        revised = marked.where("kept").select("source", "lang", F.lit(WORDS).alias("version"), F.col(WORDS).alias("old"), (F.col(WORDS) + 1).alias("new"))
        rollup.commit("3-revise", revisions(revised, "old", "new"))
        rollup.commit("2-delete", deletes(versions(marked.where("not kept"))))
    return rollup.totals()
