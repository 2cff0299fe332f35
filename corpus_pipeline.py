"""A corpus pipeline over ``documents``: language ID, line dedup, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it wrote, and returns a DataFrame. All but the
last return the columns of documents. Stages keep rows one for one but for what their docstrings name; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, jaccard_join, language_id, line_dedup, mixing
from ledgerloom.session import Scratch, written

#: Rows that leave as near copies and are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def keep_known_languages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or empty texts, texts without a letter, or nothing learned that they could be.

    A null ``lang`` becomes the predicted one; any other stays as it came. Repeated rows stay.
    """
    found = language_id.identify(docs, docs, "text", "lang", "_found_language")
    named = found.where(F.col("_found_language.lang") != language_id.UND).withColumn("lang", F.coalesce("lang", "_found_language.lang"))
    return named.select(*docs.columns)


def drop_boilerplate_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that too many documents of a source share; ``n_chars`` follows the text. Null texts stay null, a null source is one source."""
    cleaned = line_dedup.drop_boilerplate(docs, "source", "text")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked at 0.8 over five-word shingles: that of the smallest doc_id (null last), among
    equals by a hash of the text. Rows of one doc_id with different texts are documents of their own; rows of one
    doc_id and text are copies, of which any one stays. Texts without words are linked with nothing and stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(7), "text").alias("b"))
    known = jaccard_join.join_documents(docs.select(key.alias("_row"), "text"), "_row", "text", n=5, num=80, den=100).where("class is not null")
    known = written(known.groupBy("_row").agg(F.count("*").alias("_n"), F.max(F.col("_row") != F.col("component_id")).alias("_out")).where("_n > 1 or _out"), "pipeline-copies")
    marked = docs.withColumns({"_copy_id": F.col("doc_id"), "_copy_a": F.xxhash64("text"), "_copy_b": F.xxhash64(F.lit(7), "text")})

    def of(rows: DataFrame) -> tuple[DataFrame, Column]:
        rows = rows.select("_row.*")
        same = marked["_copy_id"].eqNullSafe(rows["id"]) & (marked["_copy_a"] == rows["a"]) & (marked["_copy_b"] == rows["b"])
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows, same

    kept = marked.join(*of(known.where("_out")), "left_anti")
    again = known.where("not _out")
    if again.limit(1).count():
        again, same = of(again)
        once = kept.join(again, same, "left_semi").dropDuplicates(["_copy_id", "_copy_a", "_copy_b"])
        kept = kept.join(again, same, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def mix_to_weights(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's rate and shuffles them; a rate below one also leaves documents out."""
    return mixing.mix(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and their round trip, as digests; a null text is the empty text."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate_lines),
    ("near_copies", keep_one_of_near_copies),
    ("mixing", mix_to_weights),
    ("byte_bpe", encode),
]


def run(spark, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; a stage's table goes when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES:
            before, docs = docs, scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            if name != STAGES[0][0]:
                scratch.drop(before)
        return scratch.keep(docs)


#: SQL has neither the mixture inference nor the ranked merges.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
