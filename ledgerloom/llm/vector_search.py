"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Centroids and a random rotation are fitted on a bounded sample. Every vector goes to the list of its nearest centroid;
a query goes to the lists of its nearest centroids. In a list, unit vectors are rotated and scanned in blocks of
columns: after k of d columns, a candidate is abandoned when its partial squared distance, scaled by d / k, is above
the best distances so far by more than a hypothesis test allows for k random directions. What is left is scored exactly, by
the cosine of the original vectors in double precision. Vectors of another length than most are in a list of their
length, which is scored in full.

Lists with many vectors are split into parts of about PART vectors that are searched apart, so a list
may hold any share of the rows. A task gets the vectors of a part first and then its queries, which pass by in batches, so it holds one part
whatever the number of queries. Results of a query's parts are merged by (score, smaller id) in two steps.

Defined results: vectors that are null, empty, zero or that hold null or non-finite components take no
part, neither as query nor as candidate; vectors of different lengths are no neighbours; rows with a null id take no part; rows of one id are one candidate and one query, as near to
another as the nearest of their vectors; a query never finds its own id; equal scores go to the smaller id; with
fewer candidates than k, all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import Scratch

#: Vectors that centroids and rotation are fitted on, at most; lists at most; vectors of a part.
SAMPLE, LISTS, PART = 20_000, 1024, 10_000
#: Share of the lists that a query probes, and the fewest; lists are probed on until they hold ENOUGH vectors.
PROBED, LEAST, ENOUGH = 0.65, 8, 200
BLOCK, CHUNK, TEST = 16, 2048, 2.1
SEED = 11


class Index:
    """Fitted centroids (unit rows), rotation and list sizes."""

    def __init__(self, sample: np.ndarray, rows: int):
        rng = np.random.default_rng(SEED)
        self.columns = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((self.columns, self.columns)))[0].astype(np.float32)
        n = int(min(LISTS, max(1, np.sqrt(rows)), len(sample)))
        x = unit(sample).astype(np.float32)
        c = x[rng.choice(len(x), n, replace=False)]
        for _ in range(10):
            own = nearest(x, c)[:, 0]
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            full = np.bincount(own, minlength=n) > 0
            c = np.where(full[:, None], unit(np.where(full[:, None], sums, 1)), c).astype(np.float32)
        self.centroids, self.sizes = c, np.zeros(n, dtype=np.int64)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        order = nearest(x, self.centroids, len(self.centroids))
        most = int(max(LEAST, np.ceil(PROBED * len(self.centroids))))
        held = np.cumsum(self.sizes[order], axis=1)
        return [o[: max(most, int(np.searchsorted(h, ENOUGH)) + 1)] for o, h in zip(order, held, strict=True)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.finfo(np.float64).tiny)


def nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """The k nearest rows of c for each row of x, in blocks of rows."""
    out = []
    for i in range(0, len(x), 4096):
        near = x[i : i + 4096].astype(np.float32) @ c.T
        out.append(np.argmax(near, axis=1)[:, None] if k == 1 else np.argsort(-near, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def usable(column: str) -> Column:
    """Finite, not null, not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def abandon(partial: np.ndarray, columns: int, of: int, limit: float) -> np.ndarray:
    """Whether a partial squared distance over some of the columns rejects that the whole is within the limit."""
    if columns >= of:
        return partial > limit
    return partial * (of / columns) > limit * (1 + TEST / np.sqrt(columns)) ** 2


def scan(query: np.ndarray, blocks: list[np.ndarray], k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Candidates that may be among the k nearest of the rotated query; blocks: columns of the rotated candidates, own: those that are the query's own."""
    rows, of = len(blocks[0]), len(query)
    best = np.full(k, np.inf, dtype=np.float32)
    left, distance = [], []
    for begin in range(0, rows, CHUNK):
        alive = np.arange(begin, min(rows, begin + CHUNK))
        if own is not None:
            alive = alive[~np.isin(alive, own)]
        sums, seen = np.zeros(len(alive), dtype=np.float32), 0
        for b in blocks:
            d = b[alive] - query[seen : seen + b.shape[1]]
            sums = sums + np.einsum("ij,ij->i", d, d)
            seen += b.shape[1]
            keep = ~abandon(sums, seen, of, float(best[-1]) + 1e-5)
            alive, sums = alive[keep], sums[keep]
            if not len(alive):
                break
        if len(alive):
            left.append(alive)
            distance.append(sums)
            best = np.sort(np.concatenate([best, sums]))[:k]
    if not left:
        return np.zeros(0, dtype=np.int64)
    left, distance = np.concatenate(left), np.concatenate(distance)
    return left[distance <= best[-1] + 1e-5]


FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
#: Groups in which the results of a query's parts are merged first.
PIECES = 64


class Part:
    """The vectors of a part, all of one length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rotation: np.ndarray | None):
        self.ids, self.x, self.norms = ids, x, np.sqrt((x * x).sum(axis=1))
        self.rotation, self.blocks = rotation, []
        if rotation is not None:
            turned = (x / self.norms[:, None]).astype(np.float32) @ rotation
            self.blocks = [np.ascontiguousarray(turned[:, i : i + BLOCK]) for i in range(0, turned.shape[1], BLOCK)]
        self.order = np.argsort(ids, kind="stable")
        self.sorted = ids[self.order]
        new = np.flatnonzero(np.r_[True, self.sorted[1:] != self.sorted[:-1]])
        self.repeats = int(np.diff(np.r_[new, len(ids)]).max())  # rows of one id, at most

    def best(self, q_id: int, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query, vector, score) of the k nearest other ids that are found."""
        own = self.order[np.searchsorted(self.sorted, q_id) : np.searchsorted(self.sorted, q_id, side="right")]
        norm = np.sqrt((q * q).sum())
        if self.rotation is None:
            at = np.setdiff1d(np.arange(len(self.ids)), own)
        else:
            at = scan((q / norm).astype(np.float32) @ self.rotation, self.blocks, k * self.repeats, own if len(own) else None)
        score = (self.x[at] * q).sum(axis=1) / (self.norms[at] * norm)
        found: dict[int, float] = {}
        for i in np.lexsort((self.ids[at], -score)).tolist():
            found.setdefault(int(self.ids[at[i]]), float(score[i]))
            if len(found) == k:
                break
        return [(q_id, v, c) for v, c in found.items()]


def _search(index, k: int):
    """Rows in order of (list, part, query or not): the vectors of a part, then its queries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, part = None, [], None
        for b in batches:
            lists, parts, asks, ids = (b.column(c).to_numpy(zero_copy_only=False) for c in ("list", "part", "asks", "id"))
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (lists[1:] != lists[:-1]) | (parts[1:] != parts[:-1]) | (asks[1:] != asks[:-1])
            cuts, out = [*np.flatnonzero(new).tolist(), len(ids)], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if at != (lists[lo], parts[lo]):
                    at, held, part = (lists[lo], parts[lo]), [], None
                x = b.column("vector").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                if not asks[lo]:
                    held.append((ids[lo:hi], x))
                elif held:
                    if part is None:
                        part = Part(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), index.value.rotation if at[0] >= 0 else None)
                    for q_id, q in zip(ids[lo:hi].tolist(), x, strict=True):
                        out += [(*row, (int(at[0]) * 31 + int(at[1])) % PIECES) for row in part.best(q_id, q, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], names=["query_id", "vec_id", "score", "piece"])

    return work


def _best(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k nearest ids of each key, as ``_best``: an array of (negative score, id, score) in order."""
    each = found.groupBy(*keys, "vec_id").agg(F.max("score").alias("score"))
    return each.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_s"), "vec_id", "score"))), 1, k).alias("_best"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of the k nearest found of each query; both tables hold key and vector."""
    spark = vectors.sparkSession
    # Equal rows go before anything is dealt by id, however many there are.
    prepared = [t.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).distinct() for t in (vectors, queries)]
    with Scratch(spark) as scratch:
        all_rows = scratch.written(prepared[0], "vectors")
        rows = all_rows.count()
        sample = all_rows.orderBy(F.xxhash64("id"), "id", "vector").limit(SAMPLE).toPandas()
        if not rows:
            return spark.createDataFrame([], T.StructType([*FOUND[:1], T.StructField("rank", T.IntegerType()), *FOUND[1:]]))
        columns = int(sample["vector"].map(len).mode()[0])
        index = Index(np.stack([v for v in sample["vector"] if len(v) == columns]).astype(np.float64), rows)
        fitted = spark.sparkContext.broadcast(index)  # LISTS + columns rows at most

        @F.pandas_udf(T.IntegerType())
        def list_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                out = -v.map(len).to_numpy(dtype=np.int32)
                same = out == -columns
                if same.any():
                    out[same] = nearest(unit(np.stack(v.to_numpy()[same])), fitted.value.centroids)[:, 0]
                yield pd.Series(out, dtype="int32")

        placed = scratch.written(all_rows.withColumn("list", list_of("vector")), "vectors-placed")
        sizes = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # LISTS, and one a length
        known = [i for i in sizes if i >= 0]
        index.sizes[known] = [sizes[i] for i in known]
        sized = spark.sparkContext.broadcast(index)
        parts = F.create_map(*[F.lit(x) for i, n in sorted(sizes.items()) for x in (i, -(-n // PART))])

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def lists_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in batches:
                out = [[-len(q)] for q in v]
                same = [i for i, q in enumerate(v) if len(q) == columns]
                if same:
                    for i, lists in zip(same, sized.value.probes(unit(np.stack([v.iloc[i] for i in same]))), strict=True):
                        out[i] = lists.tolist()
                yield pd.Series(out, dtype=object)

        candidates = placed.select("list", F.pmod(F.xxhash64("id", "vector"), parts[F.col("list")]).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "vector")
        routed = prepared[1].select("id", "vector", F.explode(lists_of("vector")).alias("list")).withColumn("_n", parts[F.col("list")]).where("_n is not null")
        routed = routed.select("list", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "vector")
        both = candidates.unionByName(routed).repartition("list", "part").sortWithinPartitions("list", "part", "asks")
        found = both.mapInArrow(_search(fitted, k), T.StructType([*FOUND, T.StructField("piece", T.IntegerType())]))
        pieces = _best(found, k, "query_id", "piece").select("query_id", F.inline("_best")).select("query_id", "vec_id", "score")
        best = _best(pieces, k, "query_id").select("query_id", F.posexplode("_best").alias("_rank", "_x"))
        return scratch.keep(scratch.written(best.select("query_id", (F.col("_rank") + 1).alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score")), "nearest"))


def op5_vector_search(spark, sf_dir):
    """The 5 nearest by cosine, of all other embeddings, for each whose vec_id is divisible by 50."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 50 = 0"))
