"""Vector code compression: product quantisation in whole numbers, with a trie over distinct parts.

Every component x becomes floor(1024 * x); a vector is cut into PARTS equal consecutive parts. The codebook of a part position starts
as that part of the ENTRIES rows with the smallest ids. A round assigns every part to its nearest entry and moves each entry to the
floored mean of its parts; unused entries stay. After the last round all parts are assigned again.

The rounds run over a table of the distinct parts of each position with the number of their rows, so copies cost nothing, however
many there are. It is dealt by ranges and sorted, so a task walks a lexicographic trie of its parts depth first: the distances of a
prefix to all entries are summed up once and shared by all parts that begin with it. A subtree of at most LEAVES parts is
evaluated level by level, one row of distances a trie node; at the leaves the nearest entry is taken and the weighted sums of each entry
are kept. A task gives ENTRIES rows a position; they are summed by Spark, and only the sums (PARTS x ENTRIES rows) reach the driver.
The last assignment walks such a trie over each Arrow batch, so that no row is shuffled for its code.

All arithmetic is exact: on 32-bit or 64-bit numbers where the largest component and the number of rows allow it, else on Python's.

Defined results: rows whose vector is null or holds null or non-finite components are left out; vectors shorter than the longest
count as extended by zeros, and all as extended to a multiple of PARTS; with fewer rows than ENTRIES the codebooks are
as small; rows with a null id come last for the first entries and are coded like all others; rows of one id are ordered
by their vector; repeated rows count and are returned each; an error that does not fit 64 bits is null, and so is a sum of errors with such a one or beyond 64
bits itself; null labels are one label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import Scratch, read_table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts of a subtree that are evaluated level by level.
LEAVES = 512


def finite(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def floored(vector: Column, width: int) -> Column:
    """floor(SCALE * x) / SCALE of each component, extended by zeros to the width; exact in doubles, as SCALE is a power of two."""
    step = F.transform(vector.cast("array<double>"), lambda x: F.when(F.abs(x) < 2.0**42, F.floor(x * SCALE).cast("double") / SCALE).otherwise(x))
    return F.concat(step, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(vector)))


def kind_of(largest: float, length: int) -> type:
    """The numbers in which squared distances of parts of a length are exact, by the largest absolute component."""
    most = length * (2 * (largest * SCALE + 1)) ** 2
    return np.int32 if most < 2**31 else np.int64 if most < 2**62 else object


def whole(values: np.ndarray, kind: type) -> np.ndarray:
    """Floored components as whole numbers."""
    if kind is object:
        as_int = np.frompyfunc(lambda x: int(x) * SCALE if abs(x) >= 2.0**42 else int(x * SCALE), 1, 1)
        return as_int(values).astype(object) if values.size else values.astype(object)
    return np.rint(values * SCALE).astype(kind)


def in_order(parts: np.ndarray) -> np.ndarray:
    """Places of the rows in lexicographic order."""
    return np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))


def walk(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (ties to the lower index) and its squared distance for each of the distinct parts, which are in lexicographic order."""
    n, depth = parts.shape
    best, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=parts.dtype)
    columns = np.ascontiguousarray(entries.T)  # a row of all entries' components at each depth

    def subtree(lo: int, hi: int, at: int, shared: np.ndarray) -> None:
        """Nodes of one depth after another; `node` is the node of each part."""
        sums, node = shared[None, :], np.zeros(hi - lo, dtype=np.int64)
        for d in range(at, depth):
            value = parts[lo:hi, d]
            new = np.ones(hi - lo, dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])
            first = np.flatnonzero(new)
            step = value[first][:, None] - columns[d][None, :]
            sums = sums[node[first]] + step * step
            node = np.cumsum(new) - 1
        nearest = np.argmin(sums, axis=1)
        best[lo:hi], distance[lo:hi] = nearest[node], sums[np.arange(len(sums)), nearest][node]

    stack = [(0, n, 0, np.zeros(len(entries), dtype=parts.dtype))] if n else []
    while stack:  # depth first; a node waits with the sums of its prefix
        lo, hi, at, shared = stack.pop()
        if hi - lo <= LEAVES or at == depth:
            subtree(lo, hi, at, shared)
            continue
        value = parts[lo:hi, at]
        cuts = [lo, *(lo + 1 + np.flatnonzero(value[1:] != value[:-1])).tolist(), hi]
        # Neighbouring small children are one piece of at most LEAVES parts, whose nodes at this depth are told apart in it.
        begin = lo
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - begin > LEAVES and a > begin:
                subtree(begin, a, at, shared)
                begin = a
            if b - begin > LEAVES:
                step = parts[begin, at] - columns[at]
                stack.append((begin, b, at + 1, shared + step * step))
                begin = b
        if begin < hi:
            subtree(begin, hi, at, shared)
    return best, distance


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), width) if width else np.zeros((len(column), 0))


def distinct_parts(vectors: DataFrame, width: int) -> DataFrame:
    """``position``, ``part`` and ``n``, its rows: counted before any shuffle, then dealt by ranges and in order."""
    length = width // PARTS
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.slice("_vector", p * length + 1, length).alias("part")) for p in range(PARTS))))
    counted = vectors.select(each.alias("_p")).groupBy("_p.position", "_p.part").agg(F.count("*").alias("n"))
    return counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part")


def round_sums(parts: DataFrame, books: list[np.ndarray], kind: type, length: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(rows, componentwise sums) of each entry in use, by (position, entry)."""
    held = parts.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES entries at most

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            position, n = b.column("position").to_numpy(), b.column("n").to_numpy()
            values = whole(_matrix(b.column("part"), length), kind)
            for p in np.unique(position):
                own = position == p
                x, weight = values[own], n[own].astype(object if kind is object else np.int64)
                if p not in total:
                    zero = object if kind is object else np.int64
                    total[p] = np.zeros(len(held.value[p]), dtype=np.int64), np.zeros((len(held.value[p]), length), dtype=zero)
                code, _ = walk(x, held.value[p])
                np.add.at(total[p][0], code, n[own])
                np.add.at(total[p][1], code, x.astype(weight.dtype) * weight[:, None])
        rows = [(int(p), e, int(n), [str(v) for v in sums[e]] if kind is object else sums[e].tolist()) for p, (ns, sums) in total.items() for e, n in enumerate(ns) if n]
        names = ["position", "entry", "n", "sums"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string() if kind is object else pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, types, strict=True)], names=names)

    of = "string" if kind is object else "bigint"
    found = parts.mapInArrow(summed, f"position int, entry int, n bigint, sums array<{of}>")
    if kind is object:  # numbers of any size: strings, summed in pieces of the tasks and then as a whole
        def together(rows: pd.DataFrame) -> pd.DataFrame:
            sums = [str(sum(map(int, c))) for c in zip(*rows["sums"], strict=True)]
            return pd.DataFrame({"position": rows["position"][:1].to_numpy(), "entry": rows["entry"][:1].to_numpy(), "n": [int(rows["n"].sum())], "sums": [sums]})

        schema = "position int, entry int, n bigint, sums array<string>"
        found = found.groupBy("position", "entry", (F.spark_partition_id() % 256).alias("_piece")).applyInPandas(together, schema)
        found = found.groupBy("position", "entry").applyInPandas(together, schema)
        return {(r["position"], r["entry"]): (r["n"], [int(v) for v in r["sums"]]) for r in found.collect()}
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(length)]
    return {(r[0], r[1]): (r[2], [int(v) for v in r[3:]]) for r in found.groupBy("position", "entry").agg(F.sum("n"), *sums).collect()}


def moved(books: list[np.ndarray], sums: dict[tuple[int, int], tuple[int, list[int]]]) -> list[np.ndarray]:
    """The codebooks after a round: floored means, unused entries as they were."""
    books = [b.copy() for b in books]
    for (p, e), (n, total) in sums.items():
        books[p][e] = [v // n for v in total]
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``_key``, ``_label``, ``code`` (a byte a part as two hex digits) and ``error`` of each kept row, and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: entries must be from 1 to 256")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{label}`").alias("_label"), F.col(f"`{vector}`").alias("_vector")).where(finite(F.col("_vector")))
    of = rows.agg(F.max(F.size("_vector")), F.max(F.array_max(F.transform("_vector", F.abs)))).first()
    width, largest = -(-(of[0] or 0) // PARTS) * PARTS, float(of[1] or 0)
    length = width // PARTS
    kind = kind_of(largest, length)
    rows = rows.withColumn("_vector", floored(F.col("_vector"), width))
    first = rows.select("_key", "_vector").orderBy(F.col("_key").asc_nulls_last(), "_vector").limit(entries).collect()  # ENTRIES rows at most
    start = whole(np.array([r["_vector"] for r in first], dtype=np.float64).reshape(len(first), width), kind)
    books = [start[:, p * length : (p + 1) * length] for p in range(PARTS)]
    with Scratch(spark) as scratch:
        if first and length:
            parts = scratch.written(distinct_parts(rows, width), "vector-parts")
            for _ in range(rounds):
                books = moved(books, round_sums(parts, books, kind, length))
    held = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = whole(_matrix(b.column("_vector"), width), kind)
            code, error = np.zeros((len(values), PARTS), dtype=np.uint8), np.zeros(len(values), dtype=object if kind is object else np.int64)
            for p in range(PARTS if len(values) else 0):
                x = values[:, p * length : (p + 1) * length]
                order = in_order(x)
                x = x[order]
                new = np.ones(len(x), dtype=bool)
                new[1:] = (x[1:] != x[:-1]).any(axis=1) if length else False
                at, distance = walk(x[new], held.value[p])
                leaf = np.cumsum(new) - 1
                code[order, p] = at[leaf]
                error[order] += distance[leaf]
            texts = [code[i].tobytes().hex() for i in range(len(code))]
            fits = pa.array([int(e) if e < 2**63 else None for e in error.tolist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_label"), pa.array(texts, type=pa.string()), fits], names=["_key", "_label", "code", "error"])

    schema = T.StructType([rows.schema["_key"], rows.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.mapInArrow(coded, schema), books


def books_text(books: list[np.ndarray]) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(int(v)) for b in books for e in b for v in e)


def op13_vector_codes(spark, sf_dir):
    """Code, error, error of the label and the codebooks' digest of every kept row of ``embeddings``."""
    found, books = compress(read_table(spark, sf_dir, "embeddings"))
    found = written(found, "vector-codes")  # read for the sums and for the rows
    # A label's sum is added up before the shuffle; the join may split a label that holds many rows.
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy(F.col("_label").alias("_of")).agg(F.when(F.count("*") == F.count("error"), F.when(total < 2.0**63, total)).cast("long").alias("label_error"))
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    joined = found.join(sums, F.col("_label").eqNullSafe(F.col("_of")), "left")
    return joined.select(F.col("_key").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(length: int = 16) -> str:
    """SQL of the same for vectors of PARTS x length components."""
    assign = """a{r} AS MATERIALIZED (SELECT vec_id, p, arg_min(e, k) AS e, min(k).d AS d FROM (SELECT x.vec_id, x.p, c.e,
    {{'d': CAST(list_sum(list_transform(list_zip(x.part, c.part), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'e': c.e}} AS k FROM parts x JOIN c{r} c USING (p)) GROUP BY vec_id, p)"""
    move = """m{r} AS (SELECT p, e, i, CAST(floor(sum(v)::DOUBLE / count(*)) AS BIGINT) AS v FROM (SELECT a.p, a.e, unnest(range(1, {length} + 1)) AS i, unnest(x.part) AS v FROM a{r} a JOIN parts x USING (vec_id, p)) GROUP BY p, e, i),
c{s} AS MATERIALIZED (SELECT c.p, c.e, coalesce(any_value(m.part), any_value(c.part)) AS part FROM c{r} c LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS part FROM m{r} GROUP BY p, e) m USING (p, e) GROUP BY c.p, c.e)"""
    steps = []
    for r in range(ROUNDS):
        steps += [assign.format(r=r), move.format(r=r, s=r + 1, length=length)]
    steps.append(assign.format(r=ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * {length} + 1 : (p + 1) * {length}] AS part FROM kept, range({PARTS}) t(p)),
c0 AS MATERIALIZED (SELECT p, CAST(e AS BIGINT) AS e, part FROM (SELECT p, part, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < {ENTRIES}),
{("," + chr(10)).join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, (SELECT h FROM book) AS codebooks_sha256
FROM kept k JOIN coded USING (vec_id)
"""


SQL = _sql()
