"""N-gram Jaccard join by T-occurrence search.

A document's set holds 64-bit hashes of its distinct word shingles. Two sets of sizes a and b with a Jaccard
similarity of at least t share at least T = ceil(t / (1 + t) * (a + b)) elements, so at most D elements stand in one of them only.

1. Documents with equal sets are one class, so exact copies cost nothing further. A class's text is kept
   compressed, and its set is made from it where it is needed; that is a third of the set's bytes.
2. A class signs parts of its set: elements are dealt to P > D parts by hash, and similar sets have equal parts but for D. Parts
   are ranked by their elements that are not frequent in a sample (the sample only makes it faster); the first
   of the equal parts stands among the D + 1 first of either set, so a class signs only these. In small sets every element is
   a part. P depends on the size, in ranges of sizes; a class signs for the range of every size of a smaller set that may be similar.
3. Classes that share a signature are candidates. A task keeps the first class of a signature and notes later classes as that one's
   neighbours, so a signature leaves a task once, however many copies there are; across tasks all go to the smallest class.
   A class and its neighbours are joined in one shard, by an inverted index in which each is a query. Components of these links
   become labels.
4. Then every signature that still has several labels is settled: of two labels the one with fewer classes is searched in
   the index of the other's classes, in shards of a bounded size; a signature with very many labels is joined in blocks, each
   with each. Nothing is left out, so the result is exact whatever step 3 found.
5. Components of the links come from rounds of minima over neighbours and labels, written to the shared folder. All tables
   but those that the result reads are deleted.

Search in a shard (DivideSkip): the query's LONG longest lists are set aside; its other lists are merged, and a
class that stands in at least T - L of them (L lists set aside) is probed by binary search in the L long ones.

Defined results: null, empty and wordless texts have an empty set, link with nothing and are components of
their own; a text with fewer words than a shingle has one shingle, all its words; texts of any length are taken whole; rows are kept one
for one, also repeated ones; a component's id is the smallest key in it, null only where all keys are null; other columns,
whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import Scratch, text_batches, written

#: Documents of the sample for the order: about SAMPLE_MOST; elements in SEEN of them are frequent, the LAST most frequent count.
SAMPLE_MOST, SEEN, LAST = 10_000, 3, 100_000
#: Neighbours that a class takes in a task; then a later class takes over.
NEIGHBOURS = 500
#: Candidates of a shard, and bytes of their packed texts, on average.
SHARD, SHARD_BYTES = 1_500, 4_000_000
#: Labels of a signature that are searched pair by pair; with more, its classes are joined in blocks.
LABELS = 30
#: Classes whose ids are broadcast to pick their texts; more are joined by shuffle.
BROADCAST_CLASSES = 1_000_000
#: Signatures, and classes, that a task remembers, and words that a worker has hashed; beyond them it starts anew.
REMEMBERED, WORDS = 60_000, 20_000
#: Ranges of sizes: each ends before the next number, half as large again.
EDGES = [1]
while EDGES[-1] < 1 << 40:
    EDGES.append(max(EDGES[-1] + 1, EDGES[-1] * 3 // 2))
#: Longest lists of a query that are probed, not merged.
LONG = 8
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles (A-Z in lower case; words are cut at ASCII white space)."""
    words = text.encode("utf-8", "ignore").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    n = min(n, len(words))
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.full(len(h) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = _final(out * _MIX[0] + h[i : len(h) - n + 1 + i] + _MIX[1])
    return np.unique(out.view(np.int64))


def _pack(text: str, pack: zstandard.ZstdCompressor) -> bytes:
    return pack.compress(text.encode("utf-8", "ignore"))


def _unpack(packed, n: int) -> Iterator[np.ndarray]:
    """The sets of packed texts, one at a time."""
    unpack = zstandard.ZstdDecompressor()
    return (shingles(unpack.decompress(z).decode(), n) for z in packed)


def signatures(s: np.ndarray, avoid: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the parts that the set signs; sets that are similar but not equal share one at least."""
    size, out = len(s), []
    if not size:
        return s
    mixed = _final(s.view(np.uint64) ^ _MIX[0])
    at = np.minimum(np.searchsorted(avoid, s), max(0, len(avoid) - 1))
    rare = avoid[at] != s if len(avoid) else np.ones(size, dtype=bool)
    own = bisect_right(EDGES, size) - 1
    for w in range(bisect_right(EDGES, -(-num * size // den)) - 1, own + 1):
        high = EDGES[w + 1] - 1  # largest size of the smaller set
        apart = (size + (size * den // num if w == own else high)) * (den - num) // (num + den)
        if not apart:
            continue  # only an equal set is similar
        most = (high + high * den // num) * (den - num) // (num + den)
        parts = most + 1 + (most + 1) // 4
        if high < 3 * parts:
            first = np.lexsort((s, ~rare))[: apart + 1]
            signed = mixed[first]
        else:
            part = (mixed % np.uint64(parts)).astype(np.int64)
            first = np.argsort(-np.bincount(part, weights=rare, minlength=parts), kind="stable")[: apart + 1]
            sums = np.zeros(parts, dtype=np.uint64)
            np.add.at(sums, part, mixed)
            signed = sums[first] + first.astype(np.uint64) * _MIX[2]
        out.append(_final(signed * _MIX[1] + np.uint64(w + 1)))
    return np.unique(np.concatenate(out).view(np.int64)) if out else s[:0]


ROWS = [T.StructField("size", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("x", T.LongType()), T.StructField("z", T.BinaryType())]
ROWS += [T.StructField("fresh", T.ArrayType(T.LongType())), T.StructField("signed", T.ArrayType(T.LongType())), T.StructField("near", T.ArrayType(T.LongType()))]


def shingle_sets(docs: DataFrame, key: str, text: str, n: int, num: int, den: int, avoid) -> DataFrame:
    """``_key``, ``size`` of the set, ``class`` (a 128-bit hash of the set, null if empty), and where the task has not met the class before:
    ``x`` (64 bits of the class), the packed text ``z``, the signatures (``fresh``: those new to the task, ``signed``: the others)
    and ``near``, the classes of the task that share one of them."""
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), *ROWS])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, met = zstandard.ZstdCompressor(level=1), set()
        first: dict[int, int] = {}
        taken: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for t in batch.column(1).to_pylist():
                s = shingles(t, n)
                if not len(s):
                    rows.append((0, None, None, None, None, None, None))
                    continue
                c = xxhash.xxh3_128_digest(s.tobytes())
                if c in met:
                    rows.append((len(s), c, None, None, None, None, None))
                    continue
                if len(met) > REMEMBERED:
                    met.clear()
                if len(first) > REMEMBERED:
                    first, taken = {}, {}
                met.add(c)
                x = int.from_bytes(c[:8], "little", signed=True)
                fresh, signed, near = [], [], set()
                for g in signatures(s, avoid.value, num, den).tolist():
                    other = first.get(g)
                    if other is None:
                        first[g] = x
                        fresh.append(g)
                        continue
                    signed.append(g)
                    near.add(other)
                    if taken.get(other, 0) >= NEIGHBOURS:
                        first[g] = x
                for other in near:
                    taken[other] = taken.get(other, 0) + 1
                rows.append((len(s), c, x, _pack(t, pack), fresh, signed, sorted(near - {x})))
            columns = list(zip(*rows, strict=True)) or [[]] * len(ROWS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(columns, KINDS, strict=True))], names=schema.names)

    return docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).mapInArrow(sets, schema)


KINDS = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]


def needed(a, b, num: int, den: int):
    """Elements that sets of sizes a and b must share: ceil(num / (num + den) * (a + b))."""
    return -((-num * (a + b)) // (num + den))


def _starts(flat: np.ndarray) -> np.ndarray:
    """Where a run of equal numbers begins."""
    out = np.ones(len(flat), dtype=bool)
    np.not_equal(flat[1:], flat[:-1], out=out[1:])
    return out


def _shared(flat: np.ndarray) -> np.ndarray:
    """Which elements stand there more than once."""
    order = np.argsort(flat, kind="stable")
    starts = _starts(flat[order])
    out = np.empty(len(flat), dtype=bool)
    out[order] = ~(starts & np.append(starts[1:], True))
    return out


class Shard:
    """An inverted index over some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
        order = np.argsort(flat, kind="stable")
        self.owner, flat = np.repeat(np.arange(len(sets)), self.sizes)[order], flat[order]
        first = np.flatnonzero(_starts(flat))
        self.elements, self.bounds = flat[first], np.append(first, len(flat))

    def search(self, query: np.ndarray, num: int, den: int, skip: np.ndarray | None = None) -> np.ndarray:
        """The sets that reach the overlap with the query; those where ``skip`` holds aren't searched."""
        size = len(query)
        if not size or not len(self.elements):
            return np.zeros(0, dtype=np.int64)
        at = np.searchsorted(self.elements, query)
        at[at == len(self.elements)] = 0
        at = at[self.elements[at] == query]
        smallest = -((-num * size) // den)  # of a similar set, and of the overlap with it
        if len(at) < smallest:
            return np.zeros(0, dtype=np.int64)
        lengths = self.bounds[at + 1] - self.bounds[at]
        at = at[np.argsort(lengths, kind="stable")]
        aside = min(LONG, smallest - 1)
        short, long_ = (at[: len(at) - aside], at[len(at) - aside :]) if aside else (at, at[:0])
        lists = [self.owner[self.bounds[i] : self.bounds[i + 1]] for i in short]
        count = np.bincount(np.concatenate(lists), minlength=len(self.sizes)) if lists else np.zeros(len(self.sizes), dtype=np.int64)
        need = needed(size, self.sizes, num, den)
        good = (count >= need - len(long_)) & (self.sizes >= smallest) & (self.sizes * num <= size * den)
        if skip is not None:
            good &= ~skip
        found = np.flatnonzero(good)
        if len(found):
            total = count[found]
            for i in long_:
                members = self.owner[self.bounds[i] : self.bounds[i + 1]]
                place = np.searchsorted(members, found)
                place[place == len(members)] = 0
                total = total + (members[place] == found)
            found = found[total >= need[found]]
        return found


def join_shard(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Each set's component within the shard, as the index of a set."""
    label = np.arange(len(sets))
    live = np.arange(len(sets))
    while True:  # a set that shares too few of its elements with any other links with nothing
        flat = np.concatenate([sets[i] for i in live]) if len(live) else np.zeros(0, dtype=np.int64)
        sizes = np.array([len(sets[i]) for i in live], dtype=np.int64)
        shared = np.add.reduceat(_shared(flat), np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64) if len(flat) else sizes
        del flat  # the index makes its own
        keep = shared * den >= sizes * num
        if keep.all():
            break
        live = live[keep]
    if len(live) < 2:
        return label
    index = Shard([sets[i] for i in live])
    own = np.arange(len(live))
    for q in range(len(live)):
        for other in index.search(sets[live[q]], num, den, skip=own == own[q]):
            if own[other] != own[q]:
                low, high = sorted((own[other], own[q]))
                own[own == high] = low
    label[live] = live[own]
    return label


LINKS = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])


def _within(n: int, num: int, den: int):
    """Rows (class, z) of a shard -> a link from each class to the smallest of its component in the shard."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("class").sort_values("class", ignore_index=True)
        names, low = rows["class"].to_numpy(), join_shard(list(_unpack(rows["z"], n)), num, den)
        linked = low != np.arange(len(names))
        return pd.DataFrame({"a": names[linked], "b": names[low[linked]]})

    return work


def _across(n: int, num: int, den: int):
    """Classes of an index and queries, each with its label -> links between their labels."""

    def work(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = set()
        if len(index) and len(queries):
            shard, (names, codes) = Shard(list(_unpack(index["z"], n))), np.unique(index["label"].to_numpy(), return_inverse=True)
            code_of = {name: i for i, name in enumerate(names)}
            for query, a in zip(_unpack(queries["_z"], n), queries["_label"], strict=True):
                found = shard.search(query, num, den, skip=codes == code_of[a] if a in code_of else None)
                out.update((a, names[b]) for b in np.unique(codes[found]))
        return pd.DataFrame(sorted(out), columns=["a", "b"])

    return work


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, of every node in the links (columns a and b).

    Each round, a node's label becomes the smallest label of its neighbours' labels, then the label's own
    label. Rounds end when nothing changes; there are about as many as the log of the longest path.
    """
    both = scratch.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), name)
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), name)
    while True:
        met = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_met")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_met").alias("_met"))
        low = labels.join(met, "node").select("node", F.least("label", "_met").alias("_low"), F.col("label").alias("_old"))
        jump = labels.select(F.col("node").alias("_low"), F.col("label").alias("_jump"))
        new = scratch.written(low.join(jump, "_low", "left").select("node", F.least("_low", F.coalesce("_jump", "_low")).alias("label"), "_old"), name)
        scratch.drop(labels)
        labels = new
        if not new.where("label <> _old").limit(1).count():
            scratch.drop(both)
            return new.select("node", "label")


def _frequent(docs: DataFrame, key: str, text: str, n: int) -> list[int]:
    """Elements that are frequent in a bounded sample of the documents."""

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch["text"]]
            if sets:
                yield pd.DataFrame({"element": np.concatenate(sets)})

    part = SAMPLE_MOST / max(1, docs.count())
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "key", "text"), F.lit(1_000_000)) < int(part * 1_000_000)).select("text")
    counts = sample.mapInPandas(elements, T.StructType([T.StructField("element", T.LongType())])).groupBy("element").agg(F.count("*").alias("_n"))
    return [r["element"] for r in counts.where(F.col("_n") >= SEEN).orderBy(F.desc("_n"), "element").limit(LAST).collect()]


def _few(df: DataFrame) -> DataFrame:
    """A table of ids to join with: broadcast if it has BROADCAST_CLASSES rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df


def _cut(n: Column) -> Column:
    """Parts for n neighbours: a power of two, so that signatures of like sizes agree."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), n / NEIGHBOURS)))).cast("long")


def _near(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Neighbours (rep, x) that tasks have met, with the part of the rep: a class that many tasks hold has many neighbours, which are cut like those of a signature.

    They are counted before any shuffle, and only the classes with more than NEIGHBOURS of them are joined with.
    """
    hot = scratch.written(pairs.groupBy("rep").agg(F.count("*").alias("_n")).where(F.col("_n") > NEIGHBOURS), "jaccard-hot")
    joined = pairs.join(_few(hot), "rep", "left")
    return joined.select("rep", F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("x"), _cut(F.col("_n")))).cast("long").alias("part"), "x")


def link_classes(rows: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """``class`` and ``label`` (a class of its component, the same for all) of the linked classes of the rows of shingle_sets(); None if nothing may be linked."""
    texts = rows.where("z is not null")
    spread = texts.select("x", F.explode("fresh").alias("sig"))
    w = Window.partitionBy("sig")
    star = spread.select("x", F.min("x").over(w).alias("rep"), F.count("*").over(w).alias("_n")).where("x <> rep")
    star = star.select("rep", F.pmod(F.xxhash64("x"), _cut(F.col("_n"))).alias("part"), "x")
    pairs = scratch.written(star.union(_near(texts.select(F.explode("near").alias("rep"), "x"), scratch)).distinct(), "jaccard-pairs")
    count = pairs.count()
    if not count:
        return None
    size = texts.agg(F.avg(F.length("z"))).first()[0]
    shards = max(-(-count // SHARD), int(count * size / SHARD_BYTES) + 1)
    shard = F.pmod(F.xxhash64("rep", "part"), F.lit(shards)).alias("shard")
    members = scratch.written(pairs.select(shard, "x").union(pairs.select(shard, F.col("rep").alias("x"))).distinct(), "jaccard-members")
    live = _few(scratch.written(members.select("x").distinct(), "jaccard-live"))
    texts = scratch.written(texts.join(live, "x", "left_semi").select("class", "x", "z", F.concat("fresh", "signed").alias("signed")).dropDuplicates(["class"]), "jaccard-texts")
    joined = texts.select("class", "x", "z").join(_few(members), "x").groupBy("shard").applyInPandas(_within(n, num, den), LINKS)
    found = components(scratch.written(joined, "jaccard-links"), scratch).select(F.col("node").alias("class"), "label")
    marks = texts.select("class", "x", "signed", F.length("z").alias("bytes")).join(found, "class", "left").withColumn("label", F.coalesce("label", "class"))
    marks = scratch.written(marks, "jaccard-marks")
    left = _unsettled(marks, texts.select("class", "z"), n, num, den, scratch)
    if left is None:
        return found
    met = components(left, scratch).select(F.col("node").alias("label"), F.col("label").alias("_new"))
    return marks.select("class", "label").join(met, "label", "left").select("class", F.coalesce("_new", "label").alias("label"))


def _unsettled(marks: DataFrame, texts: DataFrame, n: int, num: int, den: int, scratch: Scratch) -> DataFrame | None:
    """Links (a, b) between labels that share a signature; None if no signature has several labels."""
    posts = marks.select("class", "label", "bytes", F.explode("signed").alias("sig"))
    hashed = marks.select(F.xxhash64("label").alias("_l"), F.explode("signed").alias("sig"))
    several = hashed.groupBy("sig").agg(F.min("_l").alias("_low"), F.max("_l").alias("_high")).where("_low <> _high").select("sig")
    several = scratch.written(several, "jaccard-open")
    if not several.limit(1).count():
        return None
    posts = scratch.written(posts.join(_few(several), "sig"), "jaccard-posts")
    sizes = marks.groupBy("label").agg(F.count("*").alias("size"))
    by_label = posts.groupBy("sig", "label").agg(F.count("*").alias("_n"), F.sum("bytes").alias("_b"), F.sum(F.xxhash64("class").cast("decimal(20,0)")).alias("_h"))
    counts = scratch.written(by_label.groupBy("sig").agg(F.count("*").alias("labels"), F.sum("_n").alias("rows"), F.sum("_b").alias("bytes"), F.xxhash64(F.sum("_h"), F.sum("_n")).alias("group")), "jaccard-counts")
    many = counts.where(F.col("labels") > LABELS).groupBy("group").agg(F.min("sig").alias("sig"), F.max("rows").alias("rows"), F.max("bytes").alias("bytes"))  # signatures of the same classes are one group
    few = by_label.join(counts.where(F.col("labels") <= LABELS).select("sig"), "sig").join(sizes, "label").select("sig", "label", "size")
    few = scratch.written(few, "jaccard-few")

    # Pair by pair: the classes of a label are asked for in each larger label of their signatures.
    larger = few.select("sig", F.col("label").alias("target"), F.col("size").alias("_size"))
    ahead = few.join(larger, "sig").where("struct(size, label) < struct(_size, target)").select("sig", "label", "target")
    ask = scratch.written(posts.join(ahead, ["sig", "label"]).select("target", "class", "bytes").distinct(), "jaccard-ask")
    held = scratch.written(posts.join(ahead.select("sig", F.col("target").alias("label")).distinct(), ["sig", "label"]).select(F.col("label").alias("target"), "class", "bytes").distinct(), "jaccard-held")
    # An index has SHARD classes and SHARD_BYTES of their texts, its queries four times as many.
    cut = lambda rows, size, times: F.ceil(F.greatest(rows / (times * SHARD), size / (times * SHARD_BYTES)))
    share = lambda times: cut(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0)), times)
    places = max(1, *(t.agg(share(times)).first()[0] for t, times in ((held, 1), (ask, 4))))
    shape = held.groupBy("target").agg(share(1).alias("blocks")).join(ask.groupBy("target").agg(share(4).alias("parts")), "target")
    shape = scratch.written(shape, "jaccard-shape")
    place = F.when((F.col("blocks") == 1) & (F.col("parts") == 1), F.pmod(F.xxhash64("target"), F.lit(places))).otherwise(F.xxhash64("target", "_block", "_part")).alias("place")
    to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("class"), F.col(c))
    index = held.join(shape, "target").withColumn("_block", own("blocks")).withColumn("_part", to("parts")).select("class", place)
    asked = ask.join(shape, "target").withColumn("_part", own("parts")).withColumn("_block", to("blocks")).select("class", place)
    known = scratch.written(texts.join(_few(scratch.written(ask.select("class").union(held.select("class")).distinct(), "jaccard-known")), "class", "left_semi").join(_few(marks.select("class", "label")), "class"), "jaccard-asked")
    index = known.join(index.distinct(), "class").select("place", "class", "label", "z")
    asked = known.join(asked.distinct(), "class").select(*(F.col(c).alias(f"_{c}") for c in ("place", "class", "label", "z")))
    links = index.groupBy("place").cogroup(asked.groupBy("_place")).applyInPandas(_across(n, num, den), LINKS)
    links = scratch.written(links, "jaccard-across")
    if not many.limit(1).count():
        return links

    # In blocks: every class of the group meets every other one in some shard.
    blocks = posts.drop("bytes").join(many, "sig").select("class", "group", cut(F.col("rows"), F.col("bytes"), 1).alias("blocks")).withColumn("_own", own("blocks")).withColumn("_other", to("blocks"))
    shard = F.xxhash64("group", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("shard")
    joined = texts.join(blocks.select("class", shard), "class").groupBy("shard").applyInPandas(_within(n, num, den), LINKS)
    label = marks.select("class", "label")
    ends = joined.join(label.select(F.col("class").alias("a"), F.col("label").alias("_a")), "a").join(label.select(F.col("class").alias("b"), F.col("label").alias("_b")), "b")
    return links.union(scratch.written(ends.select("_a", "_b").where("_a <> _b").distinct(), "jaccard-blocks"))


def join_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Every row of ``docs`` as key, ``n_shingles``, ``class`` (null for an empty set) and ``component_id``."""
    spark = docs.sparkSession
    text_batches(spark, 250)
    with Scratch(spark) as scratch:
        avoid = spark.sparkContext.broadcast(np.array(sorted(_frequent(docs, key, text, n)), dtype=np.int64))
        rows = scratch.written(shingle_sets(docs, key, text, n, num, den, avoid), "jaccard-rows")
        found = link_classes(rows, n, num, den, scratch)
        known = written(rows.select("_key", "size", "class"), "jaccard-known")
        least = scratch.written(known.where("class is not null").groupBy("class").agg(F.min("_key").alias("_least"), F.count("*").alias("_n")), "jaccard-least")
        if found is not None:
            found = scratch.written(found.join(least, "class"), "jaccard-found")
            low = scratch.written(found.groupBy("label").agg(F.min("_least").alias("_low")), "jaccard-low")
            both = found.join(low, "label").select("class", "_low")
            least = least.join(both, "class", "left").where("_n > 1 or _low is not null").select("class", F.coalesce("_low", "_least").alias("_low"))
        else:
            least = least.where("_n > 1").select("class", F.col("_least").alias("_low"))
        least = written(least, "jaccard-components")  # a row for each class of several rows or links
    return known.join(least, "class", "left").select(F.col("_key").alias(key), F.col("size").alias("n_shingles"), "class", F.coalesce("_low", "_key").alias("component_id"))


def op6_ngram_jaccard(spark, sf_dir):
    """Every document with the size of its set of 3-word shingles and its component at a similarity of 0.9."""
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
