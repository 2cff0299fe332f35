"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; the distinct pieces that a worker does not know are encoded by folding
the ranked merges over their bytes (the adjacent pair of lowest rank first, the leftmost of equals), many pieces a step,
and a text's ids are the concatenated ids of its pieces. Decoding concatenates the byte strings of
the ids. The ranks are the file's fixed table; each worker keeps CACHE of the pieces it has met at most.

Defined results: a null text encodes as the empty text (no ids); repeated rows get equal ids; texts of any length and
pieces of any length are encoded whole (long pieces by a heap, in n log n); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import text_batches

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces that a worker keeps encoded; beyond it, only those in use stay.
CACHE = 100_000
#: Pieces of texts that are looked up at once, and pieces that are folded at once.
LOOKED_UP, FOLDED = 200_000, 4_096
#: Pieces longer than this are merged by a heap.
LONG = 48
#: The code points that are white space to the pattern.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def compile_pattern(pattern: str) -> regex.Pattern:
    """The pattern with white space spelled out, as the regex module's \\s has four characters more."""
    inside = pattern.replace(r"[^\s", f"[^{SPACE}")
    return regex.compile(inside.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]"))


def finder(pattern: str) -> Callable[[str], list[str]]:
    """The pieces of a text. ASCII texts go by the same pattern with its classes cut to ASCII, which the standard library finds in half the time."""
    every = compile_pattern(pattern).findall
    inside = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "), pattern)
    plain = inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[\t-\r ]").replace(r"\S", r"[^\t-\r ]")
    try:
        ascii_ = re.compile(plain).findall
    except re.error:  # words that only the regex module has
        return every
    return lambda text: ascii_(text) if text.isascii() else every(text)


class Merges:
    """The ranked merges as a table of pairs of ids; a joined pair's rank is its id."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        pairs = [(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
        self.pairs, self.joined = np.array(sorted([*pairs, (self.NONE, self.NONE)]), dtype=np.int64).T.copy()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, NONE where they do not join."""
        pair = a << 32 | b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.joined[at], self.NONE)

    def fold(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out, todo = [b""] * len(pieces), []
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(piece) > LONG:
                out[i] = np.array(_fold_long(piece, self.ranks), dtype="<u4").tobytes()
            elif piece:
                todo.append(i)
        todo.sort(key=lambda i: len(pieces[i]))
        for start in range(0, len(todo), FOLDED):
            some = todo[start : start + FOLDED]
            for i, ids in self._fold([pieces[i] for i in some], some):
                out[i] = ids
        return out

    def _fold(self, pieces: list[bytes], names: list[int]) -> Iterator[tuple[int, bytes]]:
        """(name, ids) of pieces of like lengths: rows of ids, of which each step joins one pair."""
        width = max(map(len, pieces))
        size, name = np.array([len(p) for p in pieces]), np.array(names)
        ids = self.bytes[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(-1, width)]
        place = np.arange(width)
        ids[place >= size[:, None]] = -1
        # The last column of the ranks stays NONE, so a row without pairs has a place too.
        ranks = np.full(ids.shape, self.NONE)
        ranks[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        ranks[place >= size[:, None] - 1] = self.NONE
        while len(ids):
            row = np.arange(len(ids))
            at = ranks.argmin(axis=1)
            best = ranks[row, at]
            live = best != self.NONE
            if not live.all():
                for i, k, found in zip(name[~live].tolist(), size[~live].tolist(), ids[~live].astype("<u4"), strict=True):
                    yield i, found[:k].tobytes()
                ids, ranks, size, name, at, best = (x[live] for x in (ids, ranks, size, name, at, best))
                row = np.arange(len(ids))
            source = np.minimum(place + (place > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            size = size - 1
            ids[row, at] = best
            before = at > 0
            ranks[row[before], at[before] - 1] = self.rank(ids[row[before], at[before] - 1], best[before])
            after = at + 1 < size
            ranks[row, at] = self.NONE
            ranks[row[after], at[after]] = self.rank(best[after], ids[row[after], at[after] + 1])


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold over a linked list of parts, with the pairs in a heap by (rank, place)."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    live = [True] * n

    def offer(i: int) -> None:
        if end[i] < n and (r := ranks.get(piece[i : end[end[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[end[i]]))

    while heap:
        _, i, until = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != until:
            continue
        live[end[i]] = False
        end[i] = until
        if until < n:
            before[until] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.find, self.merges, self.pieces = finder(pattern), Merges(ranks), {}
        self.tokens = np.full(max(ranks.values()) + 1, None, dtype=object)
        for piece, i in ranks.items():
            self.tokens[i] = piece

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(t) if t else [] for t in texts]
        flat, ids = list(chain.from_iterable(found)), []
        for start in range(0, len(flat), LOOKED_UP):
            some = flat[start : start + LOOKED_UP]
            long_ = self._meet(set(some))
            ids += map(self.pieces.__getitem__, some)
            for piece in long_:
                del self.pieces[piece]
        ends = list(accumulate(map(len, found)))
        return [b"".join(ids[end - len(f) : end]) for end, f in zip(ends, found, strict=True)]

    def _meet(self, pieces: set[str]) -> list[str]:
        """Encodes the pieces that are not known; a full store keeps only those of ``pieces``. The new ones that are too long to be kept."""
        new = list(pieces.difference(self.pieces))
        if len(self.pieces) + len(new) > CACHE:
            self.pieces = {p: self.pieces[p] for p in pieces.intersection(self.pieces)}
        self.pieces.update(zip(new, self.merges.fold([p.encode("utf-8", "ignore") for p in new]), strict=True))
        return [p for p in new if len(p) > LONG]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.tokens.take(np.frombuffer(ids, dtype="<u4")).tolist())


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One per worker process, which keeps its pieces from task to task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoder(path: str | None = None, pattern: str | None = None):
    """A column function: text -> its ids as packed little-endian unsigned 32-bit integers."""
    chosen = (path, pattern) if path and pattern else default_vocabulary()

    @F.pandas_udf(T.BinaryType())
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(*chosen)
        for texts in batches:
            yield pd.Series(c.encode_all(texts), dtype=object)

    return encode


def decoder(path: str | None = None, pattern: str | None = None):
    """A column function: packed ids -> bytes."""
    chosen = (path, pattern) if path and pattern else default_vocabulary()

    @F.pandas_udf(T.BinaryType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(*chosen)
        for ids in batches:
            yield pd.Series([c.decode(x) for x in ids], dtype=object)

    return decode


def encode(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    return docs.withColumn(into, encoder(path, pattern)(F.col(f"`{text}`")))


def decode(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    return rows.withColumn(into, decoder(path, pattern)(F.col(f"`{ids}`")))


ROUND_TRIP = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def round_trip(path: str | None = None, pattern: str | None = None):
    """A column function: text -> struct of ROUND_TRIP, with the digests of its ids and of the bytes decoded from them."""
    chosen = (path, pattern) if path and pattern else default_vocabulary()

    @F.pandas_udf(ROUND_TRIP)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(*chosen)
        for texts in batches:
            rows = []
            for ids in c.encode_all(texts):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=ROUND_TRIP.names)

    return both


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text; number and digest of the ids, digest of the decoded bytes."""
    text_batches(docs.sparkSession, 250)
    return docs.select(F.col(f"`{key}`"), round_trip()(F.col(f"`{text}`")).alias("_found")).select(F.col(f"`{key}`"), "_found.*")


#: Buckets of the literal rank map: a lookup in a map walks its entries, so each bucket has a few.
RANK_BUCKETS = 8192


def rank_of(ranks: dict[bytes, int]):
    """A column function: hexadecimal piece -> its rank, by a literal map that is dealt to buckets by crc32."""
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        buckets[zlib.crc32(name.encode()) % RANK_BUCKETS][name] = rank
    table = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")  # folded to a literal by the optimiser
    return lambda piece: F.try_element_at(F.element_at(table, (F.crc32(piece.cast("binary")) % RANK_BUCKETS + 1).cast("int")), piece)


def fold_words(words: DataFrame, ranks: dict[bytes, int], word: str = "word", into: str = "ids") -> DataFrame:
    """The distinct words with their ids, by higher-order functions: each step joins the adjacent pair of the lowest rank, the leftmost of equals."""
    rank, text = rank_of(ranks), F.hex(F.col(word).cast("binary"))
    parts = F.transform(F.sequence(F.lit(0), (F.length(text) / 2 - 1).cast("int")), lambda i: F.substring(text, (2 * i + 1).cast("int"), F.lit(2)))

    def step(s: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(s, 1, F.size(s) - 1), lambda p, i: rank(F.concat(p, F.get(s, i + 1))))
        at = F.array_position(pairs, F.array_min(pairs)).cast("int")
        joined = F.concat(F.slice(s, 1, at - 1), F.array(F.concat(F.get(s, at - 1), F.get(s, at))), F.slice(s, at + 2, F.size(s)))
        return F.when((F.size(s) > 1) & F.coalesce(at > 0, F.lit(False)), joined).otherwise(s)

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length(text) / 2).cast("int"))), parts, step)
    known = rank(text)  # a word that is a token is not folded
    ids = F.when(F.length(text) == 0, F.array().cast("array<int>")).when(known.isNotNull(), F.array(known)).otherwise(F.transform(folded, rank))
    return words.withColumn(into, ids)


def encode_by_words(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key``, ``ids`` and ``decoded`` of every text by a table of distinct words and joins, without Python; keys must be unique.

    Every (document, word) pair is shuffled to the words and back, which is why digests() folds the words in the tasks that meet them.
    """
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()
    ranks, (inside, plain) = read_ranks(path), (f"[{SPACE}]", f"[^{SPACE}]")
    spelled = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s", inside).replace(r"\S", plain)
    pieces = docs.select(F.col(key).alias("_key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(spelled), F.lit(0))).alias("_at", "word"))
    words = fold_words(pieces.select("word").distinct(), ranks)
    tokens = {i: piece.hex().upper() for piece, i in ranks.items()}
    names = F.from_json(F.lit(json.dumps([tokens.get(i, "") for i in range(max(tokens) + 1)])), "array<string>")
    each = pieces.join(words, "word").groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "ids"))).alias("_w"))
    found = each.select("_key", F.flatten(F.transform("_w", lambda w: w["ids"])).alias("ids"))
    done = docs.select(F.col(key).alias("_key")).join(found, "_key", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return done.select(F.col("_key").alias(key), "ids", F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(names, i + 1)), "")).alias("decoded"))


def op4_byte_bpe(spark, sf_dir):
    """Every document's ids and round trip, as digests."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
