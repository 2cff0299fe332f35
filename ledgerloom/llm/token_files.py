"""Token-ID output: binary files of fixed-width packed ids with random access.

A file holds the ids of many documents one after another, each in the minimum number of bits for the vocabulary. Layout, all numbers
little-endian: the magic bytes; the packed ids in blocks of BLOCK ids, each block a whole number of bytes (8 ids fill ``width`` bytes; the last block is
padded with zero bits); the block offsets as uint64, one more than there are blocks; the documents' first places as
uint64, one more than there are documents; a footer of fixed size (width, ids of a block, ids, documents, places of both tables). A reader takes any range of ids
from the blocks that hold it and unpacks them in numpy.

Documents are dealt by ranges of (key, hash of the text, input row), so tasks hold consecutive documents and a key may have any number
of rows. A task encodes a batch at a time and appends it, so it holds one batch and one open block. Files are written through pyarrow's file systems
under a name that no other attempt has; the manifest (one row a file) is a table that Spark commits and names the attempt
that counts, so files of lost executors are never read. A document's place in the corpus is the ids of all files before its
own plus its place in the file. Files are read back in ranges of documents of about READ_IDS ids each, over all tasks.

Encoding: the tokenizer drops white space and case, so a text is cut at white space and before marks that begin a token, Latin letters are made small, and the
library encodes the distinct pieces that a task meets, which are kept for the next batches. The ids are those of the whole text (tested), for a fraction of the
time. A tokenizer for which that does not hold is used with ``by_piece=False``, on whole texts.

Defined results: a null text is empty; an empty text is the end id alone; null keys come first, rows of one key are ordered by hash of the text, equal rows
follow each other in any order; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.session import arrow_rows, read_table, scratch_path

MAGIC = b"TOKIDS01"
FOOTER = struct.Struct("<6Q8s")
#: Ids of a block, a multiple of 8; texts of an Arrow batch; ids that a task reads back at a time.
BLOCK, BATCH, READ_IDS = 4096, 250, 4_000_000
#: Pieces that a worker keeps twice over, and the longest of them that are no words; words that are encoded as one text.
PIECES, LONGEST, JOINED = 250_000, 64, 1_000
#: Marks that may be cut from what stands before them, and the kinds of the first 256 characters: (m)ark, (a)lphanumeric, white space, other (p)unctuation.
MARKS = ",.;:!?"
_KINDS = bytes(ord("m" if chr(c) in MARKS else "a" if chr(c).isalnum() else " " if c in b"\t\n\r " else "p") for c in range(256))
END = 2
#: Files of a group when places are summed up.
GROUP = 1_000


def width_for(vocabulary: int) -> int:
    """The fewest bits for ids from 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids as width bits each, the lowest bit first; the last byte is padded with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width) if len(ids) else np.zeros(0, dtype=np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n ids."""
    if width in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{width // 8}", count=n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * width).reshape(n, width)
    return np.packbits(np.pad(bits, ((0, 0), (0, 32 - width))), axis=1, bitorder="little").reshape(-1).view("<u4").astype(np.uint32)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


class Writer:
    """One file, to which documents are appended."""

    def __init__(self, path: str, width: int, block: int = BLOCK):
        if block % 8:
            raise ValueError("a block must be a multiple of 8 ids")
        system, at = file_system(path)
        system.create_dir(os.path.dirname(at), recursive=True)
        self.out, self.width, self.block = system.open_output_stream(at), width, block
        self.out.write(MAGIC)
        self.offsets, self.starts, self.open, self.n = [len(MAGIC)], [np.zeros(1, dtype=np.uint64)], np.zeros(0, dtype=np.uint32), 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents of the sizes, whose ids follow each other."""
        self.starts.append((self.n + np.cumsum(sizes)).astype(np.uint64))
        self.n += len(ids)
        ids = np.concatenate([self.open, ids])
        whole = len(ids) // self.block
        data = packed(ids[: whole * self.block], self.width)
        size = self.block * self.width // 8
        self.offsets += [self.offsets[-1] + size * (i + 1) for i in range(whole)]
        self.out.write(data)
        self.open = ids[whole * self.block :].copy()

    def close(self) -> int:
        """Bytes of the file."""
        if len(self.open):
            data = packed(self.open, self.width)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        starts = np.concatenate(self.starts)
        end = self.offsets[-1]
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(starts.astype("<u8").tobytes())
        self.out.write(FOOTER.pack(self.width, self.block, self.n, len(starts) - 1, end, end + 8 * len(self.offsets), MAGIC))
        self.out.close()
        return end + 8 * (len(self.offsets) + len(starts)) + FOOTER.size


class Reader:
    """One file, of which any documents or ids are read."""

    def __init__(self, path: str):
        system, at = file_system(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        self.width, self.block, self.n, self.documents, self._offsets, self._starts, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} holds no packed ids")

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _numbers(self, at: int, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self._bytes(at + 8 * begin, 8 * (end - begin)), dtype="<u8").astype(np.int64)

    def starts(self, begin: int, end: int) -> np.ndarray:
        """First places of the documents from begin to end, and of the one behind them."""
        return self._numbers(self._starts, begin, end + 1)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from place begin to end."""
        if end <= begin:
            return np.zeros(0, dtype=np.uint32)
        first, last = begin // self.block, (end - 1) // self.block
        offsets = self._numbers(self._offsets, first, last + 2)
        held = min(self.n, (last + 1) * self.block) - first * self.block
        found = unpacked(self._bytes(int(offsets[0]), int(offsets[-1] - offsets[0])), held, self.width)
        return found[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        begin, end = self.starts(i, i + 1).tolist()
        return self.ids(begin, end)

    def close(self) -> None:
        self.file.close()


def _strings(pieces: pa.LargeStringArray) -> list[str]:
    """Pieces without spaces as a list; one text that is cut takes a tenth of the time of a text each."""
    if not len(pieces):
        return []
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(pieces)], pa.int64()), pieces), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")


class Encoder:
    """Texts to ids by a file of the tokenizers library, without special tokens."""

    def __init__(self, path: str, by_piece: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_piece = Tokenizer.from_file(path), by_piece
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.vocabulary, dtype=bool)
        if suffix:
            self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(suffix)]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces, those met lately and those met before.
        self.known, self.old = {}, {}

    def _spaced(self, text: str) -> str:
        """The text with a space between pieces whose ids, one after another, are the text's."""
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            kinds = b""
        if kinds:
            small = text.lower()
            if not any(t in small for t in self.special):
                text = small
            if b"mm" not in kinds and b"pm" not in kinds:  # each mark stands behind a letter, a digit or white space, so it begins a token
                for m in MARKS:
                    text = text.replace(m, f" {m}")
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: many as one text, whose ids are cut behind those that end a word, which saves the library an object a word."""
        if not self.ends.any():
            return self._library(words)
        out: list[bytes] = []
        for i in range(0, len(words), JOINED):
            part = words[i : i + JOINED]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # each word has one end at least, so equal numbers are one each
                out += self._library(part)
                continue
            data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
            out += [data[a:z] for a, z in zip(at[:-1], at[1:], strict=True)]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 32-bit numbers."""
        if not self.by_piece:
            return self._library(texts)
        # Arrow cuts the texts and numbers the distinct pieces, so Python meets a piece once a batch.
        spaced = [self._spaced(t).encode() for t in texts]
        ends = np.cumsum([0, *map(len, spaced)], dtype=np.int64)
        cut = pc.split_pattern(pa.LargeStringArray.from_buffers(len(spaced), pa.py_buffer(ends), pa.py_buffer(b"".join(spaced))), " ")
        coded = cut.flatten().dictionary_encode()
        known, old, pieces = self.known, self.old, _strings(coded.dictionary)
        ids = list(map(known.get, pieces))
        words, others = {}, {}
        for i, p in enumerate(pieces):
            if ids[i] is None:
                ids[i] = old.get(p)
                if ids[i] is not None:
                    known[p] = ids[i]
                else:
                    (words if p.isalpha() else others)[p] = i
        for new, encode in ((words, self._words), (others, self._library)):
            for (p, i), x in zip(new.items(), encode(list(new)), strict=True):
                known[p] = ids[i] = x
        found = pa.array(ids, pa.large_binary()).take(coded.indices)
        starts = np.frombuffer(found.buffers()[1], dtype=np.int64, count=len(found) + 1) if len(found) else np.zeros(1, dtype=np.int64)
        ends, data = starts[cut.offsets.to_numpy()].tolist(), memoryview(found.buffers()[2] or b"")
        out = [bytes(data[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        for p in others:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > PIECES:
            self.known, self.old = {}, known
        return out


@functools.cache
def encoder(path: str, by_piece: bool = True) -> Encoder:
    return Encoder(path, by_piece)


MANIFEST = T.StructType([T.StructField("file_no", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_documents", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("n_bytes", T.LongType())])


def _place(spark: SparkSession, path: str) -> str:
    """A path as file systems other than Spark's know it: one without a scheme is on the session's default file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return f"file://{urlparse(found).path}" if found.startswith("file:") else found


def write_files(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end: int | None = END, by_piece: bool = True) -> DataFrame:
    """Writes all documents in ascending order of key as files under path, and the manifest as ``path/manifest``, which is returned."""
    from pyspark import TaskContext

    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    # Equal rows may be very many; their place in the input only deals them out.
    rows = rows.withColumns({"_hash": F.xxhash64("_text"), "_input": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("_key", "_hash", "_input").sortWithinPartitions("_key", "_hash").select("_key", "_text")
    folder, attempt_of = _place(spark, path), uuid.uuid4().hex
    kind = docs.schema[key].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer, keys, at = encoder(tokenizer, by_piece), None, 0, ""
        context = TaskContext.get()
        for b in batches:
            if not len(b):
                continue
            if writer is None:
                at = f"{folder}/ids/{attempt_of}-{context.partitionId():06d}-{uuid.uuid4().hex}.bin"
                writer = Writer(at, width_for(encode.vocabulary))
            found = [np.frombuffer(x, dtype=np.uint32) for x in encode(b.column("_text").to_pylist())]
            if end is not None:
                tail = np.array([end], dtype=np.uint32)
                found = [x for ids in found for x in (ids, tail)]
                sizes = np.array([len(found[i]) + 1 for i in range(0, len(found), 2)], dtype=np.int64)
            else:
                sizes = np.array([len(x) for x in found], dtype=np.int64)
            writer.append(np.concatenate(found), sizes)
            part = b.column("_key")
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()] * len(b), type=pa.int32()), pa.array([at] * len(b)), pa.array(np.arange(keys, keys + len(b))), part, pa.nulls(len(b), pa.int64()), pa.nulls(len(b), pa.int64())], names=names)
            keys += len(b)
        if writer is not None:
            size = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], type=pa.int32()), pa.array([at]), pa.array([keys]), pa.nulls(1, part.type), pa.array([writer.n]), pa.array([size])], names=names)

    names = ["file_no", "path", "place", "_key", "n_ids", "n_bytes"]
    schema = T.StructType([*MANIFEST[:2], T.StructField("place", T.LongType()), T.StructField("_key", kind), *MANIFEST[3:]])
    with arrow_rows(spark, BATCH):
        dealt.mapInArrow(work, schema).write.parquet(f"{path}/written")
    done = spark.read.schema(schema).parquet(f"{path}/written")
    done.where("n_ids is not null").select("file_no", "path", F.col("place").alias("n_documents"), "n_ids", "n_bytes").write.parquet(f"{path}/manifest")
    done.where("n_ids is null").select("path", "place", "_key").write.parquet(f"{path}/keys")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with ``start``, the ids of all files before: summed up in groups of GROUP files, so no task has all of them."""
    grouped = manifest.withColumn("_group", F.floor(F.col("file_no") / GROUP))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # one row a GROUP files
    groups = grouped.groupBy("_group").agg(F.sum("n_ids").alias("_ids")).select("_group", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_group").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(F.broadcast(groups), "_group").withColumn("start", F.col("_before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).drop("_group", "_before")


def read_documents(spark: SparkSession, path: str, of: Callable[[np.ndarray], object] | None = None, kind: T.DataType | None = None, read_ids: int = READ_IDS) -> DataFrame:
    """``path``, ``place`` (in its file), ``start`` (in the corpus), ``n_tokens`` and ``value`` of every document, read from the files: its ids, or ``of(ids)`` as the kind."""
    kind = kind or T.ArrayType(T.LongType())
    files = placed(spark.read.schema(MANIFEST).parquet(f"{path}/manifest"))
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_ids") / read_ids)).cast("int")
    tasks = files.withColumn("_of", ranges).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).select("path", "start", "n_ids", "_part", "_of")
    # A row is a file's range of ids, so rows are dealt out, not bytes; the documents that begin in the range are read.
    tasks = tasks.repartition(F.col("path"), F.col("_part"))
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("value", kind)])
    result = of or (lambda ids: ids.astype(np.int64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        value = to_arrow_type(kind)
        for b in batches:
            for row in b.to_pylist():
                reader = Reader(row["path"])
                starts = reader.starts(0, reader.documents)
                low, high = (row["n_ids"] * (row["_part"] + i) // row["_of"] for i in (0, 1))
                first, last = (int(np.searchsorted(starts[:-1], x)) for x in (low, high))
                if row["_part"] == row["_of"] - 1:
                    last = reader.documents
                while first < last:  # a few documents at a time
                    until = max(first + 1, min(last, int(np.searchsorted(starts, starts[first] + read_ids, side="right")) - 1))
                    own = starts[first : until + 1]
                    ids = reader.ids(int(own[0]), int(own[-1]))
                    values = [result(ids[a - own[0] : z - own[0]]) for a, z in zip(own[:-1], own[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * (until - first)), pa.array(np.arange(first, until)), pa.array(row["start"] + own[:-1]), pa.array(np.diff(own)), pa.array(values, type=value)], names=schema.names)
                    first = until
                reader.close()

    return tasks.mapInArrow(work, schema)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def op11_token_files(spark, sf_dir):
    """Start, number and CRC-32 of the ids of every document, read back from the files."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    keys = spark.read.parquet(f"{path}/keys")
    found = read_documents(spark, path, crc32, T.LongType())
    # Spark takes what Python makes of a small table for small; it has a row a document.
    return keys.join(found.hint("merge"), ["path", "place"]).select(F.col("_key").alias("doc_id"), "start", "n_tokens", F.col("value").alias("ids_crc32"))
