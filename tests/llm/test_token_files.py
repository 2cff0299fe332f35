"""Packed token files: exact round trips against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import token_files as T

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 256, 257, 32_000, 49_408, 65_536, 65_537, 2**20, 2**32])
def test_packing_round_trip(vocabulary):
    width = T.width_for(vocabulary)
    assert 2**width >= vocabulary and (width == 1 or 2 ** (width - 1) < vocabulary)
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 9, 1000):
        ids = rng.integers(0, vocabulary, n).astype(np.uint32)
        ids[: n // 2] = vocabulary - 1
        data = T.packed(ids, width)
        assert len(data) == -(-n * width // 8)
        assert (T.unpacked(data, n, width) == ids).all()


def test_random_access(tmp_path):
    rng = random.Random(3)
    documents = [np.array([rng.randrange(50_000) for _ in range(n)], dtype=np.uint32) for n in [0, 1, 5, 0, 40, 300, 16, 0]]
    for width in (16, 17, 31):
        path = str(tmp_path / f"{width}.bin")
        w = T.Writer(path, width, block=16)
        for a in range(0, len(documents), 3):
            part = documents[a : a + 3]
            w.append(np.concatenate(part), np.array([len(d) for d in part]))
        assert w.close() == (tmp_path / f"{width}.bin").stat().st_size
        r = T.Reader(path)
        everything = np.concatenate(documents)
        assert (r.documents, r.n, r.width) == (len(documents), len(everything), width)
        for i in rng.sample(range(len(documents)), len(documents)):
            assert r.document(i).tolist() == documents[i].tolist()
        for _ in range(50):
            a, z = sorted(rng.randrange(len(everything) + 1) for _ in range(2))
            assert r.ids(a, z).tolist() == everything[a:z].tolist()
    (tmp_path / "other.bin").write_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        T.Reader(str(tmp_path / "other.bin"))


ODD = ["", " ", "\n\n", "It's the cat's-hat, isn't it?", "ÅÄÖ é é ΣΑΣ İI", "a\x1cb\x85c d e", " ́x ́", "<|endoftext|> x<|startoftext|>y", "tab\tnew\r\nline\x0bv\x0cf", "日本語 テキスト 한국어 각", "1234 5,6", "👩‍👩‍👧 🇩🇪", "x" * 300, "one, two. three?! 'four', _five. a.b 5,5 6. (x). \"y.\" don't. DON'T, ²³. ª.", "<|ENDOFTEXT|> A.", "Ünï, Ñandú; ÅÇÉ. ßẞ. ŸĲ. Ǆ, İ. µ. Σ. ΑΣ.", "a\xa0b,\xa0c \x1d, \x85. z", "...", ". . ,", "a\u0301. b", "''s 's. it's, 'S"]


def test_pieces_have_the_ids_of_the_whole(spark, sf, monkeypatch):
    texts = ODD + [r[0] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    library = Tokenizer.from_file(WORDS)
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype=np.uint32).tobytes() for t in texts]
    assert T.Encoder(WORDS)(texts) == want
    monkeypatch.setattr(T, "PIECES", 20)  # what is kept goes again and again
    e = T.Encoder(WORDS)
    assert [e(texts[i : i + 2]) for i in range(0, len(texts), 2)] == [want[i : i + 2] for i in range(0, len(texts), 2)]
    assert T.Encoder(WORDS, by_piece=False)(texts[:30]) == want[:30]


def plain(rows):
    library, start, out = Tokenizer.from_file(WORDS), 0, []
    for key, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_the_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    found = T.op11_token_files(spark, sf)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == plain(rows)


def test_nulls_repeats_and_other_columns(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 2)
    rows = [(None, "first of all"), (5, None), (5, "five"), (1, "one and more " * 50), *[(7, "same")] * 30, *((10 + i, t) for i, t in enumerate(ODD))]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, place int, path string").repartition(6)
    at = str(tmp_path / "files")
    manifest = T.write_files(docs, at, WORDS)
    found = T.read_documents(spark, at, T.crc32, T.T.LongType(), read_ids=50).join(spark.read.parquet(f"{at}/keys"), ["path", "place"])
    got = sorted((r["start"], r["_key"], r["n_tokens"], r["value"]) for r in found.collect())
    end = 0
    for start, _, n, _ in got:
        assert start == end
        end += n
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda k: (k is not None, k))
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == sorted((str(k), n, c) for k, _, n, c in plain(rows))
    assert manifest.agg({"n_documents": "sum"}).first()[0] == len(rows)
    ids = T.read_documents(spark, at).where("n_tokens = 1").first()
    assert ids["value"] == [2]


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert T.op11_token_files(spark, str(tmp_path)).collect() == []


def test_a_piece_is_looked_up_once_a_batch():
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

    encode = T.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["uno dos, tres. cuatro\ncinco"] * 100 + ["", " ", "Ñu, ñandú", "日本 語", "a\x00b"]
    plain = [np.array(encode.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.uint32).tobytes() for t in texts]
    encode.known = Counted()
    assert encode(texts) == plain and encode.known.n < 50
    assert encode([]) == [] and encode([""]) == [b""]
    assert T.packed(np.array([1, 49_000], dtype=np.uint32), 16) == b"\x01\x00\x68\xbf"
