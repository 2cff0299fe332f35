import random

import numpy as np
import pytest
import tiktoken

from ledgerloom.llm import bpe


@pytest.fixture(scope="module")
def library():
    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_many_pieces_are_folded_at_once(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab '\n\ts1-\x1c\x0b\r" if i % 2 else "abé\x85　日1٣😀 '\x1c") for _ in range(rng.randrange(90))) for i in range(2000)]
    texts += [None, "", *("a" * n for n in range(1, 120)), *("日本" * n for n in range(1, 60))]
    c = bpe.Codec(*bpe.default_vocabulary())
    for text, ids in zip(texts, c.encode_all(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text or "")
        assert c.decode(ids) == (text or "").encode()


def test_a_full_store_keeps_what_is_in_use(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 60)
    c, folded = bpe.Codec(*bpe.default_vocabulary()), []
    fold = c.merges.fold
    monkeypatch.setattr(c.merges, "fold", lambda pieces: folded.extend(pieces) or fold(pieces))
    for i in range(30):
        c.encode_all(["usualword " + " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}zzq" for j in range(20)), "-" * 500])
        assert len(c.pieces) <= 60 and "-" * 500 not in c.pieces
    assert folded.count(b"usualword") == 1


def test_ascii_texts_have_the_pieces_of_the_pattern():
    _, pattern = bpe.default_vocabulary()
    rng, find, whole = random.Random(5), bpe.finder(pattern), bpe.compile_pattern(pattern).findall
    for _ in range(2000):
        text = "".join(map(chr, rng.choices([*range(128), 32, 32, 9, 10, 39, 115, 116], k=rng.randrange(40))))
        assert find(text) == whole(text)
