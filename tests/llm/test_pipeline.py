"""The pipeline's rows against a plain Python version of all its stages, and its stages on odd rows."""

import hashlib
import math
import re
import struct
from collections import Counter, defaultdict

import corpus_pipeline
import tiktoken

from ledgerloom.llm import bpe, line_dedup, mixing


def similar_groups(texts):
    """Smallest index of each text's group at 0.8 over five-word shingles; None for a text without words."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                low, high = sorted((root(i), root(j)))
                label[high] = low
    return [root(i) for i in range(len(sets))]


def copies_of(docs):
    """Each document's number of copies: the inverted Poisson distribution at a hash of its id."""
    total, sizes = sum(mixing.WEIGHTS.values()), Counter()
    pool = lambda source: source if source in mixing.WEIGHTS else mixing.OTHER
    for _, text, source in docs:
        sizes[pool(source)] += len(text)
    out = []
    for doc_id, _, source in docs:
        rate = mixing.WEIGHTS.get(pool(source), 0.0) / total * sum(sizes.values()) / sizes[pool(source)]
        assert rate <= mixing.MAX_PART
        u = int(hashlib.md5(f"{mixing.SEED}:{doc_id}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        n = 0
        while c <= u:
            n += 1
            p *= rate / n
            c += p
        out.append(n)
    return out


def test_run_is_its_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    docs = [(r["doc_id"], r["text"], r["source"]) for r in rows if r["text"] and any(c.isalpha() for c in r["text"])]
    held, pages = defaultdict(Counter), Counter(s for _, _, s in docs)
    for _, text, source in docs:
        held[source].update({x for x in text.split("\n") if x.strip(" ")})
    bad = {s: {x for x, n in c.items() if n >= line_dedup.MIN_PAGES and n / pages[s] > line_dedup.MAX_RATIO} for s, c in held.items()}
    docs = [(i, "\n".join(x for x in t.split("\n") if x not in bad[s]), s) for i, t, s in docs]
    docs = [d for k, (d, g) in enumerate(zip(docs, similar_groups([t for _, t, _ in docs]), strict=True)) if g == k]
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for (i, text, _), n in zip(docs, copies_of(docs), strict=True):
        ids = enc.encode_ordinary(text)
        want += [(i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * n
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(want) > 50 and sorted(map(tuple, got)) == sorted(want)


def test_near_copies_keeps_texts_of_one_id(spark):
    same, other = "a b c d e f g h", "other text that is entirely here now"
    rows = [(1, same, None), (1, same, "en"), (1, other, "en"), (2, same, "en"), (None, same, "en"), (None, "uu ii oo pp ll kk", "en"), (3, None, None), (4, "", None), (4, "", None)]
    docs = spark.createDataFrame([(i, t, g, "s", 9, "x") for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(1, same), (1, other), (None, "uu ii oo pp ll kk"), (3, None), (4, ""), (4, "")])
    assert corpus_pipeline.keep_one_of_near_copies(spark, docs.limit(0), "").count() == 0


def test_languages_fill_in(spark):
    docs = spark.createDataFrame([(1, "hello there world", None), (2, "hello there again", "en"), (3, "12 ²½", "en"), (4, None, "en"), (5, "hello", "xx")], "doc_id long, text string, lang string").selectExpr("*", "'s' AS source", "9L AS n_chars")
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.keep_known_languages(spark, docs, "").collect()}
    assert got == {1: "en", 2: "en", 5: "xx"}
