"""Learned operators against plain versions of their scoring, and what they give for odd rows."""

import math

import numpy as np
import tiktoken
import zstandard

from ledgerloom.llm import bpe, language_id, quality, toxicity

TEXTS = ["the cat sat on the mat and the dog ran", "der hund und die katze sind im haus", "the cat und der hund sat im haus and ran", "le chat est sur la table", "a", "", None, "12 34", "½ ² Ⅷ"]


def plain_mixture(text, table):
    """Expectation-maximisation of one document by loops, then sets of languages by penalised likelihood."""
    counts = np.bincount(language_id.trigrams(text), minlength=language_id.BUCKETS)
    grams = [(table[i].astype(float), int(n)) for i, n in enumerate(counts) if n]
    total, k = sum(n for _, n in grams), table.shape[1]

    def em(share, steps):
        for _ in range(steps):
            new = [0.0] * k
            for p, n in grams:
                mix = sum(p[j] * share[j] for j in range(k))
                for j in range(k):
                    new[j] += n * p[j] * share[j] / mix
            share = [x / total for x in new]
        return share, sum(n * math.log(sum(p[j] * share[j] for j in range(k))) for p, n in grams)

    first, _ = em([1 / k] * k, language_id.FULL_STEPS)
    order = sorted(range(k), key=lambda j: -first[j])
    best = [float(j == order[0]) for j in range(k)]
    _, fit = em(best, 0)
    for size in range(2, k + 1):
        tried, now = em([1 / size if j in order[:size] else 0.0 for j in range(k)], language_id.SET_STEPS)
        if now - fit <= language_id.PENALTY * math.log(total):
            break
        best, fit = tried, now
    return best


def test_mixture_is_its_plain_version():
    table = np.full((language_id.BUCKETS, 3), 0.01)
    for j, text in enumerate(TEXTS[i] for i in (0, 1, 3)):
        np.add.at(table[:, j], language_id.trigrams(text), 1)
    table = (table / table.sum(axis=0)).astype(np.float32)
    long = [t * 8 if t else t for t in TEXTS]
    for text, found in zip(long, language_id.infer(long, table), strict=True):
        want = plain_mixture(text, table) if text and any(c.isalpha() for c in text) and any("a" <= c <= "z" for c in text) else [0.0] * 3
        assert np.allclose(found, want, atol=1e-3), text


def test_languages_of_odd_rows(spark):
    """und with 0 for texts without letters; a column named as the result is replaced; the languages of the most text are learned."""
    rows = [(i, t, "ende fr"[2 * (i % 3) : 2 * (i % 3) + 2].strip() if t else None, "old") for i, t in enumerate(TEXTS)] + [(20, "zz", "rare", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _lang string")
    got = {r["doc_id"]: (r["_lang"]["lang"], r["_lang"]["score"]) for r in language_id.identify(docs, docs).collect()}
    assert len(got) == len(rows) and all(got[i] == ("und", 0.0) for i in (5, 6, 7, 8)) and got[0][0] != "und"
    langs, table = language_id.learn(docs, most=2)
    assert len(langs) == 2 and "rare" not in langs and table.shape == (language_id.BUCKETS, 2)
    assert language_id.learn(docs.limit(0))[0] == []


def test_window_gains_are_of_single_compressions(spark):
    """Statistics of a text are those of its windows, each compressed apart with either dictionary."""
    contents = toxicity.train_dictionaries(spark.createDataFrame([(1, "vile awful day")] * 8 + [(0, "kind calm day")] * 8, "_label int, _text string"), 8, 8)
    windows = toxicity.Windows(*contents)
    text = "a vile and awful day, kind and calm people"
    words = toxicity.words_of(text)
    gains = []
    for i in range(0, len(words), toxicity.WORDS):
        part = f" {' '.join(words[i : i + toxicity.WORDS])} ".encode()
        sizes = []
        for content in contents:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters(window_log=16, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_GREEDY, write_content_size=0)
            sizes.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(part)))
        gains.append(sizes[0] - sizes[1])
    found = windows.statistics(text)
    assert found[2 * toxicity.TOP] == max(gains) and found[2 * toxicity.TOP + 1] == sum(gains) / len(gains)
    assert [round(x * len(gains)) for x in found[: toxicity.TOP]] == [sum(g >= k for g in gains) for k in range(1, toxicity.TOP + 1)]


def test_scores_of_odd_rows(spark):
    """Null and empty texts score alike, repeated rows alike; without labels of both classes the score is the share of label 1; of several labels the largest counts."""
    good, bad = "A calm and kind sentence about the garden.", "vile awful hateful words"
    rows = [(i, bad if i % 2 else good) for i in range(40)] + [(100, None), (101, ""), (0, good), (None, bad), (102, bad + " x" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (3, None), (None, 1)], "doc_id long, y int")
    for classify in (quality.classify, toxicity.classify):
        scored = classify(docs, labels, "y", lambda k: k.isNotNull()).select("doc_id", "score").collect()
        by = {}
        for r in scored:
            by.setdefault(r["doc_id"], []).append(r["score"])
        assert len(scored) == len(rows) and by[100] == by[101] and by[0][0] == by[0][1] and all(0 <= s <= 1 for v in by.values() for s in v)
        assert by[1][0] > 0.5 > by[0][0] and by[None][0] == by[1][0]
        none = classify(docs, labels.limit(0), "y", lambda k: k.isNotNull()).select("score").distinct().collect()
        assert [r["score"] for r in none] == [0.5]


def test_trees_are_walked():
    """The vectorised traversal of the flattened trees is a walk down each tree."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 5))
    trees = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float))
    for row, found in zip(x[:40], trees.margin(x[:40]), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.right[node] if row[trees.feature[node]] > trees.threshold[node] else trees.left[node]
            total += trees.value[node]
        assert math.isclose(total, found, abs_tol=1e-9)


def test_words_are_folded_by_higher_order_functions(spark):
    """The form with distinct words and joins gives tiktoken's ids, and decodes to the text."""
    path, pattern = bpe.default_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = ["Hello world, it's 2024!\n\n  ok", "", None, "naïve 日本語 éé  x", "hello hello unbelievablyness"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode_by_words(docs).collect():
        text = texts[r["doc_id"]] or ""
        assert (list(r["ids"]), bytes(r["decoded"])) == (enc.encode_ordinary(text), text.encode())
