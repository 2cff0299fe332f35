"""Indexes of the join by label are bounded by the bytes of their texts, not by the number of classes alone."""

import random
import uuid

import numpy as np
import pytest

from ledgerloom.llm import jaccard_join as J


def near_copies() -> list[str]:
    """Many small chains of near copies whose ends share few words, so that signatures keep several labels."""
    rng, texts = random.Random(6), []
    for group in range(60):
        words = [f"g{group}w{i}" for i in range(60)]
        for _ in range(12):
            words = list(words)
            for _ in range(2):
                words[rng.randrange(60)] = f"c{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("most", [None, 2_000])
def test_shards_by_label_are_bounded_in_bytes(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(J, "NEIGHBOURS", 2)
    if most:
        monkeypatch.setattr(J, "SHARD_BYTES", most)
    real, folder = J._across, str(tmp_path)

    def across(n, num, den):
        work = real(n, num, den)

        def recorded(index, queries):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(sum(map(len, index["z"]))))
            return work(index, queries)

        return recorded

    monkeypatch.setattr(J, "_across", across)
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in J.join_documents(docs, n=1, num=80).collect()}
    sets = [set(t.split()) for t in texts]
    low = np.arange(len(sets))
    for i in range(len(sets)):
        for j in range(i // 12 * 12, i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low[low == max(low[i], low[j])] = min(low[i], low[j])
    assert [got[i] for i in range(len(sets))] == low.tolist()
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sizes and (not most or max(sizes) < 5 * most), sorted(sizes)[-5:]


def test_shared_elements():
    rng = np.random.default_rng(2)
    for size in (0, 1, 2, 50, 400):
        flat = rng.integers(0, 100, size)
        _, inverse, df = np.unique(flat, return_inverse=True, return_counts=True)
        assert (J._shared(flat) == (df[inverse] > 1)).all()
