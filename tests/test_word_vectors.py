"""Counts by hand and the factors against a dense eigendecomposition."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from matchwright.operators import word_vectors as W


def texts(n=60, seed=2):
    rng = random.Random(seed)
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    return [(i, " ".join(rng.choice(groups[i % 3]) for _ in range(9)) + " the") for i in range(n)] + [(900, None), (901, " -- "), (902, "alone")]


def counted(rows, window):
    out = Counter()
    for _, text in rows:
        w = [x for x in (text or "").lower().replace("-", " ").split() if x]
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 1 + window]:
                out[a, b] += 1
                out[b, a] += 1
    return out


def test_counts_and_factors(spark):
    rows = texts()
    records = spark.createDataFrame(rows, "id long, t string")
    want = counted(rows, 4)
    counts = W.cooccurrences(records, "t", 4)
    assert {(r["word"], r["other"]): r["n"] for r in counts.collect()} == dict(want)
    names = sorted({a for a, _ in want})
    sums = {a: sum(n for (x, _), n in want.items() if x == a) for a in names}
    dense = np.zeros((len(names), len(names)))
    for (a, b), n in want.items():
        dense[names.index(a), names.index(b)] = max(0.0, np.log(n * sum(want.values()) / (sums[a] * sums[b])))
    matrix = W.information(counts)
    made = np.zeros_like(dense)
    for r in matrix.collect():
        made[names.index(r["word"]), names.index(r["other"])] = r["weight"]
    assert np.allclose(made, dense)
    vectors = W.word_vectors(matrix, 3, rounds=3, spare=5)
    got = {r["word"]: r["vector"] for r in vectors.collect()}
    v = np.array([got.get(n, [0.0] * 3) for n in names])
    values, basis = np.linalg.eigh(dense)
    top = np.argsort(-np.abs(values))[:3]
    # The three groups are three directions; signs aside, the products of words are the dense ones.
    best = (basis[:, top] * np.abs(values[top])) @ basis[:, top].T
    assert np.abs(v @ v.T - best).max() < 0.05 * np.abs(best).max()
    embedded = {r["id"]: np.array(r["embedding"]) for r in W.record_vectors(records, "t", vectors, 3).collect()}
    assert len(embedded) == len(rows) and all(not embedded[i].any() for i in (900, 901, 902))
    cosine = lambda a, b: embedded[a] @ embedded[b] / np.linalg.norm(embedded[a]) / np.linalg.norm(embedded[b])
    assert min(cosine(0, 3), cosine(1, 4), cosine(2, 5)) > 0.9 > max(cosine(0, 1), cosine(1, 2), cosine(0, 2))


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, t string")
    vectors = W.word_vectors(W.information(W.cooccurrences(none, "t")), 2, rounds=1, spare=1)
    assert vectors.count() == 0 and W.record_vectors(none, "t", vectors, 2).count() == 0
