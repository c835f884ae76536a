"""Learned token vectors against numpy on small corpora."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from parasol.operators import learned_vectors as LV
from parasol.operators.vectors import NamedVectors, sentence_embeddings

SEQS = "seq_id long, tokens array<string>"


def brute_pmi(seqs, window=2):
    n = Counter()
    for t in seqs:
        for i, a in enumerate(t):
            for b in t[i + 1:i + 1 + window]:
                if a is not None and b is not None:
                    n[a, b] += 1
                    n[b, a] += 1
    total, sums = sum(n.values()), Counter()
    for (a, _), k in n.items():
        sums[a] += k
    return {p: math.log(k * total / sums[p[0]] / sums[p[1]]) for p, k in n.items() if k * total > sums[p[0]] * sums[p[1]]}


def corpus():
    rng = random.Random(1)
    topics = [[f"{c}{i}" for i in range(12)] for c in "xyz"]
    return [[rng.choice(t) for _ in range(rng.randrange(2, 12))] for t in topics for _ in range(80)] + [["x0", None, "x1"], [], ["y0"], ["x0", "y0"]]


def test_pmi_and_values_equal_numpy(spark):
    seqs = corpus()
    df = spark.createDataFrame([*enumerate(seqs), (9999, None)], SEQS).repartition(3)
    pmi = LV.positive_pmi(LV.cooccurrences(df))
    got, want = {(r.a, r.b): r.x for r in pmi.collect()}, brute_pmi(seqs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    words = sorted({a for a, _ in want})
    dense = np.array([[want.get((a, b), 0.0) for b in words] for a in words])
    vectors, values = LV.factorise(pmi, dimensions=6, rounds=6)
    full = np.linalg.eigvalsh(dense)
    largest = sorted(np.abs(full), reverse=True)
    assert np.abs(values[:3]) == pytest.approx(largest[:3], rel=1e-6) and np.abs(values) == pytest.approx(largest[:6], rel=2e-2)
    v = {r.token: np.array(r.vector) for r in vectors.collect()}
    assert set(v) == set(words) and all(len(x) == 6 for x in v.values())

    def cosine(a, b):
        return v[a] @ v[b] / np.linalg.norm(v[a]) / np.linalg.norm(v[b])
    same = np.mean([cosine(f"{c}{i}", f"{c}{j}") for c in "xyz" for i in range(12) for j in range(i)])
    other = np.mean([cosine(f"x{i}", f"y{j}") for i in range(12) for j in range(12)])
    assert same > other + 0.3
    e = sentence_embeddings(df.limit(3), "seq_id", {"e": "tokens"}, NamedVectors(vectors)).collect()
    assert len(e) == 3 and all(r.e is None or len(r.e) == 6 for r in e)


def test_nothing_to_learn(spark):
    pmi = LV.positive_pmi(LV.cooccurrences(spark.createDataFrame([(1, ["a"]), (2, None)], SEQS)))
    assert pmi.collect() == []
    vectors, values = LV.factorise(pmi, 4)
    assert vectors.collect() == [] and np.abs(values).max() == 0
