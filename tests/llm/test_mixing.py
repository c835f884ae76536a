from collections import Counter, defaultdict

import numpy as np
import pytest

from parasol.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Pour out in small steps: what a full source can't hold flows on."""
    w = [weights[i % 3] for i in range(len(sizes))]
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(mid * a, most * s) for a, s in zip(w, sizes)) < share * sum(sizes):
            lo = mid
        else:
            hi = mid
    return [min(lo * a, most * s) for a, s in zip(w, sizes)]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 50, 1000], [0, 7, 0, 900, 3], [100], [0, 0], []])
def test_targets(sizes):
    assert mixing.targets(sizes) == pytest.approx(brute_targets(sizes), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("shards", [1, 2, 3, 8, 13])
def test_quotas_add_up(shards):
    quotas = [1000, 0, 17, 1, 333]
    got = mixing.split_quotas(quotas, shards)
    assert got.shape == (shards, 5) and (got >= 0).all()
    assert got.sum(0).tolist() == quotas
    totals = got.sum(1)
    assert totals.max() - totals.min() <= 2
    assert (got == mixing.split_quotas(quotas, shards)).all()


def test_huge_quotas():
    got = mixing.split_quotas([3 * 10**9, 10**9, 5], 4)
    assert got.sum(0).tolist() == [3 * 10**9, 10**9, 5] and (got >= 0).all()


def test_quota_is_hypergeometric():
    firsts = [mixing.split_quotas([6, 4], 2, seed=s)[0][0] for s in range(3000)]
    assert abs(np.mean(firsts) - 3) < 0.06
    assert abs(np.var(firsts) - 5 * 0.6 * 0.4 * 5 / 9) < 0.06


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.mix_documents(docs).collect()
    sizes = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    names = sorted(set(source.values()))
    by = defaultdict(int)
    for i, s in sizes.items():
        by[source[i]] += s
    want = dict(zip(names, brute_targets([by[n] for n in names])))
    took = defaultdict(int)
    for r in rows:
        took[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == by[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert len(r.shards) >= -(-r.taken // max(1, r["size"]))
    for n in names:
        assert abs(took[n] - want[n]) <= 1
    again = {r.doc_id: (r.taken, r.shards) for r in mixing.mix_documents(docs).collect()}
    assert again == {r.doc_id: (r.taken, r.shards) for r in rows}


def test_edges(docs_of):
    rows = [(1, None, "en", None, 0), (2, "", None, "b", 0), (3, "a b c", None, "a", 0), (3, "a b c", None, "a", 0),
            (4, "w " * 50000, None, "a", 0), (None, "x y", None, None, 0)]
    got = mixing.mix_documents(docs_of(rows)).collect()
    assert len(got) == 6
    assert [r.taken for r in got if r.source == "b"] == [0]
    assert all(r.target == 0 for r in got if r.source == "b")
    whole = mixing.mixed_rows(docs_of(rows))
    assert whole.columns == docs_of(rows).columns
    counts = Counter(r.doc_id for r in whole.collect())
    assert all(n <= 4 for n in counts.values()) and 2 not in counts
    assert mixing.mix_documents(docs_of([])).count() == 0
    assert mixing.mixed_rows(docs_of([])).count() == 0
