import math

import numpy as np
import pytest

from parasol.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Rows (vec_id, vector, label) that take part, compared one by one."""
    took = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        row = (label, list(np.array(vector, dtype=np.float32).astype(float)))
        took[vec_id] = min(took.get(vec_id, row), row)
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in took.items()}
    out = []
    for a, (label, v) in ints.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, (m, w) in ints.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            near = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(near)]
    return sorted(out)


def made(n, seed, spread=0.3, dim=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0.1, spread, dim).astype(np.float32)], int(rng.integers(0, 4))) for i in range(n)]


def check(spark, rows):
    got = H.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(rows)


@pytest.mark.parametrize("sent", [H.SENT_BYTES, 0])  # blocks of anchors sent to all tasks, or shuffled
def test_many_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(H, "CANDIDATES", 64)
    monkeypatch.setattr(H, "ANCHORS", 2)
    monkeypatch.setattr(H, "SENT_BYTES", sent)
    check(spark, made(900, 1))


def test_edges(spark):
    rows = made(250, 2)
    rows[3] = (3, None, 1)
    rows[4] = (4, [1.0, None], 1)
    rows[5] = (5, [float("nan")] * 8, 1)
    rows[6] = (6, [float("inf")] * 8, 1)
    rows[8] = (8, [1.0] * 8, None)
    rows[9] = (9, [], 2)                       # scores zero with all
    rows[10] = (10, [0.5, 0.25], 2)            # as if it ended in zeros
    rows[11] = (11, [100.0] * 12, 2)
    rows += [(None, [1.0] * 8, 1), (100, [0.1] * 8, 0), (12, [0.5] * 8, 1), (12, [0.5] * 8, 1), (-200, [0.2] * 8, 3)]
    rows += [(1000 + i, [0.3] * 8, i % 3) for i in range(40)]     # ties
    rows += [(2000, [0.0] * 8, 77)]            # alone in its label
    check(spark, rows)


def test_wide_components(spark):
    # fields of over 64 bits: Python's integers
    rows = [(i, [x * 3.0e6 for x in v], label) for i, v, label in made(210, 3, dim=4)]
    check(spark, rows)


def test_scores_beyond_a_long_end_the_job(spark):
    rows = [(0, [1e15] * 4, 1), (1, [1e15] * 4, 1)]
    with pytest.raises(Exception, match="does not fit into a long"):
        H.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()


def test_empty_and_clashing_columns(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = made(120, 4)
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", wanted int, block int, anchor_id int")
    assert sorted(map(tuple, H.hard_negatives(clash).collect())) == brute(rows)


@pytest.mark.parametrize("low,high", [(-300, 300), (0, 5), (-9, 0), (-40000, 40000), (-2 ** 40, 2 ** 40), (0, 0)])
def test_packed_products_are_exact(low, high):
    rng = np.random.default_rng(5)
    for n, dim in ((1, 3), (17, 64), (50, 1), (5, 0)):
        c, a = (rng.integers(low, high, (k, dim), endpoint=True) for k in (n, 7))
        want = a.astype(object) @ c.T.astype(object) if dim else np.zeros((7, n))
        if dim and max((abs(x) for x in want.flat), default=0) >= 2 ** 63:
            continue
        packed = H.Packed(c, int(a.min(initial=0)), int(a.max(initial=0)))
        assert (packed.scores(a) == want).all()
    assert H.Packed(np.array([[300, -300]] * 2), -300, 300).fields > 1


def test_score_range():
    for s in range(-50, 400):
        low, high = H.score_range(s)
        assert [n for n in range(-60, 400) if 30 * s <= 100 * n <= 90 * s] == list(range(low, high + 1))
