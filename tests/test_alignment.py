"""Word alignment against a plain loop over pairs."""

import random
from collections import Counter, defaultdict

import pytest

from parasol.operators import alignment as AL

SCHEMA = "pair_id long, x array<string>, y array<string>"


def brute(pairs, rounds):
    p = None
    for _ in range(rounds):
        sums = defaultdict(float)
        for x, y in pairs:
            gs = Counter(w for w in x or [] if w)
            gs[""] = 1
            for m, n in Counter(w for w in y or [] if w).items():
                weights = {g: k * (p.get((g, m), 0) if p else 1) for g, k in gs.items()}
                for g, w in weights.items():
                    sums[g, m] += n * w / sum(weights.values())
        totals = defaultdict(float)
        for (g, _), s in sums.items():
            totals[g] += s
        p = {(g, m): s / totals[g] for (g, m), s in sums.items()}
    return p


def table(spark, pairs):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pairs)], SCHEMA).repartition(3)


@pytest.mark.parametrize("rounds", [1, 3])
def test_equals_brute_force(spark, rounds):
    rng = random.Random(rounds)
    pairs = [([rng.choice("abcdef") for _ in range(rng.randrange(7))], [rng.choice("uvwxyz") for _ in range(rng.randrange(7))]) for _ in range(60)]
    pairs += [(None, ["u"]), (["a"], None), ([], []), (["a", None, ""], ["u", None, ""]), (["hot"], ["hot"])] + [(["hot", "a"], ["u"])] * 50
    want = brute(pairs, rounds)
    got = {(r.given, r.made): r.p for r in AL.fit_alignment(table(spark, pairs), "x", "y", rounds).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_learns_words_of_sides_that_differ_in_length(spark):
    rng = random.Random(5)
    to = {w: w.upper() for w in "abcdefgh"} | {"x": None, "y": "Y1 Y2"}      # x vanishes, y becomes two words
    pairs = []
    for _ in range(400):
        x = [rng.choice(list(to)) for _ in range(rng.randrange(1, 6))]
        pairs.append((x, [w for s in x if to[s] for w in to[s].split()]))
    model = AL.fit_alignment(table(spark, pairs), "x", "y", 6)
    got = {r.src: r.tgt for r in AL.aligned_replacements(model).collect()}
    assert all(got[w] == to[w] for w in "abcdefgh") and got["y"] in ("Y1", "Y2")
    back = AL.fit_alignment(table(spark, pairs), "y", "x", 6)
    rows = AL.aligned_words(table(spark, pairs), back, "y", "x").collect()
    assert len(rows) == sum(len(x) for x, _ in pairs)        # no pair, no word is dropped
    right = sum(r.source == (to[r.word] or "") for r in rows if r.word != "y" )
    assert right / sum(r.word != "y" for r in rows) > 0.95


def test_empty(spark):
    model = AL.fit_alignment(table(spark, []), "x", "y")
    assert model.collect() == [] and AL.aligned_words(table(spark, [(["a"], ["b"])]), model, "x", "y").first().source == ""
    with pytest.raises(ValueError):
        AL.fit_alignment(table(spark, []), "x", "y", 0)
