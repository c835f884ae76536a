"""Word alignment at size: rounds in buckets."""
import pytest
from pyspark.sql import functions as F

from parasol.operators import alignment as AL
from parasol.operators import judges as JU
from parasol.plans import derived as D


def model(pairs, *sides):
    return {(r.given, r.made): r.p for r in AL.fit_alignment(pairs, *sides).collect()}


def test_rounds_in_buckets_equal_rounds_by_join(spark, sf, monkeypatch):
    odd = spark.createDataFrame([(["a", "a", "b", None, ""], ["u", "u", "v"]), (["a"], []), ([], ["u"]), (None, ["w", None]), (["a"], None),
                                 (["a", "a", "b", None, ""], ["u", "u", "v"])], "x array<string>, y array<string>")
    pairs = D.pairs(spark, sf).select(F.split("toxic", " ").alias("x"), F.split("hyp", " ").alias("y")).unionByName(odd)
    by_join = {}
    with monkeypatch.context() as m:
        m.setattr(JU, "SENT_WEIGHTS", 0)
        for sides in (("x", "y"), ("y", "x")):
            by_join[sides] = model(pairs, *sides)

    def stored(*_):
        raise AssertionError("co-occurrences are stored")
    monkeypatch.setattr(AL, "cooccurrences", stored)
    for cells in (AL.CELLS, 50):
        monkeypatch.setattr(AL, "CELLS", cells)
        for sides, want in by_join.items():
            got = model(pairs, *sides)
            assert got.keys() == want.keys()
            assert all(got[k] == pytest.approx(p, abs=1e-12) for k, p in want.items())


def test_words_are_aligned_without_rows_of_cooccurrences(spark, sf, monkeypatch):
    """dealt out by made word, as brute force has it; ties, unknown, repeated, empty and null words included."""
    odd = [(-1, ["a", "a", "b", None, ""], ["u", "u", None, "v", "new"]), (-2, ["b", "a"], []), (-3, [], ["u", "u"]), (-4, None, ["v", ""]), (-5, ["a"], None)]
    kinds = "pair_id long, x array<string>, y array<string>"
    pairs = D.pairs(spark, sf).select("pair_id", F.split("hyp", " ").alias("x"), F.split("toxic", " ").alias("y")).unionByName(
        spark.createDataFrame(odd, kinds))
    fitted = AL.fit_alignment(pairs.where("pair_id >= 0"), "x", "y").unionByName(spark.createDataFrame(
        [("a", "u", 0.25), ("b", "u", 0.25 + 2e-10), ("b", "v", 0.5), ("a", "v", 0.4), ("zz", "v", 0.9)], "given string, made string, p double"))
    p = {(r.given, r.made): (r.p, r.r) for r in fitted.select("*", F.round("p", 9).alias("r")).collect()}
    want = {}
    for r in pairs.collect():
        for pos, word in enumerate(r.y or []):
            if word is not None:
                known = {g: p.get((g, word), (0.0, 0.0)) for g in ["", *[g for g in r.x or [] if g is not None]]}
                source = min(known, key=lambda g: (-known[g][1], g))
                want[r.pair_id, pos] = (word, source, known[source][0])
    assert want[-1, 0] == ("u", "a", 0.25) and want[-1, 3] == ("v", "b", 0.5) and want[-1, 4] == ("new", "", 0.0)
    for cells in (AL.CELLS, 20):
        monkeypatch.setattr(AL, "CELLS", cells)
        got = AL.aligned_words(pairs, fitted, "x", "y")
        assert {(r.pair_id, r.pos): (r.word, r.source, r.p) for r in got.collect()} == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and "explode(g" not in plan
    assert AL.aligned_words(pairs.limit(0), fitted, "x", "y").collect() == []
