from pyspark.sql import functions as F

from parasol.functions.text import tokenize
from parasol.operators import encode as ENC
from parasol.plans import derived as D


def _vocab(spark):
    return spark.createDataFrame([("a", 3, 5), ("b", 4, 2)], "token string, id int, n long")


def test_encode_pad_and_unknown(spark):
    df = spark.createDataFrame([(1, ["a", "b", "zz"])], "pair_id long, tokens array<string>")
    ok, rej = ENC.encode(df, _vocab(spark), "pair_id", {"ids": "tokens"}, max_length=8)
    assert ok.first().ids == [0, 3, 4, 2, 1, 1, 1, 1]
    assert rej.count() == 0


def test_length_gate_rejects_39(spark):
    df = spark.createDataFrame([(1, ["a"] * 37), (2, ["a"] * 36)], "pair_id long, tokens array<string>")
    ok, rej = ENC.encode(df, _vocab(spark), "pair_id", {"ids": "tokens"}, max_length=38)
    assert [r.pair_id for r in ok.collect()] == [2]
    assert [(r.pair_id, r.reason) for r in rej.collect()] == [(1, "too_long")]
    ok2, _ = ENC.encode(df, _vocab(spark), "pair_id", {"ids": "tokens"}, max_length=38, overflow="truncate")
    assert all(len(r.ids) == 38 and r.ids[-1] == 1 for r in ok2.collect())


def test_decode_round_trip(spark):
    df = spark.createDataFrame([(1, ["b", "a", "a"])], "pair_id long, tokens array<string>")
    ok, _ = ENC.encode(df, _vocab(spark), "pair_id", {"ids": "tokens"}, max_length=8)
    assert ENC.decode(ok, _vocab(spark), "pair_id", "ids").first().text == "b a a"


def test_build_vocab_order(spark):
    df = spark.createDataFrame([(["b", "a", "c", "b"],), (["c", "b"],)], "tokens array<string>")
    v = {r.token: r.id for r in ENC.build_vocab(df).collect()}
    assert v == {"b": 3, "c": 4, "a": 5}


def test_vocab_rank_across_count_bands(spark):
    # counts on both sides of the exact-count limit, ties inside a power-of-two band
    counts = {"aa": 5000, "zz": 5000, "mm": 3000, "bb": 2048, "cc": 1500, "dd": 1023, "ab": 1023, "e": 1, "d": 1}
    rows = [([t],) for t, n in counts.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "tokens array<string>")
    got = {r.token: r.id for r in ENC.build_vocab(df).collect()}
    want = sorted(counts, key=lambda t: (-counts[t], t))
    assert got == {t: i + 3 for i, t in enumerate(want)}


def test_tokens_of_the_vocabulary_are_made_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s = D.sentences(spark, sf)
    gold = F.when(D.holds_listed("tokens"), D.neutral_tokens("tokens")).otherwise(F.array().cast("array<string>"))
    counts = [df.select(F.explode("tokens").alias("token")).groupBy("token").count()
              for df in (s.select(F.concat("tokens", gold).alias("tokens")), D.pair_vocabulary_tokens(spark, sf))]
    assert sorted(counts[0].collect()) == sorted(counts[1].collect())
    texts = spark.createDataFrame([("You IDIOT",), ("idi. ot",), (None,), ("",)], "text string")
    assert [bool(r[0]) for r in texts.select(D.may_hold_listed("text")).collect()] == [True, False, False, False]
    # the filter that Spark puts below an explode of a column would tokenise every text again
    plan = ENC.counted(docs.select(tokenize("text").alias("tokens")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
