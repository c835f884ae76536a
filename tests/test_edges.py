"""Overflow, hot keys, degenerate fits and other edges."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parasol.operators import decode as DEC
from parasol.operators.bleu import sentence_bleu
from parasol.operators import encode as ENC
from parasol.operators import judges as JU
from parasol.operators import rewards as RW
from parasol.operators import rewrite as RE
from parasol.operators import split as SP
from parasol.operators.vectors import NamedVectors, TokenVectors
from parasol.plans import derived as D


def test_error_mode_fails(spark):
    vocab = spark.createDataFrame([("a", 3, 5)], "token string, id int, n long")
    df = spark.createDataFrame([(1, ["a"] * 50)], "pair_id long, tokens array<string>")
    ok, _ = ENC.encode(df, vocab, "pair_id", {"ids": "tokens"}, overflow="error")
    with pytest.raises(PySparkException):
        ok.collect()
    ids = spark.createDataFrame([(1, list(range(50)))], "pair_id long, ids array<int>")
    with pytest.raises(PySparkException):
        ENC.length_gate(ids, "ids", overflow="error")[0].collect()


def test_every_sentence_is_read(spark, sf):
    sizes = [r.n for r in D.sentences(spark, sf).select(F.size("tokens").alias("n")).collect()]
    assert min(sizes) == 1 and max(sizes) > 36


def test_ids_fail_rather_than_collide(spark, tmp_path):
    path = tmp_path / "conversations.parquet"
    spark.createDataFrame([(1, D.SEQ_ID_STRIDE, "a b")], "conv_id long, turn long, text string").write.parquet(str(path))
    with pytest.raises(PySparkException):
        D.turn_tokens(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("mode", ["delete", "replace"])
def test_rewrite_alike_at_any_lexicon_size(spark, monkeypatch, mode):
    rows = [(1, ["a", "x"]), (1, ["b"]), (1, ["b"]), (2, None), (3, []), (None, ["x"]), (4, [None, "x", "a"])]
    df = spark.createDataFrame(rows, "k long, toks array<string>")
    lex = spark.createDataFrame([("x", "y")], "token string, tgt string")

    def run():
        return sorted(((r.k, r.toks, r.text) for r in RE.rewrite(df, "k", "toks", lex, mode).collect()), key=repr)
    inline = run()
    monkeypatch.setattr(RE, "INLINE_MAX", 0)
    assert run() == inline
    assert (2, None, None) in inline and len(inline) == len(rows)


def test_lexicon_without_positive_documents(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    assert RE.detox_lexicon(docs, labels.where("toxic = 0")).count() == 0


def test_one_class_fits(spark, sf):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    one = JU.fit_nb(docs, labels.where("toxic = 0"), "toxic")
    assert one.prior < 0 and JU.fit_nb_many(docs, labels.where("toxic = 1"), ["toxic"])["toxic"].prior > 0
    assert JU.fit_nb(docs, labels.limit(0), "toxic").prior == 0


@pytest.mark.parametrize("window_rows", [100, DEC.WINDOW_ROWS])
def test_hot_context(spark, monkeypatch, window_rows):
    """One context holds half of the rows: ranks, sums and draws as for any."""
    monkeypatch.setattr(DEC, "WINDOW_ROWS", window_rows)
    rows = [("hot", f"{chr(97 + i % 26)}{i:04d}", 1 + i % 7) for i in range(2000)]
    rows += [(f"c{i}", "t", 3) for i in range(2000)]
    counts = spark.createDataFrame(rows, "ctx string, token string, n long")
    total = sum(n for c, _, n in rows if c == "hot")
    ranked = sorted(((c, t, n) for c, t, n in rows if c == "hot"), key=lambda r: (-r[2], r[1]))
    got = {r.token: (r["rank"], r.prob) for r in DEC.bigram_probs(counts).where("ctx = 'hot'").collect()}
    assert got == {t: (i + 1, n / total) for i, (_, t, n) in enumerate(ranked)}
    table = {r.token: (r.cum_lo, r.cum_hi) for r in DEC.sample_table(counts).where("ctx = 'hot'").collect()}
    at = 0
    for _, t, n in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1]):
        assert table[t] == (at, at + n)
        at += n


def test_buckets_follow_the_rows():
    assert SP.hex_digits(10) == SP.hex_digits(16 ** 3 * SP.ROWS_PER_BUCKET) == 3
    assert SP.hex_digits(10 ** 12) == 6


def test_val_batches_are_unshuffled(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "pair_id")
    split = {r.pair_id: r.split_rank for r in SP.random_split(df).where("split = 'val'").collect()}
    got = {r.pair_id: r.batch_id for r in SP.split_batches(df, "val").collect()}
    assert got == {i: (rank - 1) // 16 for i, rank in split.items()}


def test_named_vectors(spark):
    tv = NamedVectors(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "token string, vector array<float>"))
    c = spark.createDataFrame([(1, "greedy", "a b", "a"), (2, "greedy", "", "a"), (3, "greedy", "zz", "b a")],
                              "seq_id long, kind string, text string, gold string")
    got = {r.seq_id: (r.p, r.r) for r in RW.bert_score(c, tv).collect()}
    assert got == {1: (0.5, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}


def test_match_by_ids_equals_match_by_join(spark, sf):
    tv = TokenVectors(D.table(spark, sf, "embeddings"))
    c = D.candidates(spark, sf)
    small = {(r.seq_id, r.kind): (r.p, r.r) for r in RW.bert_score(c, tv).collect()}
    tv.small = False
    joined = {(r.seq_id, r.kind): (r.p, r.r) for r in RW.bert_score(c, tv).collect()}
    assert small.keys() == joined.keys()
    assert all(small[k] == pytest.approx(joined[k], abs=1e-9) for k in small)


def test_gaps_in_vector_ids_are_told(spark):
    with pytest.raises(ValueError):
        TokenVectors(spark.createDataFrame([(0, [1.0]), (2, [1.0])], "vec_id long, embedding array<float>"))


def test_stream_goes_on_until_stopped(spark, tmp_path):
    from parasol.streaming import streams as ST
    rows = spark.createDataFrame([(1, "a x b")], ST.SENTENCE_SCHEMA)
    rows.write.parquet(str(tmp_path / "src"))
    q = ST.rewrite_stream(spark, str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck"), words=["x"],
                          trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        assert q.isActive
        assert [r.rewritten for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == ["a b"]
    finally:
        q.stop()


def test_large_maps_in_streams(spark, tmp_path, monkeypatch):
    from parasol.streaming import streams as ST
    monkeypatch.setattr(ST, "INLINE_MAX", 0)
    spark.createDataFrame([(1, "a x b")], ST.SENTENCE_SCHEMA).write.parquet(str(tmp_path / "src"))
    ST.rewrite_stream(spark, str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "ck"), mapping={"x": "y"})
    assert [r.rewritten for r in spark.read.parquet(str(tmp_path / "sink")).collect()] == ["a y b"]


def test_empty_embeddings_give_null_vectors(spark, sf):
    from parasol.operators import metrics as ME
    from parasol.operators.vectors import sentence_embeddings
    tv = TokenVectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k long, t array<string>")
    for small in (True, False):
        tv.small = small
        assert [r.e for r in sentence_embeddings(rows, "k", {"e": "t"}, tv).collect()] == [None] * 3
    tv.small = True
    c = spark.createDataFrame([(1, "greedy", "a b", "a")], "seq_id long, kind string, text string, gold string")
    assert [(r.p, r.r) for r in RW.bert_score(c, tv).collect()] == [(0.0, 0.0)]
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    both = JU.fit_nb_many(docs, labels, ["toxic", "quality"])
    df = spark.createDataFrame([(1, "a b", "a", "a b")], "pair_id long, x string, y_pred string, y_real string")
    scored = ME.row_scores(df, ME.Scorers(both["toxic"], both["quality"], tv))
    m = ME.batch_metrics(scored, df.selectExpr("pair_id", "0 AS batch_id"), tv.dim, group=("batch_id",)).first()
    assert m.sim is None and m.bleu is not None


def test_row_scores_by_any_keys(spark, sf):
    """Keys that read alike when joined, and null keys, are rows of their own."""
    from parasol.operators import metrics as ME
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    both = JU.fit_nb_many(docs, labels, ["toxic", "quality"])
    sc = ME.Scorers(both["toxic"], both["quality"], TokenVectors(D.table(spark, sf, "embeddings")))
    rows = [(1, None, "a", "u v w x", "u v w x", "u v w x"), (1, "a", None, "u v w x", "x", "u v w x"), (1, "a", "a", "q", "q rst u", "q rst v")]
    df = spark.createDataFrame(rows, "pair_id long, run_id string, epoch string, x string, y_pred string, y_real string")
    got = {(r.run_id, r.epoch): r.bleu for r in ME.row_scores(df, sc, keys=("run_id", "epoch")).collect()}
    assert got == {(r[1], r[2]): pytest.approx(sentence_bleu(r[4], r[5])) for r in rows}


def test_scores_in_place_equal_scores_by_join(spark, sf, monkeypatch):
    from parasol.operators import metrics as ME
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    rows = [(1, ["idiot", "the", "zzz", None]), (2, []), (3, None), (4, ["the"] * 5000)]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    pairs = D.pairs(spark, sf).select("pair_id", F.col("toxic").alias("x"), F.col("hyp").alias("y_pred"), F.col("neutral1").alias("y_real"))
    got = []
    for limit in (JU.SENT_WEIGHTS, 0):
        monkeypatch.setattr(JU, "SENT_WEIGHTS", limit)
        both = JU.fit_nb_many(docs, labels, ["toxic", "quality"])
        sc = ME.Scorers(both["toxic"], both["quality"], TokenVectors(D.table(spark, sf, "embeddings")))
        got.append({r.k: r.p for r in JU.score_tokens(df, "k", {"p": "t"}, both["toxic"]).collect()}
                   | {("s", r.pair_id): (r.bleu, r.p_toxic, r.p_fluent, r.fl_label, sum(r.x_emb)) for r in ME.row_scores(pairs, sc).collect()})
    assert got[0].keys() == got[1].keys()
    for k, v in got[0].items():
        w = got[1][k]
        assert v == pytest.approx(w, abs=1e-12) if not isinstance(v, tuple) else (
            v[3] == w[3] and v[:3] + v[4:] == pytest.approx(w[:3] + w[4:], abs=1e-9))
