"""Streams that are stopped and go on, snapshots that were cut off, fits in steps."""

import pytest
from pyspark.sql import functions as F

from parasol.operators import judges as JU
from parasol.operators import metrics as ME
from parasol.operators import resume as RS
from parasol.operators import rewrite as RE
from parasol.plans import derived as D
from parasol.sources import io as IO
from parasol.streaming import streams as ST

ROWS = "batch_id long, n_rows long, pair_id long, bleu double, p_toxic double, fl_label string, x_emb array<double>, y_emb array<double>"


def scored_rows(n=50, size=16):
    out = []
    for i in range(n):
        b = i // size
        vec = [1.0 + i % 3, float(i % 5), -0.5]
        out.append((b, min(size, n - b * size), i, (i % 7) / 7, (i % 11) / 10, "LABEL_1" if i % 3 else "LABEL_0", vec, vec[::-1] if i % 4 else None))
    return out


def stored_metrics(spark, sink):
    return {r.batch_id: tuple(None if v is None else round(v, 9) for v in (r.n_rows, r.bleu, r.sta, r.sim, r.fl, r.j))
            for r in spark.read.parquet(sink).collect()}


def test_batch_metrics_go_on_after_a_restart(spark, tmp_path):
    rows = scored_rows()
    df = spark.createDataFrame(rows, ROWS)
    want_df = ME.batch_metrics(df.drop("batch_id", "n_rows"), df.select("batch_id", "pair_id"), 3, group=("batch_id",))
    want = {r.batch_id: tuple(round(v, 9) for v in (r.n_rows, r.bleu, r.sta, r.sim, r.fl, r.j)) for r in want_df.collect()}
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    # rows of all batches in every file, so that batches stay open between runs
    parts = [df.where(F.pmod("pair_id", F.lit(5)) == k) for k in range(5)]
    for part in parts[:3]:
        part.coalesce(1).write.mode("append").parquet(src)
    ST.batch_metrics_stream(spark, src, sink, ck, schema=df.schema)
    assert len(spark.read.schema("batch_id long").parquet(sink).collect()) == 0       # none is full yet
    for part in parts[3:]:
        part.coalesce(1).write.mode("append").parquet(src)
    ST.batch_metrics_stream(spark, src, sink, ck, schema=df.schema)
    assert stored_metrics(spark, sink) == want
    ST.batch_metrics_stream(spark, src, sink, ck, schema=df.schema)                   # nothing new: nothing twice
    assert spark.read.parquet(sink).count() == len(want)


def test_newest_complete_lexicon(spark, tmp_path):
    src, sink, ck, snaps = (str(tmp_path / x) for x in ("src", "sink", "ck", "snaps"))
    lexicon = spark.createDataFrame([("a",), ("b",)], "token string")

    def arrive(i):
        spark.createDataFrame([(i, "A a, b! c"), (-i, None)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        ST.newest_lexicon_stream(spark, src, sink, ck, snaps, "r")
    arrive(1)                                                  # no snapshot yet
    IO.write_snapshot({"lexicon": lexicon.where("token = 'a'")}, snaps, "r", 3)
    arrive(2)                                                  # written, not committed
    IO.commit_snapshot(spark, snaps, "r", 3)
    IO.write_snapshot({"lexicon": lexicon}, snaps, "other", 9)
    IO.commit_snapshot(spark, snaps, "other", 9)
    arrive(4)
    IO.write_snapshot({"lexicon": lexicon}, snaps, "r", 5)
    IO.commit_snapshot(spark, snaps, "r", 5)
    arrive(6)
    got = {r.doc_id: (r.epoch, r.rewritten) for r in spark.read.parquet(sink).collect()}
    texts = {1: (None, "A a, b! c"), 2: (None, "A a, b! c"), 4: (3, " , b! c"), 6: (5, " , ! c")}
    assert got == texts | {-i: (e, None) for i, (e, _) in texts.items()}


def test_a_batch_that_is_played_again_keeps_its_lexicon(spark, tmp_path, monkeypatch):
    src, sink, ck, snaps = (str(tmp_path / x) for x in ("src", "sink", "ck", "snaps"))
    for epoch, word in ((0, "a"), (1, "b")):
        IO.write_snapshot({"lexicon": spark.createDataFrame([(word,)], "token string")}, snaps, "r", epoch)
    IO.commit_snapshot(spark, snaps, "r", 0)
    spark.createDataFrame([(1, "a b")], "doc_id long, text string").coalesce(1).write.parquet(src)

    def fails(*args, **kw):
        raise RuntimeError("lost")
    monkeypatch.setattr(ST, "rewrite_text", fails)
    with pytest.raises(Exception):
        ST.newest_lexicon_stream(spark, src, sink, ck, snaps, "r")
    monkeypatch.setattr(ST, "rewrite_text", RE.rewrite_text)
    IO.commit_snapshot(spark, snaps, "r", 1)
    ST.newest_lexicon_stream(spark, src, sink, ck, snaps, "r")
    assert [(r.epoch, r.rewritten) for r in spark.read.parquet(sink).collect()] == [(0, " b")]


def test_two_steps_equal_one_fit(spark, sf, tmp_path):
    docs, labels = D.table(spark, sf, "documents"), D.table(spark, sf, "labels")
    src, path = str(tmp_path / "src"), str(tmp_path / "model")
    with pytest.raises(ValueError):
        RS.resumed_model(spark, path, "r")
    for k in range(3):
        docs.where(F.pmod("doc_id", F.lit(3)) == k).write.mode("append").parquet(src)
        if k == 1:    # a step that was cut off before its mark: counted again
            IO.write_snapshot({"counts": spark.createDataFrame([("junk", 5, 5)], "token string, a long, b long"),
                               "classes": spark.createDataFrame([(5, 9)], "positive long, n long")}, path, "r", 1)
        assert RS.fit_step(spark, [src], labels, path, "r") == k
    assert RS.fit_step(spark, [src], labels, path, "r") is None
    model, whole = RS.resumed_model(spark, path, "r"), JU.fit_nb(docs, labels, "toxic")
    assert model.prior == pytest.approx(whole.prior, rel=1e-12)
    got, want = ({r.token: r.w for r in m.weights.collect()} for m in (model, whole))
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], rel=1e-9) for t in want)
    assert IO.latest_snapshot(spark, path, "r") == 2 and IO.latest_snapshot(spark, path, "none") is None
