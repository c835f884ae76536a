"""Batch metrics and judges at size: what is shuffled, what is sent."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parasol.operators import judges as JU
from parasol.operators import metrics as ME
from parasol.operators import rewards as RW
from parasol.operators.vectors import TokenVectors, row_numbers
from parasol.plans import derived as D


@pytest.fixture(scope="module")
def scorers(spark, sf):
    both = JU.fit_nb_many(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), ["toxic", "quality"])
    return lambda: ME.Scorers(both["toxic"], both["quality"], TokenVectors(D.table(spark, sf, "embeddings")))


def texts(df):
    return D.paired(df).select("pair_id", "batch_id", F.col("toxic").alias("x"), F.col("hyp").alias("y_pred"), F.col("neutral1").alias("y_real"))


def test_batches_are_dealt_before_they_are_scored(spark, sf, scorers):
    sc = scorers()
    rows = D.sentence_texts(spark, sf).where("pair_id % 17 = 3")
    batches = rows.select("pair_id", F.pmod("pair_id", F.lit(13)).alias("batch_id"))
    dealt = ME.deal(rows, batches)
    tasks = dealt.select("batch_id", F.spark_partition_id().alias("task"))
    assert tasks.groupBy("batch_id").agg(F.countDistinct("task").alias("n")).where("n > 1").count() == 0
    got = ME.batch_metrics(ME.row_scores(texts(dealt), sc, keys=["batch_id"]), None, sc.vectors.dim, group=("batch_id",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    want = {}
    for r in ME.row_scores(texts(rows.join(batches, "pair_id")), sc, keys=["batch_id"]).collect():
        want.setdefault(r.batch_id, []).append(r)
    for r in got.collect():
        x, y = (np.mean([getattr(w, c) for w in want[r.batch_id] if getattr(w, c) is not None], axis=0) for c in ("x_emb", "y_emb"))
        assert r.n_rows == len(want[r.batch_id])
        assert r.sim == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)), abs=1e-9)
    # cosines of rows are made before their join with the batches
    pair = ME.batch_metrics(ME.row_scores(texts(rows.join(batches, "pair_id")).drop("batch_id"), sc), batches, sc.vectors.dim,
                            group=("batch_id",), sim_mode="pair")
    join = pair._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert "_emb" not in join
    assert pair.count() == len(want)


def test_parts_in_place_and_by_join_agree(spark, sf, scorers, monkeypatch):
    rows = texts(D.sentence_texts(spark, sf).where("pair_id % 17 = 3").withColumn("batch_id", F.lit(0)))
    found = []
    for limit, small in ((JU.SENT_WEIGHTS, True), (JU.SENT_WEIGHTS, False), (0, True), (0, False)):
        monkeypatch.setattr(JU, "SENT_WEIGHTS", limit)
        sc = scorers()
        for m in (sc.toxicity, sc.fluency):
            m.__dict__.pop("_logit", None)
        sc.vectors.small = small
        found.append({r.pair_id: (r.bleu, r.p_toxic, r.p_fluent, sum(r.x_emb or [0])) for r in ME.row_scores(rows, sc).collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[k] == pytest.approx(v, abs=1e-9) for k, v in found[0].items())


def test_sent_weights_are_numbers_only():
    """24 bytes a token: a worker holds no words."""
    words = ["idiot", "the", "ß", "zz"]
    sent = JU._sorted_weights(pa.table({"token": words, "w": [1.0, 2.0, 3.0, 4.0]}))
    assert sum(a.nbytes for a in sent) == 24 * len(words)
    assert JU._looked_up(np.array(["zz", "unknown", "idiot", ""], dtype=object), sent).tolist() == [4.0, 0.0, 1.0, 0.0]
    assert JU._looked_up(np.array(["a"], dtype=object), JU._sorted_weights(pa.table({"token": pa.array([], pa.string()), "w": pa.array([], pa.float64())}))).tolist() == [0.0]


def test_bootstrap_draws_once_per_key(spark, monkeypatch):
    """Rows aren't copied for each replicate, and groups share their keys' draws."""
    from parasol.operators import intervals as IV
    rows = [(k, g, 1.0 * k if k % 3 else None) for k in range(50) for g in "abc"]
    df = spark.createDataFrame(rows, "k long, g string, v double")
    got = IV.bootstrap_sums(df, "k", ["v"], ["g"], replicates=20)
    assert "explode" not in got._jdf.queryExecution().optimizedPlan().toString()
    weights = {(r.k, i): r[f"w{i}"] for r in spark.range(50).select(F.col("id").alias("k"), *[
        IV.poisson_weight(F.concat(F.lit(f"42:{i}:"), F.col("id").cast("string"))).alias(f"w{i}") for i in range(20)]).collect() for i in range(20)}
    for r in got.collect():
        ws = {k: weights[k, r.replicate] for k in range(50)}
        assert r.n == sum(ws.values())
        assert r.v == pytest.approx(sum(w * k for k, w in ws.items() if k % 3) / sum(w for k, w in ws.items() if k % 3))
    seen = []
    drawn = IV._drawn_weights
    monkeypatch.setattr(IV, "_drawn_weights", lambda keys, *a: seen.append(len(keys)) or drawn(keys, *a))
    batch = pa.RecordBatch.from_pylist([{"g": g, "_k": str(k), "_v0": v} for k, g, v in rows])
    list(IV._partial_sums(["g"], ["v"], 20, 42)([batch]))
    assert seen == [50]


def test_full_batches_need_no_state(spark, tmp_path):
    """Batches that a task sees whole are finished many at a time; the others wait in the state."""
    from parasol.streaming import streams as ST
    kinds = "pair_id long, batch_id long, n_rows long, bleu double, p_toxic double, fl_label string, x_emb array<double>, y_emb array<double>"
    rows = [(i, i // 4, 4, i / 100 if i % 5 else None, i / 200, "LABEL_1" if i % 2 else None, [1.0 * i, 2.0] if i % 3 else None, [2.0, 1.0 * i])
            for i in range(120)]
    df = spark.createDataFrame(rows, kinds)
    src, sink, ck = (str(tmp_path / x) for x in ("src", "sink", "ck"))
    apart = F.col("batch_id") % 10 == 0     # the rows of these batches come in two files
    df.where(~apart | (F.col("pair_id") % 2 == 0)).coalesce(1).write.mode("append").parquet(src)
    q = ST.batch_metrics_stream(spark, src, sink, ck)
    assert [o.numRowsTotal for o in q.lastProgress.stateOperators] == [3]
    assert spark.read.parquet(sink).count() == 27
    df.where(apart & (F.col("pair_id") % 2 == 1)).coalesce(1).write.mode("append").parquet(src)
    ST.batch_metrics_stream(spark, src, sink, ck)
    want = {r.batch_id: r for r in ME.batch_metrics(df, None, 2, group=("batch_id",)).collect()}
    got = spark.read.parquet(sink).collect()
    assert len(got) == len(want) == 30
    for r in got:
        for c in ("n_rows", *ME.METRICS):
            assert getattr(r, c) == (None if want[r.batch_id][c] is None else pytest.approx(want[r.batch_id][c], abs=1e-9)), (r, c)


def test_rows_are_matched_by_sizes_and_not_one_by_one(spark, sf, monkeypatch):
    """rows of equal sizes are one product, in pieces; long rows and empty sides included."""
    tv = TokenVectors(D.table(spark, sf, "embeddings"))
    words = [f"w{i}" for i in range(50)] + ["ß", "zoé"]
    rng = np.random.default_rng(3)
    rows = [[list(rng.choice(words, n)) if n is not None else None for n in sizes]
            for sizes in ((3, 4), (4, 3), (3, 4), (0, 2), (2, 0), (None, 1), (1, None), (7, 7), (300, 5), (5, 300), (3, 4))]
    ids = spark.createDataFrame([(w,) for w in words], "w string").select("w", tv.vec_id(F.col("w")).alias("i")).toPandas()
    assert list(row_numbers(pa.array(ids.w), tv.n)) == list(ids.i)
    unit, at = tv.unit_matrix(), dict(zip(ids.w, ids.i))
    want = []
    for c, g in rows:
        sim = unit[[at[w] for w in c]] @ unit[[at[w] for w in g]].T if c and g else None
        want.append((sim.max(axis=1).mean(), sim.max(axis=0).mean()) if c and g else (0, 0))
    sides = [pa.array(x, pa.list_(pa.string())) for x in zip(*rows)]
    alone = []
    monkeypatch.setattr(RW, "_matched_long", lambda *a, f=RW._matched_long: alone.append(1) or f(*a))
    for piece in (RW.MATCH_PIECE, 1):
        monkeypatch.setattr(RW, "MATCH_PIECE", piece)
        assert np.allclose(RW.matched(*sides, unit), want, rtol=0, atol=1e-12)
    assert np.allclose(RW.matched(*[x.slice(4) for x in sides], unit), want[4:], rtol=0, atol=1e-12)
    assert len(alone) == 6
    assert RW.matched(*[x.slice(0, 0) for x in sides], unit).shape == (0, 2)


def test_a_micro_batch_of_few_files_is_read_by_many_tasks(spark, sf, tmp_path, monkeypatch):
    """the files of a stream have row groups of a small size, so two files are more than two tasks' work."""
    from parasol.plans import queries as Q
    monkeypatch.setattr(Q, "ROW_GROUP_BYTES", 1 << 14)
    docs = D.table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.union(docs).union(docs).coalesce(1)
    path = str(tmp_path / "src")
    Q._stream_files(docs, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 16)
    try:
        used = spark.read.parquet(path).groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert used > 2 and spark.read.parquet(path).count() == docs.count()


def test_larger_embeddings_are_a_file_of_every_executor(spark, sf, scorers, monkeypatch):
    """Beyond the broadcast's size no token is exploded, joined or shuffled; the file has the same numbers."""
    from parasol.operators import vectors as V
    rows = texts(D.sentence_texts(spark, sf).where("pair_id % 17 = 3").withColumn("batch_id", F.pmod("pair_id", F.lit(5))))
    cands = D.candidates(spark, sf)

    def found(tv):
        sc = scorers()
        sc.vectors = tv
        scored = ME.row_scores(rows, sc, keys=["batch_id"], parts=("vectors",))
        bert = RW.bert_score(cands, tv)
        plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (scored, bert)]
        return plans, {r.pair_id: (r.x_emb, r.y_emb) for r in scored.collect()}, {(r.seq_id, r.kind): (r.p, r.r, r.f1) for r in bert.collect()}
    emb = D.table(spark, sf, "embeddings")
    small = found(TokenVectors(emb))
    monkeypatch.setattr(V, "BROADCAST_MAX_BYTES", 64 * 8 * 90)     # 500 rows in six pieces, the last one shorter
    tv = TokenVectors(emb)
    assert not tv.small
    plans, vectors, scores = found(tv)
    assert all("Join" not in p and "Aggregate" not in p for p in plans)
    assert vectors == small[1] and scores == small[2]
    # vectors that are no matrix, and tables beyond the file's size, are joined
    monkeypatch.setattr(V, "FILE_MAX_BYTES", 0)
    plans, vectors, scores = found(TokenVectors(emb))
    assert all("Join" in p for p in plans)
    assert vectors.keys() == small[1].keys() and scores.keys() == small[2].keys()
    for k, sides in small[1].items():
        assert all((a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=0, atol=1e-9)) for a, b in zip(sides, vectors[k]))
    assert all(scores[k] == pytest.approx(v, abs=1e-9) for k, v in small[2].items())
    for bad in ([None], [[1.0, None]], [[1.0]]):
        assert not TokenVectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, bad[0])], "vec_id long, embedding array<float>")).in_place
