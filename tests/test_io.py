import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from parasol.operators.runs import log_line
from parasol.sources import io as IO

LOG_LINES = [
    "Epoch 1: Loss 1.2500, BLEU 0.1000, STA 0.2000, SIM 0.3000, FL 0.4000, J 0.0240",
    "Epoch 2: Loss 1.0000, BLEU 0.1500, STA 0.2500, SIM 0.3500, FL 0.4500, J 0.0394",
    "Epoch 10: Loss 0.7500, BLEU 0.0000, STA 1.0000, SIM 0.5000, FL 1.0000, J 0.5000",
    "Epoch 11: Loss NaN, BLEU 0.5000, STA 0.5000, SIM 0.5000, FL 0.5000, J 0.1250",
]


def test_tsv_round_trip(spark):
    d = tempfile.mkdtemp(prefix="parasol-tsv-")
    rows = [(1, 'a "q" b', "x"), (2, "tab\there", "y"), (3, "line\nbreak", "z"), (4, "", "w"), (5, "NA", "null")]
    IO.write_pairs(spark.createDataFrame(rows, "pair_id long, toxic string, neutral1 string"), os.path.join(d, "p"))
    ok, bad = IO.read_pairs(spark, os.path.join(d, "p"), multi_line=True)
    got = {r.pair_id: (r.toxic, r.neutral1) for r in ok.collect()}
    assert got == {1: ('a "q" b', "x"), 2: ("tab\there", "y"), 3: ("line\nbreak", "z"), 5: ("NA", "null")}
    assert [r.pair_id for r in bad.collect()] == [4]


@pytest.mark.parametrize("header, line", [("toxic\tneutral1", "{0}\t{1}"), ("x\ttoxic\ty\tneutral1", "7\t{0}\tq\t{1}")])
def test_pairs_by_column_name(spark, tmp_path, header, line):
    rows = [("you clown", "you person"), ("b", "c"), ("b", "c"), ("", "w"), ("NA", "null")]
    (tmp_path / "p.tsv").write_text("\n".join([header, *(line.format(*r) for r in rows)]) + "\n")
    ok, bad = IO.read_pairs(spark, str(tmp_path / "p.tsv"))
    got = sorted((r.toxic, r.neutral1) for r in ok.collect())
    assert got == sorted(r for r in rows if r[0])
    ids = {r.pair_id: (r.toxic, r.neutral1) for r in ok.collect()}
    assert len(ids) == 4 and bad.count() == 1
    (tmp_path / "q.tsv").write_text("\n".join([header, *(line.format(*r) for r in rows[::-1])]) + "\n")
    again, _ = IO.read_pairs(spark, str(tmp_path / "q.tsv"))
    assert {r.pair_id: (r.toxic, r.neutral1) for r in again.collect()} == ids
    with pytest.raises(ValueError):
        IO.read_pairs(spark, str(tmp_path / "q.tsv"), source="none")


def test_log_round_trip(spark, tmp_path):
    for folder in ("run_id=r1", "2025-02-03,04-05-06"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "metrics.txt").write_text("\n".join([*LOG_LINES, "", "not a line"]) + "\n")
    typed = IO.read_metrics_log(spark, str(tmp_path))
    assert {r.run_id for r in typed.collect()} == {"r1", "2025-02-03,04-05-06"}
    back = typed.where(F.col("run_id") == "r1").withColumn("epoch", F.col("epoch") - 1).select(log_line().alias("l"))
    assert sorted(r.l for r in back.collect()) == sorted(LOG_LINES)
    assert sorted(r.value for r in IO.rejected_log_lines(spark, str(tmp_path)).collect()) == ["", "", "not a line", "not a line"]


def test_written_log_keeps_order_and_run(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("a:b", e, 1.0 / (e + 1), 0.1, 0.2, 0.3, 0.4, 0.5) for e in range(12)] + [("50%+x", 0, float("nan"), *[0.5] * 5)]
    df = spark.createDataFrame(rows, "run_id string, epoch int, loss double, bleu double, sta double, sim double, fl double, j double")
    IO.write_metrics_log(df.repartition(5), path)
    got = IO.read_metrics_log(spark, path).collect()
    assert sorted((r.run_id, r.epoch) for r in got) == sorted((r[0], r[1] + 1) for r in rows)
    assert math.isnan(next(r.loss for r in got if r.run_id == "50%+x"))
    lines = next(p.read_text() for d in (tmp_path / "log").glob("run_id=a*") for p in d.glob("part-*"))
    assert [int(x.split()[1][:-1]) for x in lines.splitlines()] == list(range(1, 13))


def test_run_stamp(spark):
    v = spark.range(1).select(IO.run_stamp(F.to_timestamp(F.lit("2025-02-03 04:05:06"))).alias("v")).first().v
    assert v == "2025-02-03,04-05-06"


def test_snapshot_every_k(spark):
    d = tempfile.mkdtemp(prefix="parasol-snap-")
    t = spark.createDataFrame([("a", 1.0)], "token string, w double")
    written = [IO.write_snapshot({"w": t}, d, "run", e, every=2) for e in range(4)]
    assert written == [True, False, True, False]
    assert IO.read_snapshot(spark, d, "w", "run", 2).collect()[0].token == "a"
    assert IO.read_snapshot(spark, d, "w", "run", 1).count() == 0


def test_writing_again_replaces(spark, tmp_path):
    t = spark.createDataFrame([("a", 1.0)], "token string, w double")
    for _ in range(2):
        for e in (0, 1):
            IO.write_snapshot({"w": t}, str(tmp_path / "s"), "run", e)
    assert IO.read_snapshot(spark, str(tmp_path / "s"), "w", "run", 0).count() == 1
    assert IO.read_snapshot(spark, str(tmp_path / "s"), "w", "run", 1).count() == 1
    p = spark.createDataFrame([("r", 1, "x")], "run_id string, pair_id long, text string")
    for _ in range(2):
        IO.write_predictions(p, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
