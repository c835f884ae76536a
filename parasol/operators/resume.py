"""A judge's fit that goes on (R1, S6): counts per step, resumed from the last
complete one.

The judge is a table of counts, and counts of different files add up. Each
step counts the words of the files that no complete step has read, writes them
as a snapshot of its own and marks it complete together with the names of its
files. A step that was cut off has no mark and is counted again; the model is
the sum over all complete steps, equal to one fit over all files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.operators.judges import NBModel, _prior, labelled_tokens
from parasol.session import cut_lineage
from parasol.sources import io as IO


def files_read(spark: SparkSession, path: str, run_id: str) -> set[str]:
    """Names of the files that the run's complete steps have read."""
    return {f for r in IO.complete_snapshots(spark, path, run_id).collect() for f in json.loads(r["note"])}


def fit_step(spark: SparkSession, documents: list[str], labels: DataFrame, path: str, run_id: str,
             label_col: str = "toxic") -> int | None:
    """Count what is new: ``documents`` names Parquet files or folders, of which
    the files that no complete step has read are counted. Returns the step's
    number, None if nothing is new. Only names of files reach the driver."""
    frame = spark.read.parquet(*documents)
    new = sorted(set(frame.inputFiles()) - files_read(spark, path, run_id))
    if not new:
        return None
    last = IO.latest_snapshot(spark, path, run_id)
    step = 0 if last is None else last + 1
    rows = cut_lineage(labelled_tokens(spark.read.schema(frame.schema).parquet(*new), labels, label_col), name="labelled")
    counts = rows.select("y", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.sum((F.col("y") == 1).cast("bigint")).alias("a"), F.sum((F.col("y") == 0).cast("bigint")).alias("b"))
    classes = rows.agg(F.coalesce(F.sum("y"), F.lit(0)).cast("bigint").alias("positive"), F.count(F.lit(1)).alias("n"))
    IO.write_snapshot({"counts": counts, "classes": classes}, path, run_id, step)
    IO.commit_snapshot(spark, path, run_id, step, json.dumps(new))
    return step


def resumed_model(spark: SparkSession, path: str, run_id: str, label_col: str = "toxic") -> NBModel:
    """The judge of all complete steps, as ``judges.fit_nb`` over their files."""
    done = [r["epoch"] for r in IO.complete_snapshots(spark, path, run_id).select("epoch").collect()]
    if not done:
        raise ValueError(f"run {run_id} has no complete step in {path}")

    def steps(name):
        return spark.read.parquet(f"{path}/{name}").where((F.col("run_id") == run_id) & F.col("epoch").isin(done))
    counts = cut_lineage(steps("counts").groupBy("token").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")), name="counts")
    tot = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("k")).first()
    cls = steps("classes").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n")).first()
    na, nb, k = float(tot["na"] or 0), float(tot["nb"] or 0), float(tot["k"] or 0)
    weights = counts.select("token", (F.ln((F.col("a") + 1) / F.lit(na + k)) - F.ln((F.col("b") + 1) / F.lit(nb + k))).alias("w"))
    n = cls["n"] or 0
    return NBModel(weights, _prior((cls["positive"] or 0) / n if n else None, n), label_col)
