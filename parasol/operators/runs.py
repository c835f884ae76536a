"""Runs as tables (A16, B7, P6) and the metric log line (S2 text, T8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parasol.operators.metrics import METRICS

# Fixed value: the metric log line format.
LOG_FORMAT = "Epoch %d: Loss %.4f, BLEU %.4f, STA %.4f, SIM %.4f, FL %.4f, J %.4f"
_VALUE = r"([-+]?(?:\d+(?:\.\d+)?|NaN|nan|Infinity|inf))"
LOG_PATTERN = (r"^Epoch (\d+): " + ", ".join(f"{x} {_VALUE}" for x in ("Loss", "BLEU", "STA", "SIM", "FL", "J"))
               + r"\s*$")
SERIES = ("loss", *METRICS)


def log_line(epoch="epoch", loss="loss", bleu="bleu", sta="sta", sim="sim", fl="fl", j="j") -> F.Column:
    """One line per evaluated epoch; the line shows ``epoch + 1``."""
    return F.format_string(LOG_FORMAT, (F.col(epoch) + 1).cast("int"), F.col(loss), F.col(bleu), F.col(sta),
                           F.col(sim), F.col(fl), F.col(j))


def log_line_matches(line="value") -> F.Column:
    return F.coalesce(F.col(line).rlike(LOG_PATTERN), F.lit(False))


def parse_log_line(line="value") -> list:
    """S3: typed columns from a log line (epoch as written, i.e. 1-based)."""
    c = F.col(line)
    cols = [F.regexp_extract(c, LOG_PATTERN, 1).try_cast("bigint").alias("epoch")]
    for i, name in enumerate(SERIES, start=2):
        cols.append(F.regexp_extract(c, LOG_PATTERN, i).try_cast("double").alias(name))
    return cols


def periodic(df: DataFrame, k: int, epoch: str = "epoch") -> DataFrame:
    """Keep epochs with ``epoch % k == 0``."""
    return df.where(F.pmod(F.col(epoch), F.lit(k)) == 0)


def epoch_axis(df: DataFrame, k: int, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """The plotted axis 1, 1+k, 1+2k, ... of a run's saved points."""
    w = Window.partitionBy(run).orderBy(epoch)
    return df.withColumn("axis", (1 + (F.row_number().over(w) - 1) * k).cast("bigint"))


def metrics_long(ev: DataFrame, ids=("run_id", "epoch")) -> DataFrame:
    """One row per (run, epoch, metric)."""
    vals = [c for c in SERIES if c in ev.columns]
    return ev.select(*ids, *[F.col(c).cast("double") for c in vals]) \
        .unpivot(list(ids), vals, "metric", "value")


def run_summary(ev: DataFrame, run: str = "run_id", epoch: str = "epoch") -> DataFrame:
    """Per run: epochs, best J and its epoch, lowest loss and its epoch (the first
    of those that are equal to nine digits), last values."""
    aggs = [F.count(F.lit(1)).alias("n_epochs"), F.max(epoch).alias("last_epoch"),
            F.max_by(epoch, F.struct(F.round("j", 9), (-F.col(epoch)).alias("e"))).alias("best_j_epoch"),
            F.max("j").alias("best_j")]
    if "loss" in ev.columns:
        aggs += [F.min("loss").alias("min_loss"),
                 F.min_by(epoch, F.struct(F.round("loss", 9), F.col(epoch).alias("e"))).alias("min_loss_epoch")]
    aggs += [F.max_by(c, epoch).alias(f"last_{c}") for c in METRICS]
    return ev.groupBy(run).agg(*aggs)
