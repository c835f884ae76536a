"""Sources and sinks.

All paths are caller-supplied; defaults live under the session's shared
checkpoint folder (``parasol.session.scratch_dir``), never a machine-local
temporary folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.operators.runs import log_line, log_line_matches, parse_log_line
from parasol.operators.split import global_rank, hash_bucket, hex_digits

# Fixed value: the run-stamp format of output folders.
RUN_STAMP = "yyyy-MM-dd,HH-mm-ss"

_TSV = dict(sep="\t", header=True, quote='"', escape='"')


def write_pairs(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """TSV with a header; quotes, tabs and newlines inside cells are quoted."""
    df.write.mode(mode).options(**_TSV).csv(path)


def read_pairs(spark: SparkSession, path: str, source: str = "toxic", target: str = "neutral1",
               key: str = "pair_id", multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Tab-separated pairs with a header; columns are taken by name, others ignored.

    A file without a ``key`` column gets one: the rank of the row by a hash of
    its texts, the same for the same rows in any order and any files. Cells may
    hold line breaks, as ``write_pairs`` writes them; where none does,
    ``multi_line=False`` lets large files be split among tasks. Returns ``(pairs, rejected)``: rows with a null or empty
    source or target are rejected. The strings ``NA`` and ``null`` stay text.
    """
    df = spark.read.options(**_TSV, multiLine=multi_line).csv(path)
    missing = [c for c in (source, target) if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    if key in df.columns:
        df = df.select(F.col(key).cast("bigint").alias(key), source, target)
    else:
        h = F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit("\t"), F.coalesce(target, F.lit(""))))
        digits = hex_digits(df.count())
        df = global_rank(df.select(source, target, h.alias("_h")), [F.col("_h"), F.col(source), F.col(target)],
                         hash_bucket(F.col("_h"), digits), key, n_buckets=16 ** digits).select(key, source, target)
    bad = F.col(source).isNull() | F.col(target).isNull() | (F.col(source) == "") | (F.col(target) == "")
    return df.where(~bad), df.where(bad)


def run_stamp(ts) -> F.Column:
    """Run id from a given timestamp (never "now")."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(c, RUN_STAMP)


def write_metrics_log(ev: DataFrame, path: str, run: str = "run_id", epoch: str = "epoch") -> None:
    """Append the log lines of evaluated epochs, in their order, one text folder per run."""
    ev.select(run, epoch, log_line().alias("value")).repartition(run).sortWithinPartitions(run, epoch).drop(epoch) \
        .write.mode("append").partitionBy(run).text(path)


def _log_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("_path"))
    folder = F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)
    # a path is escaped once as a URI, a partition's folder name once more as such
    name = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    part = F.regexp_extract(name, r"^run_id=(.*)$", 1)
    return raw.select("value", F.when(part != "", F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))))
                      .otherwise(name).alias("run_id"))


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """S3: typed rows from log lines, in folders ``run_id=<run>`` or ``<run>``;
    lines of another form are left out (see ``rejected_log_lines``)."""
    return _log_rows(spark, path).where(log_line_matches("value")).select("run_id", *parse_log_line("value"))


def rejected_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """S3: run and text of the lines that are not of the log's form, blank ones too."""
    return _log_rows(spark, path).where(~log_line_matches("value")).select("run_id", "value")


def write_predictions(df: DataFrame, path: str, run: str = "run_id") -> None:
    """Rewritten sentences, one folder per run; writing a run again replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def write_snapshot(tables: dict, path: str, run_id: str, epoch: int, every: int = 1) -> bool:
    """S6 write: model tables under ``name/run_id=../epoch=..`` when ``epoch % every == 0``;
    writing a snapshot again replaces it."""
    if epoch % every != 0:
        return False
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).withColumn("epoch", F.lit(int(epoch)).cast("bigint")) \
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("run_id", "epoch").parquet(f"{path}/{name}")
    return True


def _marks(path: str) -> str:
    return f"{path}/_complete"


def commit_snapshot(spark: SparkSession, path: str, run_id: str, epoch: int, note: str = "") -> None:
    """Mark a snapshot as complete, once all its tables are written. Readers
    of ``latest_snapshot`` never see one that was cut off in the middle."""
    row = spark.createDataFrame([(run_id, int(epoch), note)], "run_id string, epoch bigint, note string")
    row.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "epoch").parquet(_marks(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def complete_snapshots(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """(epoch, note) of a run's complete snapshots."""
    schema = "note string, run_id string, epoch bigint"
    if not path_exists(spark, _marks(path)):
        return spark.createDataFrame([], schema).select("epoch", "note")
    return spark.read.schema(schema).parquet(_marks(path)).where(F.col("run_id") == run_id).select("epoch", "note")


def latest_snapshot(spark: SparkSession, path: str, run_id: str) -> int | None:
    """Epoch of a run's last complete snapshot, None if it has none."""
    return complete_snapshots(spark, path, run_id).agg(F.max("epoch")).first()[0]


def read_snapshot(spark: SparkSession, path: str, name: str, run_id: str, epoch: int) -> DataFrame:
    """S6 restore: partition-pruned read of one table of one snapshot."""
    df = spark.read.parquet(f"{path}/{name}")
    return df.where((F.col("run_id") == run_id) & (F.col("epoch") == int(epoch))).drop("run_id", "epoch")
