"""Session construction and the shared scratch location.

Scratch data (round trips, stream sources and sinks, cut lineage) always goes
under ``spark.checkpoint.dir``, the shared folder a cluster names. Only when
the session has none (local tests) do we create one and set it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app: str = "parasol", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; set one only if unset, and only
    where driver and executors are one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="parasol-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root; Spark's writers
    make the folder."""
    return f"{checkpoint_root(spark)}/parasol-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df, spark: SparkSession | None = None, name: str = "table"):
    """Cut lineage by writing a parquet table in the shared checkpoint folder
    and reading it back (never a local checkpoint).

    One pass over the input (``checkpoint(eager=True)`` would compute it twice:
    once for the eager count, once more for the reliable write), and later
    reads get column pruning and filter pushdown.
    """
    spark = spark or df.sparkSession
    path = scratch_dir(spark, f"cut-{name}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
