"""Operator 1, exact dedup: stateful streaming deduplication.

The documents are read as a stream. Keyed state in RocksDB, on disk and
without expiry, holds for each digest of a normalised text the group's size
and its keeper so far: length, stable id and content locator (file and row).
State lives under the checkpoint folder, so a later run over more files goes
on where the last one ended.

A digest with more than one row is a hit. Hits are checked on full bytes: the
texts of all rows of such digests are read again and the least and the
greatest text of each digest must be the same bytes. The rows of a digest with
very many copies are dealt to many tasks, whose least and greatest texts meet
in a second step. A digest that fails (a collision) has its rows grouped by digest
and whole text instead.

Edge cases: a null text counts as empty; empty texts are equal; of rows with
equal length a null id stays last; rows that repeat an id count on their own;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRUNED, Settings, scratch_path, stored

#: the state store; its logs take the disk that they fill, not a fixed size for each partition
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: input that one micro-batch takes in
BATCH_BYTES = 256 << 30
#: shares and salts of digests with very many rows
HOT, SALTS = 4096, 64


def normalised(text: Column) -> Column:
    """The text without blanks and tab to carriage return; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def dedup_state(spark: SparkSession, path: str, checkpoint: str, digest: Callable[[Column], Column] = sha256,
                batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Run the stream over what is in ``path`` and not yet in ``checkpoint``.

    Returns all groups: digest, keep_id, keep_file, keep_row, group_size.
    """
    schema = spark.read.parquet(path).schema
    # a pattern that only this path matches: a stream takes a plain path for a folder, and it may be one file
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = (spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(pattern)
              .select(digest(normalised(F.col("text"))).alias("digest"), F.struct(
                  (-F.char_length(F.coalesce("text", F.lit("")))).alias("order"), F.col("doc_id").isNull().alias("no_id"),
                  F.col("doc_id").alias("keep_id"), F.col("_metadata.file_path").alias("keep_file"),
                  F.col("_metadata.row_index").alias("keep_row")).alias("row")))
    groups = stream.groupBy("digest").agg(F.min("row").alias("keeper"), F.count("*").alias("group_size"))
    changes = f"{checkpoint}/changes"

    def save(batch: DataFrame, number: int) -> None:
        # a replayed batch writes the same folder again
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    with Settings(spark, STATE_CONF):
        query = (groups.writeStream.outputMode("update").foreachBatch(save)
                 .option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start())
        query.awaitTermination()
    if query.lastProgress is None and not _exists(spark, changes):
        rows = spark.createDataFrame([], "batch int, digest string, keeper struct<keep_id:long,keep_file:string,"
                                         "keep_row:long>, group_size long")
    else:
        rows = spark.read.parquet(changes)
    last = rows.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch").alias("state"))
    return last.select("digest", "state.keeper.keep_id", "state.keeper.keep_file", "state.keeper.keep_row",
                       "state.group_size")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def exact_duplicates(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256,
                     checkpoint: str | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of the Parquet table in ``path``: doc_id, keep_id,
    group_size, kept, and the SHA-256 of its normalised text."""
    groups = stored(dedup_state(spark, path, checkpoint or scratch_path(spark, "dedup-state"), digest, batch_bytes),
                    "groups")
    text = normalised(F.col("text"))
    rows = spark.read.parquet(path).select(
        "doc_id", text.alias("_text"), F.char_length(F.coalesce("text", F.lit(""))).alias("_length"),
        digest(text).alias("_digest"))
    # a digest with over 1 / HOT of the rows is dealt to SALTS tasks; there are fewer than HOT of them
    n = groups.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    hot = (F.col("group_size") > 1) & (F.col("group_size") * HOT > n)
    hits = groups.filter("group_size > 1").select("digest", F.explode(
        F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    many = F.broadcast(groups.filter(hot).select(F.col("digest").alias("_hot")))
    salted = rows.join(many, F.col("_digest") == F.col("_hot"), "left").select("_digest", "_text", F.when(
        F.col("_hot").isNotNull(), F.pmod(F.xxhash64("doc_id", "_length"), F.lit(SALTS)).cast("int"))
        .otherwise(F.lit(0)).alias("_salt"))
    with Settings(spark, PRUNED):
        checked = stored(salted.join(hits, (F.col("_digest") == F.col("digest")) & (F.col("_salt") == F.col("salt")))
                         .groupBy("digest", "salt").agg(F.min("_text").alias("least"), F.max("_text").alias("most"))
                         .groupBy("digest").agg((F.min("least") != F.max("most")).alias("collides"))
                         .filter("collides"), "collisions")
    out = ["doc_id", "keep_id", "group_size", sha256(F.col("_text")).alias("text_sha256")]
    good = rows
    bad = None
    if checked.limit(1).count():
        collides = F.col("_digest") == F.col("digest")
        good = rows.join(checked, collides, "left_anti")
        mixed = stored(rows.join(checked, collides, "left_semi"), "collided")
        exact = mixed.groupBy(F.col("_digest").alias("d"), F.col("_text").alias("t")).agg(
            F.min(F.struct(-F.col("_length"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))["id"]
            .alias("keep_id"), F.count("*").alias("group_size"))
        bad = mixed.join(exact, (F.col("_digest") == F.col("d")) & (F.col("_text") == F.col("t"))).select(*out)
    # only ids and digests move here; the text is hashed where it is read
    named = good.select("doc_id", "_digest", sha256(F.col("_text")).alias("text_sha256"))
    found = named.join(groups, F.col("_digest") == F.col("digest")).select("doc_id", "keep_id", "group_size",
                                                                           "text_sha256")
    if bad is not None:
        found = found.unionByName(bad)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def deduplicated(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the table that stay, with all their columns."""
    keep = exact_duplicates(spark, path, **options).filter("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return spark.read.parquet(path).join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")


ORACLE = r"""
WITH rows AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (SELECT doc_id, text_sha256,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM rows)
"""
