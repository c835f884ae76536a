"""Structured Streaming jobs.

W1 applies the row-local rewrite expression to a file stream: no state, no
shuffle, a checkpointed parquet sink. W2 keeps a running mean loss per
(run, epoch) in streaming aggregation state and writes each micro-batch's
updated keys with ``foreachBatch`` (one overwritten folder per batch id, so
replays are idempotent).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions import spans as SP
from parasol.functions.text import tokenize
from parasol.operators.judges import FLUENT_LABEL
from parasol.operators.metrics import DEFAULT_THRESHOLD
from parasol.operators.rewrite import (INLINE_MAX, delete_words, delete_words_udf, replace_words, replace_words_udf,
                                       rewrite_piece_column, rewrite_pieces_udf, rewrite_text)
from parasol.sources import io as IO

SENTENCE_SCHEMA = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("text", T.StringType())])
LOSS_SCHEMA = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("epoch", T.LongType()),
                            T.StructField("batch_id", T.LongType()), T.StructField("loss", T.DoubleType())])


AVAILABLE = {"availableNow": True}
# groups in which the full batches of a micro-batch are finished
FULL_GROUPS = 64


def _finished(query, trigger: dict | None):
    """Wait for a query that ends by itself; leave an unbounded one running."""
    if trigger is None or trigger.get("availableNow") or trigger.get("once"):
        query.awaitTermination()
    return query


def rewrite_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, words=None, mapping=None,
                   max_files_per_trigger: int = 1, schema: T.StructType = SENTENCE_SCHEMA,
                   trigger: dict | None = None):
    """Rewrite a stream of sentences; empty rows are dropped, not an end marker.

    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``. Without
    one, all files present are processed in micro-batches of
    ``max_files_per_trigger`` files and the finished query is returned; with
    another one (such as ``{"processingTime": "10 seconds"}``) the query is
    returned running and goes on until it is stopped.
    """
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    s = s.where(F.col("text").isNotNull() & (F.trim("text") != ""))
    toks = tokenize("text")
    if mapping:
        toks = replace_words(toks, mapping) if len(mapping) <= INLINE_MAX else replace_words_udf(mapping)(toks)
    if words:
        words = list(words)
        toks = delete_words(toks, words) if len(words) <= INLINE_MAX else delete_words_udf(words)(toks)
    out = s.select("pair_id", F.array_join(toks, " ").alias("rewritten"))
    q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(**(trigger or AVAILABLE)).start()
    return _finished(q, trigger)


def rewrite_text_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, words=None, mapping=None,
                        key: str = "doc_id", text_col: str = "text", max_files_per_trigger: int = 1,
                        trigger: dict | None = None):
    """W1 on whole texts: ``key`` and ``rewritten``, where all code points but
    those of the listed words are the text's (see ``rewrite.rewrite_text``).
    Null texts stay null, empty ones empty. ``words`` are deleted or ``mapping``
    replaces words; ``trigger`` as in ``rewrite_stream``."""
    if words and mapping:
        raise ValueError("give words to delete or a mapping, not both")
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text_col, T.StringType())])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    parts, lexicon = SP.pieces(text_col), mapping or list(words or ())
    made = rewrite_piece_column(parts, words, mapping) if len(lexicon) <= INLINE_MAX else rewrite_pieces_udf(words, mapping)(parts)
    q = s.select(key, made.alias("rewritten")).writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or AVAILABLE)).start()
    return _finished(q, trigger)


def newest_lexicon_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, snapshots: str, run_id: str,
                          table: str = "lexicon", mode: str = "delete", word_col: str = "token", target_col: str = "tgt",
                          key: str = "doc_id", text_col: str = "text", max_files_per_trigger: int = 1,
                          trigger: dict | None = None):
    """W1 with S6: every micro-batch is rewritten by the newest lexicon whose
    snapshot is complete when the batch begins; ``epoch`` tells which.

    The choice is written down before the rewrite, so that a batch that is
    played again after a crash is rewritten by the same lexicon, and its folder
    overwritten: each row is in the sink once. Without a complete snapshot the
    texts stay as they are and ``epoch`` is null.
    """
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField(text_col, T.StringType())])
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)

    def chosen_epoch(spark: SparkSession, batch_id: int) -> int | None:
        choice = f"{checkpoint}/lexicons/batch={batch_id}"
        if not IO.path_exists(spark, f"{choice}/_SUCCESS"):
            spark.createDataFrame([(IO.latest_snapshot(spark, snapshots, run_id),)], "epoch bigint").coalesce(1) \
                .write.mode("overwrite").parquet(choice)
        return spark.read.schema("epoch bigint").parquet(choice).first()["epoch"]

    def write(batch: DataFrame, batch_id: int) -> None:
        epoch = chosen_epoch(batch.sparkSession, batch_id)
        if epoch is None:
            out = batch.withColumn("rewritten", F.col(text_col))
        else:
            lexicon = IO.read_snapshot(batch.sparkSession, snapshots, table, run_id, epoch)
            out = rewrite_text(batch, key, text_col, lexicon, mode, "rewritten", word_col, target_col)
        out.select(key, F.lit(epoch).cast("bigint").alias("epoch"), "rewritten").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = s.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or AVAILABLE)).start()
    return _finished(q, trigger)


def _vector_sums(column: pa.Array, codes: np.ndarray, groups: int) -> tuple[list, np.ndarray]:
    """Sum of each group's vectors, empty if it has none, and their number."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    counts = np.bincount(codes[there], minlength=groups)
    if not there.any():
        return [[]] * groups, counts
    vectors = np.asarray(column.drop_null().flatten().to_numpy(zero_copy_only=False), dtype="float64").reshape(int(there.sum()), -1)
    order = np.argsort(codes[there], kind="stable")
    some = np.flatnonzero(counts)
    sums = np.add.reduceat(vectors[order], (np.cumsum(counts) - counts)[some], axis=0)
    out = [[]] * groups
    for i, v in zip(some, sums):
        out[i] = v
    return out, counts


def _batch_sums(group: list[str], size_col: str, threshold: float):
    """Numbers and sums of the rows of each batch in an Arrow batch."""
    def add(rows: pa.RecordBatch) -> pa.RecordBatch:
        keys = rows.select(group).to_pandas(integer_object_nulls=True)
        codes = keys.groupby(group, dropna=False, sort=False).ngroup().to_numpy()
        groups = int(codes.max()) + 1
        first = np.unique(codes, return_index=True)[1]
        sums, counts = [], []
        p, label = (rows.column(c) for c in ("p_toxic", "fl_label"))
        for v in (rows.column("bleu"), pc.less(p, threshold), pc.equal(label, FLUENT_LABEL)):
            there = v.is_valid().to_numpy(zero_copy_only=False)
            values = v.cast(pa.float64()).fill_null(0.0).to_numpy()
            sums.append(np.bincount(codes, weights=values, minlength=groups))
            counts.append(np.bincount(codes[there], minlength=groups))
        sides = []
        for name in ("x_emb", "y_emb"):
            total, number = _vector_sums(rows.column(name), codes, groups)
            sides.append(total)
            counts.append(number)
        of = rows.take(pa.array(first))
        doubles, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[of.column(g) for g in group], of.column(size_col).cast(pa.int64()), pa.array(np.bincount(codes, minlength=groups)),
             pa.array(list(np.array(sums).T), type=doubles), pa.array(list(np.array(counts).T), type=longs),
             *[pa.array(x, type=doubles) for x in sides]], names=[*group, size_col, "n", "sums", "counts", "x", "y"])

    def partial(batches):
        for rows in batches:
            if rows.num_rows:
                yield add(rows)
    return partial


def batch_metrics_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, group=("batch_id",),
                         size_col: str = "n_rows", threshold: float = DEFAULT_THRESHOLD, max_files_per_trigger: int = 1,
                         schema: T.StructType | None = None, trigger: dict | None = None):
    """A6 on a stream (W2): the metrics of every batch, once its last row is in.

    The source holds scored rows (``metrics.row_scores`` with embeddings, its
    ``group`` columns and in ``size_col`` how many rows the batch has), in any
    order and any files. A task first adds up its rows of each batch, a whole
    Arrow batch of rows at once. A batch that this finds full needs no state;
    such batches are finished many at a time. Keyed state holds the other open batches: number and sums of
    the rows seen, of a fixed size whatever the batch's. When a batch is full its metrics go to the sink and its
    state is dropped. A row with a null embedding counts for all but the
    similarity; null scores are left out of their means. State and files read
    advance together in the checkpoint, and each micro-batch overwrites its own
    folder, so that a restart neither loses nor repeats a batch.
    """
    group = list(group)
    schema = schema or spark.read.parquet(source).schema
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    sums_schema = "n long, sums array<double>, counts array<long>, x array<double>, y array<double>"
    out_schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], "n_rows long, bleu double, sta double, sim double, fl double, j double"])

    def metrics(key, n, sums, counts, x, y):
        means = [v / c if c else None for v, c in zip(sums, counts)]
        sim = None
        if len(x) and len(y):
            a, b = x / counts[3], y / counts[4]
            sim = float(a @ b / (max(np.sqrt(a @ a), 1e-8) * max(np.sqrt(b @ b), 1e-8)))
        j = None if None in (means[1], means[2], sim) else means[1] * sim * means[2]
        return (*key, int(n), means[0], means[1], sim, means[2], j)

    def update(key, frames, state):
        if key[0] >= 0:     # full batches, a row each
            for f in frames:
                rows = zip(zip(*[f[g] for g in group]), f["n"], f["sums"], f["counts"], f["x"], f["y"])
                yield pd.DataFrame([metrics(*r) for r in rows], columns=[*group, "n_rows", "bleu", "sta", "sim", "fl", "j"])
            return
        n, sums, counts, x, y = state.get if state.exists else (0, [0.0] * 3, [0] * 5, [], [])
        sums, counts, sides, size, of = np.array(sums), np.array(counts), [np.array(x), np.array(y)], None, None
        for f in frames:
            n, size, of = n + int(f["n"].sum()), int(f[size_col].iloc[0]), [f[g].iloc[0] for g in group]
            sums, counts = sums + np.sum(f["sums"].tolist(), axis=0), counts + np.sum(f["counts"].tolist(), axis=0)
            for i, name in enumerate(("x", "y")):
                for v in f[name]:
                    if len(v):
                        sides[i] = sides[i] + v if len(sides[i]) else np.array(v)
        if n < size:
            state.update((int(n), sums.tolist(), counts.tolist(), sides[0].tolist(), sides[1].tolist()))
            return
        if state.exists:
            state.remove()
        yield pd.DataFrame([metrics(of, n, sums, counts, *sides)], columns=[*group, "n_rows", "bleu", "sta", "sim", "fl", "j"])

    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    part_schema = ", ".join([*[f"{g} {kinds[g]}" for g in group], f"{size_col} long", sums_schema])
    part = s.mapInArrow(_batch_sums(group, size_col, threshold), part_schema)
    route = F.when(F.col("n") == F.col(size_col), F.pmod(F.xxhash64(*group), F.lit(FULL_GROUPS))).otherwise(-1)
    part = part.withColumn("_route", route.cast("long")).withColumns(
        {f"_k{i}": F.when(F.col("_route") < 0, F.col(g)) for i, g in enumerate(group)})
    made = part.groupBy("_route", *[f"_k{i}" for i in range(len(group))]).applyInPandasWithState(
        update, out_schema, sums_schema, "append", "NoTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/part={batch_id}")

    q = made.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write) \
        .trigger(**(trigger or AVAILABLE)).start()
    return _finished(q, trigger)


def running_loss_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                        max_files_per_trigger: int = 1, schema: T.StructType = LOSS_SCHEMA,
                        output_mode: str = "update", trigger: dict | None = None):
    """Running mean loss per (run_id, epoch) over incoming batches.

    No event time exists, so there is no watermark; the state holds one row
    per (run_id, epoch). In ``update`` mode (default) each micro-batch writes
    only the keys it changed, to its own ``batch=<id>`` folder with overwrite,
    so a replayed batch rewrites the same folder; ``read_running_state`` takes
    the latest row per key. ``complete`` mode rewrites the whole state each
    micro-batch (small states only).
    """
    if output_mode not in ("update", "complete"):
        raise ValueError("output_mode must be 'update' or 'complete'")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    agg = s.groupBy("run_id", "epoch").agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))

    def write_updates(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    def write_state(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    q = agg.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint) \
        .foreachBatch(write_updates if output_mode == "update" else write_state) \
        .trigger(**(trigger or AVAILABLE)).start()
    return _finished(q, trigger)


def read_running_state(spark: SparkSession, sink: str) -> DataFrame:
    """Final state of an update-mode W2 sink: the latest row of each key."""
    u = spark.read.parquet(sink)
    latest = u.groupBy("run_id", "epoch").agg(
        F.max_by(F.struct("mean_loss", "n_batches"), "batch").alias("s"))
    return latest.select("run_id", "epoch", "s.mean_loss", "s.n_batches")
