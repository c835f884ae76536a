"""Split, shuffle and batching.

Every ordering is a distributed rank (``global_rank``): rows are cut into
buckets that are monotone in the sort key, bucket sizes are counted (partial
aggregation, a table of at most ``buckets`` rows per partition value), their
running sums are joined back as offsets (broadcast when the table is bounded
by the bucket count), and ``row_number`` runs inside each bucket only. No single-partition sort of the data ever happens.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
HASH_BUCKET_HEX = 3            # 16^3 = 4096 ordered buckets at least
ROWS_PER_BUCKET = 1 << 16      # more hex digits keep a bucket's rows below about this
BROADCAST_BUCKETS = 1 << 16
TASK_ROWS = 1 << 16            # rows that a task ranks, unless one bucket has more
SPLIT_NAMES = ("train", "val", "test")


def hash_key(seed, *parts) -> Column:
    """md5 of ``seed:part:...`` as the shuffle order; hex order = numeric order."""
    items = [F.lit(str(seed))]
    for p in parts:
        items.append(F.lit(":"))
        items.append(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"))
    return F.md5(F.concat(*items))


def hash_bucket(h: Column, hex_digits: int = HASH_BUCKET_HEX) -> Column:
    """Ordered bucket from the leading hex digits of an md5 string."""
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("int")


def hex_digits(n: int) -> int:
    """Leading hex digits that deal ``n`` rows into buckets of a bounded size."""
    digits = HASH_BUCKET_HEX
    while n > ROWS_PER_BUCKET * 16 ** digits:
        digits += 1
    return digits


def prefix_sums(df: DataFrame, group: str, order: str, value: str, bucket: Column, out: str) -> DataFrame:
    """Running sums of ``value`` up to and with each row, in ``order`` within a
    group. ``bucket`` is monotone in the order: sums run inside the buckets and
    over the buckets' totals, so a hot group is not sorted in one task."""
    b = df.withColumn("_b", bucket)
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy(group, "_b").agg(F.sum(value).alias("_s")) \
        .select(group, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return b.join(starts, [group, "_b"]).withColumn(out, F.sum(value).over(inside) + F.col("_start")) \
        .drop("_b", "_start")


def global_rank(df: DataFrame, order_cols: list, bucket: Column, rank_col: str = "rank",
                partition_cols: tuple = (), n_buckets: int | None = None, tasks: int | None = None) -> DataFrame:
    """B2: 1-based rank by ``order_cols`` (within ``partition_cols``).

    ``bucket`` must be monotone in the order: every row of a smaller bucket
    sorts before every row of a larger one. The offsets table holds one row
    per (partition value, bucket); it is broadcast only when there are no
    partition columns and ``n_buckets`` bounds it, otherwise AQE chooses. With
    ``tasks`` the rows are dealt to so many tasks by bucket before their order
    is computed, so that it isn't shuffled; other columns go along once.
    """
    pc = list(partition_cols)
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(*pc, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*pc).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*pc, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    small = not pc and n_buckets is not None and n_buckets <= BROADCAST_BUCKETS
    b = b.repartition(tasks, *pc, "_bucket") if tasks else b
    ranked = b.join(F.broadcast(offsets) if small else offsets, on=[*pc, "_bucket"], how="inner")
    wr = Window.partitionBy(*pc, "_bucket").orderBy(*order_cols)
    return ranked.withColumn(rank_col, (F.row_number().over(wr) + F.col("_off")).cast("bigint")) \
        .drop("_bucket", "_off")


def ranking_tasks(df: DataFrame, n: int, rows: int = TASK_ROWS) -> int:
    """Tasks that rank ``n`` rows, about ``rows`` in each."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / rows))


def split_lengths(n: int, ratios) -> list[int]:
    """Exact part sizes: floor(n * r) each, the remainder dealt one by one from the first part."""
    lengths = [math.floor(n * r) for r in ratios]
    rem = n - sum(lengths)
    for i in range(rem):
        lengths[i % len(lengths)] += 1
    return lengths


def random_split(df: DataFrame, id_col: str = "pair_id", ratios=(0.8, 0.1, 0.1), seed: int = DEFAULT_SEED,
                 names=SPLIT_NAMES) -> DataFrame:
    """B1: disjoint parts of exact sizes, repeatable for a seed.

    Adds ``split`` and ``split_rank`` (1-based order inside the part, the
    permutation order an unshuffled loader walks).
    """
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"ratios {ratios} must sum to 1")
    n = df.count()
    lengths = split_lengths(n, ratios)
    h = hash_key(seed, id_col)
    digits = hex_digits(n)
    ranked = global_rank(df, [h, F.col(id_col)], hash_bucket(h, digits), rank_col="_grank", n_buckets=16 ** digits,
                         tasks=ranking_tasks(df, n))
    bounds, acc = [], 0
    for name, ln in zip(names, lengths):
        bounds.append((name, acc, acc + ln))
        acc += ln
    split = None
    off = None
    for name, lo, hi in bounds:
        cond = F.col("_grank") <= hi
        split = F.when(cond, F.lit(name)) if split is None else split.when(cond, F.lit(name))
        off = F.when(cond, F.lit(lo)) if off is None else off.when(cond, F.lit(lo))
    return ranked.withColumn("split", split).withColumn("split_rank", (F.col("_grank") - off).cast("bigint")) \
        .drop("_grank")


def epoch_shuffle(df: DataFrame, epochs, id_col: str = "pair_id", seed: int = DEFAULT_SEED,
                  partition_cols: tuple = ()) -> DataFrame:
    """A fresh order of the rows for each epoch; adds ``epoch`` and ``epoch_rank``."""
    digits = hex_digits(df.count())
    e = df.withColumn("epoch", F.explode(F.array(*[F.lit(int(x)) for x in epochs])))
    e = e.withColumn("_h", hash_key(seed, F.col("epoch"), id_col))
    return global_rank(e, [F.col("_h"), F.col(id_col)], hash_bucket(F.col("_h"), digits), rank_col="epoch_rank",
                       partition_cols=("epoch", *partition_cols)).drop("_h")


def batch_of(rank_col: str, batch_size: int = 16) -> Column:
    """Zero-based batch of a 1-based rank; the last batch may be short."""
    return F.floor((F.col(rank_col) - 1) / batch_size).cast("bigint")


def batch_rows(batch_id: str, n: int, batch_size: int = 16) -> Column:
    """Rows of a batch, when ``n`` rows are batched; the last batch may be short."""
    return F.least(F.lit(batch_size), F.lit(n) - F.col(batch_id) * batch_size).cast("bigint")


def batch_assign(df: DataFrame, epochs=(0,), batch_size: int = 16, id_col: str = "pair_id",
                 seed: int = DEFAULT_SEED, ratios=(0.8, 0.1, 0.1)) -> DataFrame:
    """B1 + B3 + B4: split, then batches. Training rows are reshuffled per epoch,
    validation and test rows keep the split's permutation order in every epoch.
    ``step`` is the batch's position in its epoch, from 1 (B6)."""
    s = random_split(df, id_col, ratios, seed)
    train = epoch_shuffle(s.where(F.col("split") == "train"), epochs, id_col, seed) \
        .withColumn("batch_id", batch_of("epoch_rank", batch_size)).drop("epoch_rank")
    rest = s.where(F.col("split") != "train") \
        .withColumn("epoch", F.explode(F.array(*[F.lit(int(x)) for x in epochs]))) \
        .withColumn("batch_id", batch_of("split_rank", batch_size))
    return train.unionByName(rest).drop("split_rank").withColumn("step", F.col("batch_id") + 1)


def split_batches(df: DataFrame, split: str = "val", batch_size: int = 16, id_col: str = "pair_id",
                  seed: int = DEFAULT_SEED, ratios=(0.8, 0.1, 0.1)) -> DataFrame:
    """Batches of one split in its permutation order, unshuffled: id and
    ``batch_id`` (what an evaluation pass walks)."""
    return random_split(df, id_col, ratios, seed).where(F.col("split") == split) \
        .withColumn("batch_id", batch_of("split_rank", batch_size)).drop("split", "split_rank")


def split_sizes(split_df: DataFrame) -> DataFrame:
    """Rows per split."""
    return split_df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def batch_counts(split_df: DataFrame, batch_size: int = 16) -> DataFrame:
    """Number of batches per split, ``ceil(n / batch_size)``."""
    return split_sizes(split_df).withColumn("n_batches", F.ceil(F.col("n") / batch_size).cast("bigint"))


def eval_batches(df: DataFrame, batch_size: int = 16, id_col: str = "pair_id", seed: int = DEFAULT_SEED,
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """Batches over all rows in seeded permutation order (an unshuffled loader
    over a whole table); adds ``batch_id``. A task has about ``task_rows`` rows,
    and all rows of a batch but for those that straddle two buckets."""
    n = df.count()
    h, digits = hash_key(seed, id_col), hex_digits(n)
    r = global_rank(df, [h, F.col(id_col)], hash_bucket(h, digits), rank_col="_r", n_buckets=16 ** digits,
                    tasks=ranking_tasks(df, n, task_rows))
    return r.withColumn("batch_id", batch_of("_r", batch_size)).drop("_r")
