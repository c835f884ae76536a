"""Operator 7, mixing sources to target weights: a splitting tree of quotas.

Each source's records are dealt into blocks by a keyed hash, so the block
number is already a random order. A source whose target is ``e`` times its
size and a rest takes every block ``e`` times and, in block order, as many
more as the rest holds; inside the one block where the rest ends, records are
taken in hashed order until it is reached. The numbers of block draws per
source are then split among output shards by a binary tree: each node gives
its left half a multivariate hypergeometric share of its quotas and the right
half what remains, so the shards' quotas add up exactly and depend on nothing
but the seed. Each shard draws a range of its own of the source's permuted
blocks and shuffles its records by hash.

Only one row per source reaches the driver. Edge cases: null text has size 0;
null source is a source, the last one; a source of size 0 has target 0 and
takes nothing; an empty table gives an empty result; repeated rows are
records of their own, placed by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sent_if_small, stored, without, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
SHARDS = 8
BLOCK_ROWS = 256
SEED = 20

PLAN = T.StructType([T.StructField("_s", T.IntegerType()), T.StructField("_name", T.StringType()),
                     T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                     T.StructField("_blocks", T.LongType()), T.StructField("_epochs", T.LongType()),
                     T.StructField("_rest", T.LongType())])


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> list[float]:
    """Targets by weight (repeating) of ``share`` of all sizes; a target above
    ``most`` times its source's size stops there and the excess is reshared."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), list(range(len(sizes)))
    while free:
        unit = left / sum(w[i] for i in free)
        full = [i for i in free if unit * w[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * w[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Shares of each quota per shard, ``[shards, sources]``; rows' totals
    differ by at most one and columns add up to the quotas."""
    quotas = np.asarray(quotas, dtype=np.int64)

    def down(q: np.ndarray, n: int, path: tuple[int, ...]) -> list[np.ndarray]:
        if n == 1:
            return [q]
        left = n // 2
        total = int(q.sum())
        goal = total * left // n
        rng = np.random.default_rng([seed, *path])
        mine = np.zeros_like(q)
        rest, need = total, goal
        for i, own in enumerate(q):  # marginals one by one: any sizes
            rest -= int(own)
            mine[i] = need if rest == 0 else _hypergeometric(rng, int(own), rest, need)
            need -= int(mine[i])
        return down(mine, left, (*path, 0)) + down(q - mine, n - left, (*path, 1))

    return np.array(down(quotas, shards, (1,)))


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    p, n = good / (good + bad), draws  # beyond the generator's range: its normal limit, kept in range
    spread = (n * p * (1 - p) * (good + bad - n) / max(1, good + bad - 1)) ** 0.5
    return int(min(max(round(rng.normal(n * p, spread)), n - bad, 0), good, n))


def mix(df: DataFrame, key: str, source: str, size: str, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST, shards: int = SHARDS, seed: int = SEED, whole: bool = False) -> DataFrame:
    """Decide how often each record is taken and into which output shards.

    ``df`` (a stored table: it is read several times) has a key, a source and
    a size in words. Returns key, source, size, ``source_size``, ``target``,
    ``taken`` (words, repeats counted) and ``shards`` (one for each draw).
    The last draw of a source takes just the words that its target still lacks;
    with ``whole`` it takes the record if at least half of it is lacking.
    """
    spark = df.sparkSession
    df = df.select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(size).cast("long").alias("_size"))
    found = df.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    goals = targets([r["size"] for r in found], weights, share, most)
    plan = []
    for i, (r, goal) in enumerate(zip(found, goals, strict=True)):
        whole_words = round(goal)
        epochs = whole_words // r["size"] if r["size"] else 0
        plan.append((i, r["_source"], r["size"], goal, max(1, -(-r["n"] // BLOCK_ROWS)), epochs,
                     whole_words - epochs * r["size"]))
    plan_df = sent_if_small(spark.createDataFrame(plan, PLAN), len(plan))
    dealt = (df.join(plan_df, F.col("_source").eqNullSafe(F.col("_name")))
             .withColumn("_h", F.xxhash64(F.lit(seed), "_key"))
             .withColumn("_block", F.pmod("_h", F.col("_blocks"))))
    before = Window.partitionBy("_s").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(dealt.groupBy("_s", "_block").agg(F.sum("_size").alias("_bsize"), F.first("_rest").alias("_r"),
                                                      F.first("_epochs").alias("_e"))
                    .withColumn("_before", F.coalesce(F.sum("_bsize").over(before), F.lit(0)))
                    .select("_s", "_block", "_e", (F.col("_r") - F.col("_before")).alias("_lack"), "_bsize"), "blocks")
    # draws of a source: its blocks in order, once for each epoch, the last epoch cut off
    extra = (F.col("_lack") > 0).cast("int")
    draws = {r["_s"]: r["n"] for r in
             blocks.groupBy("_s").agg(F.sum(F.col("_e") + extra).alias("n")).collect()}
    shares = split_quotas([draws.get(i, 0) for i in range(len(plan))], shards, seed)
    ends = np.cumsum(shares, axis=0).T.tolist() if len(plan) else []
    ranges = sent_if_small(spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "_s int, _ends array<long>"),
                           len(ends))
    # a block's draws are numbered rank, rank + blocks, rank + 2 blocks, ...
    rank = Window.partitionBy("_s").orderBy("_block")
    per_source = blocks.groupBy("_s").agg(F.count("*").alias("_nb"))
    placed = (blocks.withColumn("_rank", F.row_number().over(rank) - 1).join(per_source, "_s").join(ranges, "_s")
              .withColumn("_draws", F.expr("""transform(filter(sequence(0L, _e), k -> k < _e + if(_lack > 0, 1, 0)),
                                              k -> size(filter(_ends, x -> x <= k * _nb + _rank)))"""))
              .select(F.col("_s").alias("_bs"), F.col("_block").alias("_bb"), "_e", "_lack", "_bsize", "_draws"))
    rows = dealt.drop("_source", "_epochs", "_rest", "_blocks").join(
        placed, (F.col("_s") == F.col("_bs")) & (F.col("_block") == F.col("_bb")))
    edge = (F.col("_lack") > 0) & (F.col("_lack") < F.col("_bsize"))
    plain = rows.filter(~edge).withColumn("_more", F.when(F.col("_lack") > 0, F.col("_size")).otherwise(F.lit(0)))
    inside = (Window.partitionBy("_s", "_block").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "_key", "_size")
              .rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.filter(edge).withColumn("_gap", F.col("_lack") - F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    part = F.least(F.greatest(F.col("_gap"), F.lit(0)), F.col("_size"))
    if whole:
        part = F.when(2 * F.col("_gap") >= F.col("_size"), F.col("_size")).otherwise(F.lit(0))
    cut = cut.withColumn("_more", part).drop("_gap")
    used = F.when((F.col("_more") > 0) | (F.col("_lack") <= 0), F.col("_draws")).otherwise(
        F.slice("_draws", F.lit(1), F.col("_e").cast("int")))
    return plain.unionByName(cut).select(
        F.col("_key").alias(key), F.col("_name").alias(source), F.col("_size").alias(size), "source_size", "target",
        (F.col("_e") * F.col("_size") + F.col("_more")).cast("long").alias("taken"), used.alias("shards"))


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix of all documents by words: one row per document."""
    sized = stored(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return mix(sized, "doc_id", "source", "size", **options)


def mixed_rows(documents: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed records themselves: every whole record as often as it is
    taken, ordered by shard and shuffled within, with the input's columns."""
    names = [c for c in documents.columns if not c.startswith("_mix_")]
    plan = mix_documents(documents, seed=seed, whole=True, **options)
    # repeated keys with the same source are decided alike: one decision each
    plan = plan.groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source")).agg(
        F.first("shards").alias("_mix_shards"))
    joined = without(documents, "_mix_id", "_mix_source", "_mix_shards").join(
        plan, F.col("doc_id").eqNullSafe(F.col("_mix_id")) & F.col("source").eqNullSafe(F.col("_mix_source")))
    drawn = joined.select(*names, F.posexplode("_mix_shards").alias("_mix_copy", "_mix_shard"))
    order = F.xxhash64(F.lit(seed + 2), "doc_id", "_mix_copy")
    # each shard is cut into ranges of its hashed order, so no task holds a whole shard
    return (drawn.withColumn("_mix_order", order).repartitionByRange("_mix_shard", "_mix_order")
            .sortWithinPartitions("_mix_shard", "_mix_order").select(*names))
