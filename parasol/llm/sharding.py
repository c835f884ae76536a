"""Operator 8, sharding: rendezvous hashing of stable record keys.

Each record scores every shard by ``-ln(u) / weight``, where ``u`` in (0, 1)
is a hash of key and shard number, and goes to the shard with the least score.
A new shard therefore only takes records to itself, and a shard gets records
in proportion to its weight. The choice is row-local: no shuffle, no state.

Edge cases: a null key is a key like any other (its records share a shard);
records with the same key share a shard; an empty table gives an empty result;
input columns named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, without

#: records that one numbering group holds on average
GROUP_ROWS = 4096


def shard_of(keys: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of the record with these keys."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")

    def bid(shard: int, weight: float) -> Column:
        # null is told from every value by the flag beside it
        h = F.xxhash64(F.lit(shard), *[x for k in keys for x in (k.isNull(), k)])
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / weight).alias("bid"), F.lit(shard).alias("shard"))

    bids = [bid(i, w) for i, w in enumerate(weights)]
    return (F.least(*bids) if len(bids) > 1 else bids[0])["shard"]


def assign_shards(df: DataFrame, keys: Sequence[str], weights: Sequence[float],
                  grown_weights: Sequence[float] | None = None) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` under ``grown_weights`` if given."""
    cols = [F.col(k) for k in keys]
    out = without(df, *[c for c in ("shard", "grown_shard") if c not in keys])
    out = out.withColumn("shard", shard_of(cols, weights))
    if grown_weights is not None:
        out = out.withColumn("grown_shard", shard_of(cols, grown_weights))
    return out


def number_within(df: DataFrame, group: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in hashed order.

    Rows go to numbering buckets whose count follows the table's size, so that
    neither a large group nor the whole table is sorted in one task; a bucket's
    first number is the sum of the counts of those before it. ``df`` is read
    three times, so it should be a stored table.
    """
    n = df.count()
    buckets = max(1, -(-n // GROUP_ROWS))
    mixed = F.xxhash64(F.lit(977), *[F.col(c) for c in order])
    df = without(df, slot).withColumn("_order", mixed).withColumn("_bucket", F.pmod("_order", F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
              .select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"),
                      F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(group, "_bucket").orderBy("_order", *order)
    return (df.withColumn("_r", F.row_number().over(inside))
            .join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
            .withColumn(slot, (F.col("_start") + F.col("_r") - 1).cast("long"))
            .drop("_order", "_bucket", "_g", "_b", "_start", "_r"))


def shard_records(documents: DataFrame, n_shards: int = 8) -> DataFrame:
    """One row per document: size in bytes plus one, text checksum, shard,
    slot within the shard, and the shard with one more shard. A null text has
    no bytes."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"),
                            F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    rows = stored(assign_shards(rows, ["doc_id"], [1.0] * n_shards, [1.0] * (n_shards + 1)), "shards")
    return (number_within(rows, "shard", ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
