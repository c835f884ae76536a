"""Vocabulary, encoding, decoding and the length gate.

Token lookups are joins against the vocabulary table. The vocabulary grows
with the corpus, so it carries no broadcast hint: AQE broadcasts it only when
its measured size is under the threshold and otherwise keeps a shuffle join.
Regrouping is always ``array_sort(collect_list(struct(pos, ...)))`` per row
key, bounded by the sentence length gate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.functions.text import (END_ID, FIRST_WORD_ID, MAX_LENGTH, PAD_ID, SPECIAL_IDS, START_ID,
                                    UNK_ID, pad, strip_special)
from parasol.operators.split import global_rank
from parasol.session import cut_lineage

OVERFLOW_MODES = ("reject", "truncate", "error")


EXACT_COUNT_BUCKETS = 1024
LONG_PREFIX_COUNT = 64


def vocab_bucket(n, token):
    """Ordered bucket for the (n desc, token) rank with a bounded number of buckets.

    Counts below ``EXACT_COUNT_BUCKETS`` get one bucket per count and token
    prefix, the longer the rarer the tokens and so the more of them: four
    characters up to ``LONG_PREFIX_COUNT``, one above. Larger counts share one
    bucket per power of two with no prefix (that would break the order across
    counts).
    """
    big = n >= EXACT_COUNT_BUCKETS
    band = F.when(big, F.lit(EXACT_COUNT_BUCKETS) + F.floor(F.log2(n.cast("double")))).otherwise(n).cast("bigint")
    letter = F.when(big, F.lit("")).otherwise(F.when(
        n <= LONG_PREFIX_COUNT, F.substring(token, 1, 4)).otherwise(F.substring(token, 1, 1)))
    return F.struct((-band).alias("k"), letter.alias("p"))


def counted(tokens_df: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(token, n) of token arrays."""
    # not the bare column: Spark would test its size in a filter below, which makes the tokens a second time
    tokens = F.coalesce(F.col(tokens_col), F.array().cast("array<string>"))
    return tokens_df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def build_vocab(tokens_df: DataFrame, tokens_col: str = "tokens", size: int | None = None) -> DataFrame:
    """(token, id, n) by frequency, ties by token; ids start after the specials.

    The rank is distributed over ``vocab_bucket`` buckets, monotone in the
    (n desc, token) order and bounded in number.
    """
    counts = counted(tokens_df, tokens_col)
    # the count table feeds both the bucket sizes and the ranking: write it once
    counts = cut_lineage(counts)
    bucket = vocab_bucket(F.col("n"), F.col("token"))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("token")], bucket, rank_col="_r")
    vocab = ranked.select("token", (F.col("_r") + FIRST_WORD_ID - 1).cast("int").alias("id"), "n")
    if size is not None:
        vocab = vocab.where(F.col("id") < size)
    return vocab


def _side_is(side: str):
    return lambda x: x["side"] == F.lit(side)


def _explode_sides(df: DataFrame, key: str, sides: dict) -> DataFrame:
    parts = []
    for side, col in sides.items():
        parts.append(F.struct(F.lit(side).alias("side"), F.col(col).alias("toks")))
    e = df.select(key, F.explode(F.array(*parts)).alias("s")).select(key, "s.side", "s.toks")
    return e.select(key, "side", F.posexplode_outer("toks").alias("pos", "token"))


def encode(df: DataFrame, vocab: DataFrame, key: str = "pair_id", sides: dict | None = None,
           max_length: int = MAX_LENGTH, overflow: str = "reject") -> tuple[DataFrame, DataFrame]:
    """T3 + T4 + P8: token arrays to padded id arrays.

    ``sides`` maps output column to token-array column, e.g.
    ``{"input_ids": "toxic_tokens", "detoxified_ids": "neutral_tokens"}``.
    The gate runs on the token-array sizes *before* anything is exploded
    (start and end ids take two places), so over-long rows never reach the
    vocabulary join or the regroup. All sides then go through one explode, one
    vocabulary join and one regroup. Returns ``(ok, rejected)``; with
    ``overflow='truncate'`` long rows are cut (end token kept), with
    ``'error'`` the job fails on the first long row.
    """
    if overflow not in OVERFLOW_MODES:
        raise ValueError(f"overflow must be one of {OVERFLOW_MODES}")
    sides = sides or {"input_ids": "tokens"}
    room = max_length - 2
    is_null = None
    too_long = None
    for c in sides.values():
        n = F.col(c).isNull()
        t = F.size(c) > room
        is_null = n if is_null is None else (is_null | n)
        too_long = t if too_long is None else (too_long | t)
    src = df.select(key, *sides.values())
    nulls = src.where(is_null).select(key).withColumn("reason", F.lit("null"))
    live = src.where(~is_null)
    if overflow == "reject":
        rejected = live.where(too_long).select(key).withColumn("reason", F.lit("too_long")).unionByName(nulls)
        live = live.where(~too_long)
    elif overflow == "truncate":
        live = live.select(key, *[F.slice(c, 1, room).alias(c) for c in dict.fromkeys(sides.values())])
        rejected = nulls
    else:
        # in the token column itself, which is used, so that the check can't be pruned
        live = live.select(key, *[F.when(too_long, F.raise_error(F.lit("encoded row longer than max_length")))
                                  .otherwise(F.col(c)).alias(c) for c in dict.fromkeys(sides.values())])
        rejected = nulls
    e = _explode_sides(live, key, sides)
    v = vocab.select("token", "id")
    j = e.join(v, on="token", how="left")
    item = F.when(F.col("pos").isNotNull(),
                  F.struct("side", "pos", F.coalesce(F.col("id"), F.lit(UNK_ID)).alias("id")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    cols = [key]
    for side in sides:
        ids = F.transform(F.filter("_items", _side_is(side)), lambda x: x["id"])
        cols.append(pad(F.concat(F.array(F.lit(START_ID)), ids, F.array(F.lit(END_ID))), max_length, PAD_ID)
                    .alias(side))
    return g.select(*cols), rejected


def stack(df: DataFrame, key: str = "pair_id", cols=("input_ids", "detoxified_ids", "input_mask")) -> DataFrame:
    """One aligned struct per pair, failing on arrays of unequal length."""
    sizes = [F.size(c) for c in cols]
    same = sizes[0] == sizes[1]
    for s in sizes[2:]:
        same = same & (sizes[0] == s)
    row = F.when(same, F.struct(*cols)).otherwise(F.raise_error(F.lit("arrays of unequal length")))
    return df.select(key, row.alias("row"))


def length_gate(df: DataFrame, ids_col: str, max_length: int = MAX_LENGTH,
                overflow: str = "reject") -> tuple[DataFrame, DataFrame]:
    """P8 on already encoded ids: split ok from reject, cut, or fail."""
    long_ = F.size(ids_col) > max_length
    if overflow == "reject":
        return df.where(~long_), df.where(long_)
    if overflow == "truncate":
        return df.withColumn(ids_col, F.when(long_, F.slice(ids_col, 1, max_length)).otherwise(F.col(ids_col))), \
            df.limit(0)
    if overflow == "error":
        checked = F.when(long_, F.raise_error(F.lit("encoded row longer than max_length"))).otherwise(F.col(ids_col))
        return df.withColumn(ids_col, checked), df.limit(0)
    raise ValueError(f"overflow must be one of {OVERFLOW_MODES}")


def decode(df: DataFrame, vocab: DataFrame, key: str, ids_col: str, out_col: str = "text",
           special=SPECIAL_IDS) -> DataFrame:
    """T5: ids back to text, special ids skipped, one join and one ordered regroup."""
    e = df.select(key, F.posexplode_outer(strip_special(ids_col, special)).alias("pos", "id"))
    j = e.join(vocab.select("token", "id"), on="id", how="left")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token", F.lit("<unk>")).alias("token")))
    g = j.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_t"))
    return g.select(key, F.array_join(F.transform("_t", lambda x: x["token"]), " ").alias(out_col))


__all__ = ["build_vocab", "encode", "stack", "length_gate", "decode", "PAD_ID"]
