"""Bigram next-token model, greedy and sampled decoding, token loss
(R4, R7, R8, M4, A10).

The model is a count table ``(ctx, token, n)``. Nothing ever builds the full
"logits" product of positions times continuations (330M rows for 429K
positions at sf0.1):

* greedy: one best continuation per context (a ``min_by`` aggregate), joined
  to positions on the context;
* sampled: an exact inverse-CDF draw. Each position draws an integer
  ``t = h mod total`` from 60 seeded md5 bits; continuations of a
  context own disjoint integer ranges ``[cum_lo, cum_hi)`` in token order.
  Both sides are cut into ``k`` buckets per context (``k`` = number of
  continuations), so the lookup is an equi-join on ``(ctx, bucket)`` with
  about two candidates per position. Hot contexts spread over their buckets
  instead of landing in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parasol.functions.mathx import NEG_INF, md5_draw, safe_ln
from parasol.operators.encode import vocab_bucket
from parasol.operators.split import DEFAULT_SEED, global_rank, prefix_sums


#: continuations of a context that one task ranks
WINDOW_ROWS = 1_000_000


def bigram_pairs(seqs: DataFrame, key: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    """(key, pos, ctx, token): consecutive token pairs, built row-locally."""
    t = F.col(tokens_col)
    n = F.size(t)
    z = F.when(n >= 2, F.arrays_zip(F.slice(t, 1, n - 1).alias("ctx"), F.slice(t, 2, n - 1).alias("token"))) \
        .otherwise(F.array().cast("array<struct<ctx:string,token:string>>"))
    return seqs.select(key, F.posexplode(z).alias("p", "z")) \
        .select(key, (F.col("p") + 1).alias("pos"), F.col("z.ctx").alias("ctx"), F.col("z.token").alias("token"))


def bigram_counts(seqs: DataFrame, key: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    """R4 fit: (ctx, token, n), one partially aggregated shuffle."""
    return bigram_pairs(seqs, key, tokens_col).groupBy("ctx", "token").agg(F.count(F.lit(1)).alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(ctx, total, k): continuation mass and number of continuations."""
    return counts.groupBy("ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))


def bigram_probs(counts: DataFrame, top_k: int | None = None) -> DataFrame:
    """(ctx, token, n, prob, rank) with prob = n / total of the context;
    rank 1 is the most frequent continuation (ties by token).

    Contexts of up to ``WINDOW_ROWS`` continuations are ranked by one window;
    the ranks of a larger one come from buckets by count and token prefix, so
    that many tasks rank it. With ``top_k`` Spark cuts the window down before
    the shuffle.
    """
    totals = context_totals(counts)
    w = Window.partitionBy("ctx").orderBy(F.col("n").desc(), F.col("token"))
    if top_k is not None:
        p = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).join(totals, "ctx")
    else:
        # the window that ranks a context sums it up too: no aggregate, no join
        whole = Window.partitionBy("ctx")
        hot = [r["ctx"] for r in totals.where(F.col("k") > WINDOW_ROWS).select("ctx").collect()]   # one for each WINDOW_ROWS rows at most
        cold = counts.where(~F.coalesce(F.col("ctx").isin(hot), F.lit(False))) if hot else counts
        p = cold.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("total", F.sum("n").over(whole))
        if hot:
            many = counts.where(F.col("ctx").isin(hot))
            ranked = global_rank(many, [F.col("n").desc(), F.col("token")], vocab_bucket(F.col("n"), F.col("token")), partition_cols=("ctx",))
            p = p.unionByName(ranked.join(totals.select("ctx", "total"), "ctx"))
    return p.withColumn("prob", F.col("n") / F.col("total")).select("ctx", "token", "n", "prob", "rank")


def greedy_table(counts: DataFrame) -> DataFrame:
    """(ctx, best, prob): the argmax continuation per context."""
    return counts.groupBy("ctx").agg(
        F.min_by("token", F.struct((-F.col("n")).alias("m"), F.col("token").alias("t"))).alias("best"),
        (F.max("n") / F.sum("n")).alias("prob"))


def positions(seqs: DataFrame, key: str = "seq_id", tokens_col: str = "tokens") -> DataFrame:
    return seqs.select(key, F.posexplode(tokens_col).alias("pos", "ctx"))


def greedy_decode(seqs: DataFrame, counts: DataFrame, key: str = "seq_id",
                  tokens_col: str = "tokens") -> DataFrame:
    """(key, pos, token, prob) choosing the most likely next token at each
    position; positions whose token has no continuation produce no row."""
    return positions(seqs, key, tokens_col).join(greedy_table(counts), "ctx") \
        .select(key, "pos", F.col("best").alias("token"), "prob")


def sample_table(counts: DataFrame) -> DataFrame:
    """Continuations with integer ranges and their buckets (ctx, bucket, token, n, cum_lo, cum_hi)."""
    c = prefix_sums(counts, "ctx", "token", "n", F.substring("token", 1, 3), "cum_hi").join(context_totals(counts), "ctx") \
        .withColumn("cum_lo", F.col("cum_hi") - F.col("n"))
    b_lo = _bucket(F.col("cum_lo"), F.col("k"), F.col("total"))
    b_hi = _bucket(F.col("cum_hi") - 1, F.col("k"), F.col("total"))
    return c.select("ctx", "token", "n", "cum_lo", "cum_hi", F.explode(F.sequence(b_lo, b_hi)).alias("bucket"))


def _bucket(t, k, total):
    return F.floor(t.cast("double") * k.cast("double") / total.cast("double")).cast("bigint")


def sampled_decode(seqs: DataFrame, counts: DataFrame, key: str = "seq_id", tokens_col: str = "tokens",
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """An independent multinomial draw of the next token at each position.

    Returns (key, pos, token, prob), repeatable for a seed.
    """
    pos = positions(seqs, key, tokens_col)
    tot = context_totals(counts)
    h = md5_draw(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), F.col("pos").cast("string")))
    p = pos.join(tot, "ctx").withColumn("t", F.pmod(h, F.col("total")))
    p = p.withColumn("bucket", _bucket(F.col("t"), F.col("k"), F.col("total")))
    st = sample_table(counts)
    j = p.join(st, ["ctx", "bucket"]).where((F.col("t") >= F.col("cum_lo")) & (F.col("t") < F.col("cum_hi")))
    return j.select(key, "pos", "token", (F.col("n") / F.col("total")).alias("prob"))


def decoded_candidates(seqs: DataFrame, counts: DataFrame, key: str = "seq_id", tokens_col: str = "tokens",
                       seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """R7 and R8 as texts: (key, kind, text) with the greedy and the sampled
    choice at every position of a sequence, and the sampled draws.

    Positions whose token has no continuation give no word; a sequence without
    any gives an empty text.
    """
    sampled = sampled_decode(seqs, counts, key, tokens_col, seed)
    both = greedy_decode(seqs, counts, key, tokens_col).select(key, F.lit("greedy").alias("kind"), "pos", "token") \
        .unionByName(sampled.select(key, F.lit("sampled").alias("kind"), "pos", "token"))
    texts = both.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("w")) \
        .select(key, "kind", F.array_join("w.token", " ").alias("text"))
    every = seqs.select(key, F.explode(F.array(F.lit("greedy"), F.lit("sampled"))).alias("kind"))
    return every.join(texts, [key, "kind"], "left").fillna({"text": ""}), sampled


def sequence_logprob(draws: DataFrame, key: str = "seq_id") -> DataFrame:
    """M4 per sequence: sum of ln(prob), minus infinity when a prob is 0."""
    return draws.groupBy(key).agg(
        F.when(F.sum(F.when(F.col("prob") == 0, 1).otherwise(0)) > 0, F.lit(NEG_INF))
        .otherwise(F.sum(F.ln("prob"))).alias("sum_log"))


def smoothed_logprob(seqs: DataFrame, counts: DataFrame, vocab_size: int, key: str, tokens_col: str,
                     k: float = 1.0) -> DataFrame:
    """(key, pos, logp) for every position after the first, with add-k
    smoothing: p = (n(ctx, tok) + k) / (total(ctx) + k * V)."""
    bp = bigram_pairs(seqs, key, tokens_col)
    tot = counts.groupBy("ctx").agg(F.sum("n").alias("total"))
    j = bp.join(counts, ["ctx", "token"], "left").join(tot, "ctx", "left")
    p = (F.coalesce(F.col("n"), F.lit(0)) + F.lit(k)) / (F.coalesce(F.col("total"), F.lit(0)) + F.lit(k * vocab_size))
    return j.select(key, "pos", F.ln(p).alias("logp"))


def token_cross_entropy(seqs: DataFrame, counts: DataFrame, vocab_size: int, key: str = "seq_id",
                        tokens_col: str = "tokens", k: float = 1.0, count_pad: bool = False,
                        max_length: int = 38) -> DataFrame:
    """A10: (key, n_pos, ce, ppl) mean -ln p over scored positions.

    With ``count_pad`` the padded tail counts too (targets unmasked): each of
    the ``max_length - 1 - n_pos`` pad positions is an unseen bigram, -ln(1/V).
    """
    lp = smoothed_logprob(seqs, counts, vocab_size, key, tokens_col, k)
    g = lp.groupBy(key).agg(F.count(F.lit(1)).alias("n_pos"), F.sum("logp").alias("s"))
    keys = seqs.select(key)
    g = keys.join(g, key, "left").fillna({"n_pos": 0, "s": 0.0})
    if count_pad:
        pads = F.greatest(F.lit(max_length - 1) - F.col("n_pos"), F.lit(0))
        n = F.col("n_pos") + pads
        s = F.col("s") - pads * F.lit(math.log(vocab_size))
    else:
        n, s = F.col("n_pos"), F.col("s")
    ce = F.when(n > 0, -s / n)
    return g.select(key, n.cast("bigint").alias("n_pos"), ce.alias("ce"), F.exp(ce).alias("ppl"))


def vocab_size(seqs: DataFrame, tokens_col: str = "tokens") -> int:
    """Distinct tokens of a corpus (a scalar)."""
    return seqs.select(F.explode(tokens_col).alias("t")).agg(F.countDistinct("t").alias("v")).first()["v"]


__all__ = ["bigram_counts", "bigram_probs", "greedy_decode", "sampled_decode", "sequence_logprob",
           "token_cross_entropy", "smoothed_logprob", "vocab_size", "safe_ln"]
