"""Reward terms and losses.

Token matching for BERTScore stays inside each row, as matrix products of a
bounded size in an Arrow-batched ``pandas_udf``, so no token-pair rows are ever
emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions.text import tokenize
from parasol.operators.vectors import TokenVectors, row_numbers

# Weights of the reward terms and the warm-up.
LAMBDA_TOX = 0.2
LAMBDA_BERT = 0.8
ALPHA = 0.5
WARMUP_EPOCHS = 100

# numbers that are gathered or multiplied out at once; rows with more tokens on a side are matched alone
MATCH_PIECE = 1 << 20
LONG_ROW = 256


@F.pandas_udf(T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType())]))
def greedy_match(cands: pd.Series, golds: pd.Series) -> pd.DataFrame:
    """Row-local greedy matching of unit vectors: P from the candidate side,
    R from the gold side, as one small matrix product per row (Arrow batches,
    numpy inside the task; the rows come already grouped by Spark)."""
    ps, rs = [], []
    for cv, gv in zip(cands, golds):
        if cv is None or gv is None or len(cv) == 0 or len(gv) == 0:
            ps.append(0.0)
            rs.append(0.0)
            continue
        sim = np.stack(cv) @ np.stack(gv).T
        ps.append(float(sim.max(axis=1).mean()))
        rs.append(float(sim.max(axis=0).mean()))
    return pd.DataFrame({"p": ps, "r": rs})


def _matched_long(c: np.ndarray, g: np.ndarray, unit: np.ndarray) -> tuple[float, float]:
    """P and R of one row: distinct tokens only, and a bounded piece of the product at a time."""
    (cu, ci), (gu, gi) = (np.unique(x, return_inverse=True) for x in (c, g))
    best_c, best_g = np.full(len(cu), -np.inf), np.full(len(gu), -np.inf)
    for k in range(0, len(cu), 1024):
        for m in range(0, len(gu), 1024):
            sim = unit[cu[k:k + 1024]] @ unit[gu[m:m + 1024]].T
            best_c[k:k + 1024] = np.maximum(best_c[k:k + 1024], sim.max(axis=1))
            best_g[m:m + 1024] = np.maximum(best_g[m:m + 1024], sim.max(axis=0))
    return best_c[ci].mean(), best_g[gi].mean()


def matched(cands: pa.Array, golds: pa.Array, unit: np.ndarray) -> np.ndarray:
    """P and R of every row of token lists, 0 where a side is null or empty.
    Rows with as many tokens on both sides are multiplied together, a bounded
    number of vectors and products at a time."""
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (cands, golds)]
    words = pa.chunked_array([cands.flatten(), golds.flatten()]).combine_chunks().dictionary_encode()
    rows = row_numbers(words.dictionary, len(unit))[words.indices.to_numpy()]
    (nc, ng), n_c = sizes, int(sizes[0].sum())
    c_at, g_at = np.cumsum(nc) - nc, np.cumsum(ng) - ng + n_c
    out = np.zeros((len(nc), 2))
    live = np.flatnonzero((nc > 0) & (ng > 0))
    long = (nc[live] > LONG_ROW) | (ng[live] > LONG_ROW)
    for i in live[long]:
        out[i] = _matched_long(rows[c_at[i]:c_at[i] + nc[i]], rows[g_at[i]:g_at[i] + ng[i]], unit)
    live = live[~long]
    live = live[np.lexsort((ng[live], nc[live]))]
    ends = np.append(np.flatnonzero((np.diff(nc[live]) != 0) | (np.diff(ng[live]) != 0)) + 1, len(live))
    start = 0
    for end in ends[ends > 0]:
        c, g = int(nc[live[start]]), int(ng[live[start]])
        step = max(1, min(MATCH_PIECE // ((c + g) * unit.shape[1]), MATCH_PIECE // (c * g)))
        for k in range(start, end, step):
            some = live[k:min(end, k + step)]
            sim = unit[rows[c_at[some][:, None] + np.arange(c)]] @ unit[rows[g_at[some][:, None] + np.arange(g)]].transpose(0, 2, 1)
            out[some, 0], out[some, 1] = sim.max(axis=2).mean(axis=1), sim.max(axis=1).mean(axis=1)
        start = end
    return out


def _match_tokens(matrix):
    """As ``greedy_match``, for token lists and a matrix of unit vectors."""
    def match(batches):
        for cands, golds in batches:
            out = matched(cands, golds, matrix.value)
            yield pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["p", "r"])
    match.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(match, T.StructType([T.StructField("p", T.DoubleType()), T.StructField("r", T.DoubleType())]))


def bert_score(cands: DataFrame, tv: TokenVectors, key: str = "seq_id", kind: str = "kind",
               text: str = "text", gold: str = "gold") -> DataFrame:
    """A11 via J3: greedy token matching with cosine similarity.

    P = mean over candidate tokens of the best cosine to a gold token, R the
    same from the gold side, F1 = 2PR / (P + R); 0 when a side is empty. With
    an embeddings table that every task has in place, the rows of an Arrow batch turn
    their distinct tokens into row numbers of the table and are matched there,
    all rows of the same sizes at once: nothing is shuffled.
    Otherwise token vectors are attached by a lookup join and regrouped.
    """
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    if tv.in_place and not tv.n:    # no token has a vector
        return cands.select(key, kind, *[F.lit(0.0).alias(c) for c in ("p", "r", "f1")])
    if tv.in_place:
        match = _match_tokens(tv.sent_units())
        return cands.select(key, kind, match(tokenize(text), tokenize(gold)).alias("m")).select(
            key, kind, F.col("m.p").alias("p"), F.col("m.r").alias("r")).withColumn("f1", f1)
    sides = F.array(F.struct(F.lit("c").alias("side"), tokenize(text).alias("toks")),
                    F.struct(F.lit("g").alias("side"), tokenize(gold).alias("toks")))
    e = cands.select(key, kind, F.explode(sides).alias("s")) \
        .select(key, kind, "s.side", F.posexplode("s.toks").alias("pos", "token"))
    v = tv.lookup(e, unit=True)
    g = v.groupBy(key, kind).agg(F.array_sort(F.collect_list(F.struct("side", "pos", "vector"))).alias("_v"))
    has = lambda x: x["vector"].isNotNull()
    cv = F.transform(F.filter("_v", lambda x: (x["side"] == "c") & has(x)), lambda x: x["vector"])
    gv = F.transform(F.filter("_v", lambda x: (x["side"] == "g") & has(x)), lambda x: x["vector"])
    m = g.select(key, kind, greedy_match(cv, gv).alias("m"))
    out = m.select(key, kind, F.col("m.p").alias("p"), F.col("m.r").alias("r"))
    # keys whose both texts are empty never explode; give them zeros
    keys = cands.select(key, kind)
    return keys.join(out.withColumn("f1", f1), [key, kind], "left").fillna({"p": 0.0, "r": 0.0, "f1": 0.0})


def reward_differences(scored: DataFrame, key: str = "seq_id", kind: str = "kind",
                       lambda_tox: float = LAMBDA_TOX, lambda_bert: float = LAMBDA_BERT) -> DataFrame:
    """A12 + A13 via J2: sampled minus greedy, per sequence, and the total.

    The two candidate frames are aligned by one grouped aggregation on the key
    (conditional values per kind), the relational equivalent of an inner
    equi-join of the two frames; keys missing a kind are dropped.
    """
    def pick(c, k):
        return F.max(F.when(F.col(kind) == k, F.col(c)))
    g = scored.groupBy(key).agg(pick("tox", "sampled").alias("tox_s"), pick("tox", "greedy").alias("tox_g"),
                                pick("f1", "sampled").alias("f1_s"), pick("f1", "greedy").alias("f1_g"),
                                F.sum(F.when(F.col(kind) == "sampled", 1).otherwise(0)).alias("_ns"),
                                F.sum(F.when(F.col(kind) == "greedy", 1).otherwise(0)).alias("_ng"))
    g = g.where((F.col("_ns") > 0) & (F.col("_ng") > 0))
    return g.select(key, (F.col("tox_s") - F.col("tox_g")).alias("dtox"),
                    (F.col("f1_s") - F.col("f1_g")).alias("dbert")) \
        .withColumn("total_reward", F.lit(lambda_tox) * F.col("dtox") + F.lit(lambda_bert) * F.col("dbert"))


def rl_loss(rewards: DataFrame, logprob: DataFrame, batches: DataFrame, key: str = "seq_id",
            group=("batch_id",), sign: int = 1) -> DataFrame:
    """mean(total_reward * sum_log_prob) per batch; ``sign=-1`` gives the
    negative log likelihood the description mentions."""
    j = rewards.join(logprob, key).join(batches, key)
    return j.groupBy(*group).agg((F.lit(float(sign)) * F.avg(F.col("total_reward") * F.col("sum_log"))).alias("rl_loss"))


def reward_gate(epoch: Column, alpha: float = ALPHA, warmup: int = WARMUP_EPOCHS) -> Column:
    """The reward term counts only when alpha != 0 and epoch >= warmup."""
    return F.lit(alpha != 0) & (epoch >= F.lit(warmup))


def full_loss(ml: DataFrame, rl: DataFrame, group=("epoch", "batch_id"), alpha: float = ALPHA,
              warmup: int = WARMUP_EPOCHS) -> DataFrame:
    """ml_loss + alpha * rl_loss behind the warm-up gate, per epoch and batch."""
    j = ml.join(rl, list(group), "left")
    rl_term = F.when(reward_gate(F.col("epoch"), alpha, warmup), F.lit(alpha) * F.coalesce(F.col("rl_loss"), F.lit(0.0))) \
        .otherwise(F.lit(0.0))
    return j.select(*group, "ml_loss", F.coalesce(F.col("rl_loss"), F.lit(0.0)).alias("rl_loss"),
                    (F.col("ml_loss") + rl_term).alias("full_loss"))


def mean_loss(losses: DataFrame, group=("run_id", "epoch"), loss_col: str = "loss") -> DataFrame:
    """Mean loss per group (training epoch or evaluation pass)."""
    return losses.groupBy(*group).agg(F.avg(loss_col).alias("mean_loss"), F.count(F.lit(1)).alias("n_batches"))
