"""Intervals for comparing runs (A7, A16): a Poisson bootstrap in one pass.

A bootstrap sample takes each row a random number of times. Here that number
is drawn from a Poisson law of mean one by a hash of the row's key and the
replicate, so no row has to know of any other: each task weighs its rows for
all replicates and adds up sums of a fixed size, which then meet.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.functions.mathx import md5_draw

REPLICATES = 100
DRAW_BITS = 60
#: rows that are weighed at once, and groups whose sums a task holds
PIECE = 1 << 13
HELD_GROUPS = 1 << 10


def poisson_bounds(bits: int = DRAW_BITS) -> list[int]:
    """Least draws of ``bits`` bits that mean at least 1, 2, 3, ... times: the
    distribution function of a Poisson law of mean one, as integers."""
    out, p, total, k = [], math.exp(-1), 0.0, 0
    while True:
        total += p
        bound = int(total * (1 << bits))
        if bound >= (1 << bits) - 1 or out and bound <= out[-1] or k > 17:
            return out
        out.append(bound)
        k += 1
        p /= k


def poisson_weight(key: Column) -> Column:
    """How often a row is taken, from the first 60 bits of its key's md5."""
    draw = md5_draw(key)
    return sum(((draw >= F.lit(b)).cast("int") for b in poisson_bounds()), F.lit(0)).cast("bigint")


def _drawn_weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """``poisson_weight`` of each key in each replicate."""
    texts = [f"{seed}:{r}:".encode() for r in range(replicates)]
    drawn = b"".join(md5(t + k).digest()[:8] for k in (k.encode() for k in keys) for t in texts)
    draws = np.frombuffer(drawn, dtype=">u8").astype(np.uint64) >> np.uint64(64 - DRAW_BITS)
    bounds = np.array(poisson_bounds(), dtype=np.uint64)
    return np.searchsorted(bounds, draws, side="right").reshape(len(keys), replicates).astype(np.float64)


def _partial_sums(group: list[str], values: list[str], replicates: int, seed: int):
    """Of a task's rows: for each group and replicate the weights' sum ``n``, and for
    each value the weighted sum and the weights of its rows. A key is
    drawn for once in a piece, however many groups hold it."""
    def flushed(sums: dict, kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in sums for _ in range(replicates)], type=kinds[i]) for i in range(len(group))]
        columns.append(pa.array(np.tile(np.arange(replicates, dtype=np.int32), len(sums))))
        found = np.concatenate(list(sums.values()), axis=1)
        names = [*group, "replicate", "n", *[f"_{x}{i}" for x in "sc" for i in range(len(values))]]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(row) for row in found]], names=names)

    def partial(batches):
        sums, kinds = {}, None
        for batch in batches:
            kinds = [batch.schema.field(g).type for g in group]
            for at in range(0, batch.num_rows, PIECE):
                rows = batch.slice(at, PIECE)
                keys = rows.column("_k").dictionary_encode()
                weights = _drawn_weights(keys.dictionary.to_pylist(), replicates, seed)
                key = keys.indices.to_numpy()
                cols = [rows.column(f"_v{i}") for i in range(len(values))]
                there = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in cols], dtype=np.float64).reshape(len(cols), -1)
                found = np.array([c.fill_null(0.0).to_numpy() for c in cols]).reshape(len(cols), -1)
                members = {}
                for i, g in enumerate(zip(*[rows.column(g).to_pylist() for g in group]) if group else [()] * rows.num_rows):
                    members.setdefault(g, []).append(i)
                for g, ix in members.items():
                    w = weights[key[ix]]
                    part = np.vstack([w.sum(axis=0)[None], found[:, ix] @ w, there[:, ix] @ w])
                    sums[g] = sums[g] + part if g in sums else part
                if len(sums) > HELD_GROUPS:
                    yield flushed(sums, kinds)
                    sums = {}
        if sums:
            yield flushed(sums, kinds)
    return partial


def bootstrap_sums(rows: DataFrame, key: str, values: list[str], group=(), replicates: int = REPLICATES,
                   seed: int = 42) -> DataFrame:
    """(group, replicate, n, value means): the weighted mean of each value in
    each replicate; null values are left out of their own mean only."""
    group, values = list(group), list(values)
    r = rows.select(*group, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"),
                    *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    kinds = [f"`{g}` {r.schema[g].dataType.simpleString()}" for g in group]
    sums = [f"_{x}{i}" for x in "sc" for i in range(len(values))]
    part = r.mapInArrow(_partial_sums(group, values, replicates, seed),
                        ", ".join([*kinds, "replicate int", "n double", *[f"{c} double" for c in sums]]))
    g = part.groupBy(*group, "replicate").agg(F.sum("n").cast("bigint").alias("n"), *[F.sum(c).alias(c) for c in sums])
    means = [F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}") / F.col(f"_c{i}")).alias(v) for i, v in enumerate(values)]
    return g.select(*group, "replicate", "n", *means)


def bootstrap_intervals(rows: DataFrame, key: str, values: list[str], group=(), level: float = 0.9,
                        replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """(group, metric, mean, low, high): of every value its mean over the rows
    and the interval between the outer quantiles of its replicates' means.
    Quantiles interpolate between ranks; groups whose values are all null have null intervals."""
    if not 0 < level < 1:
        raise ValueError("the level lies between 0 and 1")
    names = list(values)
    whole = rows.groupBy(*group).agg(*[F.avg(v).alias(v) for v in names])
    long = whole.unpivot(list(group), names, "metric", "mean")
    reps = bootstrap_sums(rows, key, names, group, replicates, seed).select(*group, *names).unpivot(list(group), names, "metric", "value")
    tail = (1 - level) / 2
    bounds = reps.groupBy(*group, "metric").agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))
    on = [long[g].eqNullSafe(bounds[g]) for g in group] + [long["metric"] == bounds["metric"]]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return long.join(bounds, condition).select(*[long[g] for g in group], long["metric"], "mean", "low", "high")
