"""Math column functions (M1 to M8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(logits) -> Column:
    """M1, array form: max-shifted exp divided by its sum."""
    logits = _c(logits).cast("array<double>")
    # the max and the sum are lambda variables, so each is computed once per row
    return F.aggregate(
        logits, F.lit(float("-inf")), lambda m, x: F.greatest(m, x),
        lambda m: F.aggregate(F.transform(logits, lambda x: F.exp(x - m)), F.lit(0.0), lambda s, x: s + x,
                              lambda total: F.transform(logits, lambda x: F.exp(x - m) / total)))


def softmax_rows(df: DataFrame, logit: str, *keys: str, out: str = "prob") -> DataFrame:
    """M1, long form: softmax of ``logit`` over the rows sharing ``keys``. The
    maxima and sums are combined before the shuffle, so a hot key costs no
    more than its joins, which can be split."""
    top = df.groupBy(*keys).agg(F.max(logit).alias("_top"))
    e = df.join(top, list(keys)).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    total = e.groupBy(*keys).agg(F.sum("_e").alias("_total"))
    return e.join(total, list(keys)).withColumn(out, F.col("_e") / F.col("_total")).drop("_top", "_e", "_total")


def argmax(arr) -> Column:
    """M2: zero-based index of the first maximum."""
    arr = _c(arr)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def gather(arr, idx) -> Column:
    """M3: element at a zero-based index."""
    return F.element_at(_c(arr), _c(idx) + 1)


def safe_ln(p) -> Column:
    """ln that returns minus infinity at 0 (Spark's ln gives NULL there)."""
    p = _c(p)
    return F.when(p == 0, F.lit(NEG_INF)).otherwise(F.ln(p))


def sum_log(probs) -> Column:
    """M4: sum of logs of an array of probabilities."""
    return F.aggregate(_c(probs), F.lit(0.0),
                       lambda a, p: a + F.when(p == 0, F.lit(NEG_INF)).otherwise(F.ln(p)))


def toxicity_score(p0, p1) -> Column:
    """M5: ((-1)^argmax * p_argmax + 1) / 2; argmax takes class 0 on ties."""
    p0, p1 = _c(p0), _c(p1)
    return F.when(p0 >= p1, (1 + p0) / 2).otherwise((1 - p1) / 2)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """M6: cosine similarity; norms clamped at ``eps`` as torch does."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def test_ratio(train: float, val: float) -> float:
    """M7: test share as ``round(1 - train - val, 2)``; ratios must still sum to 1."""
    test = round(1 - train - val, 2)
    if abs(train + val + test - 1.0) > 1e-9:
        raise ValueError(f"split ratios {train}, {val}, {test} do not sum to 1")
    return test


def joint(sta, sim, fl) -> Column:
    """M8: joint score, per batch before averaging."""
    return _c(sta) * _c(sim) * _c(fl)


def md5_draw(key) -> Column:
    """First 60 bits of md5(key) as a non-negative integer: modulo a total it
    is a draw whose bias is below the total's share of 2^60."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 15), 16, 10).cast("bigint")


def md5_int(key) -> Column:
    """First 8 hex digits of md5(key) as a non-negative integer."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint")
