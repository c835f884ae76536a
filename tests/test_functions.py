import math

import pytest
from pyspark.sql import functions as F

from parasol.functions import mathx as M
from parasol.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


@pytest.mark.parametrize("p0,p1,expected", [(0.5, 0.5, 0.75), (0.4, 0.6, 0.2), (1.0, 0.0, 1.0)])
def test_toxicity_score(spark, p0, p1, expected):
    assert one(spark, M.toxicity_score(F.lit(p0), F.lit(p1))) == pytest.approx(expected)


def test_threshold_is_strict(spark):
    from parasol.operators.metrics import style_accuracy_expr
    df = spark.createDataFrame([(0.8,), (0.79,)], "p_toxic double")
    assert df.agg(style_accuracy_expr("p_toxic", 0.8).alias("s")).first().s == pytest.approx(0.5)


def test_ln_zero_is_minus_infinity(spark):
    assert one(spark, M.safe_ln(F.lit(0.0))) == -math.inf
    assert one(spark, M.sum_log(F.array(F.lit(0.5), F.lit(0.0)))) == -math.inf


def test_softmax_and_argmax(spark):
    sm = one(spark, M.softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))))
    assert sum(sm) == pytest.approx(1.0)
    assert one(spark, M.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, M.gather(F.array(F.lit(0.1), F.lit(0.9)), F.lit(1))) == pytest.approx(0.9)


def test_cosine(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert one(spark, M.cosine(a, F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1.0)
    assert one(spark, M.cosine(a, F.array(F.lit(0.0), F.lit(3.0)))) == pytest.approx(0.0)


def test_test_ratio():
    assert M.test_ratio(0.8, 0.1) == 0.1
    with pytest.raises(ValueError):
        M.test_ratio(0.333, 0.333)


def test_mask_end_token_is_pad(spark):
    ids = F.array(*[F.lit(x) for x in (0, 5, 2, 2)])
    assert one(spark, T.attention_mask(ids, pad_id=2)) == [1, 1, 0, 0]


def test_pad_and_strip(spark):
    assert one(spark, T.pad(F.array(F.lit(0), F.lit(7), F.lit(1)), 5)) == [0, 7, 1, 1, 1]
    assert one(spark, T.strip_special(F.array(F.lit(0), F.lit(7), F.lit(1), F.lit(1)))) == [7]


def test_char_ngrams(spark):
    assert one(spark, T.char_ngrams(F.lit("abc"), 2)) == ["ab", "bc"]
    assert one(spark, T.char_ngrams(F.lit("ab"), 4)) == []


def test_tokenize(spark):
    assert one(spark, T.tokenize(F.lit("Éidiot idiot, Straße 42!"))) == ["éidiot", "idiot", "straße"]
