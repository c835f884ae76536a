"""Pluggable vectorised scorers.

A scorer is any picklable factory returning ``fn(pd.Series) -> array-like``.
The adapter wraps it in an iterator ``pandas_udf``: the factory runs once per
Python worker (e.g. to load a model) and every Arrow batch is scored in one
call. Any external model plugs in this way in place of the stand-in judges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer_udf(factory: Callable[[], Callable[[pd.Series], object]], return_type: str = "double"):
    """An Arrow-batched column function from a scorer factory."""

    @F.pandas_udf(return_type)
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = factory()
        for b in batches:
            yield pd.Series(np.asarray(fn(b)), index=b.index)

    return _score


class LexiconLogit:
    """A numpy scorer: p = sigmoid(bias + sum of weights of the words present).

    Built from a bounded word-weight list (e.g. the learned lexicon with its
    log-odds); tokens are matched as whole lower-case letter runs.
    """

    def __init__(self, weights: dict, bias: float = 0.0):
        self.weights = dict(weights)
        self.bias = float(bias)

    def __call__(self):
        weights = pd.Series(self.weights, dtype="float64")
        bias = self.bias

        def fn(texts: pd.Series):
            words = texts.reset_index(drop=True).str.lower().str.findall("[a-zß-ÿ]+").explode()
            total = words.map(weights).fillna(0.0).groupby(level=0).sum()
            return np.where(texts.isna(), np.nan, 1.0 / (1.0 + np.exp(-(bias + total.to_numpy()))))

        return fn


def score_column(col, factory, return_type: str = "double") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return scorer_udf(factory, return_type)(c)
