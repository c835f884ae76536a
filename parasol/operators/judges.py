"""Judges fitted and applied as Spark jobs.

A judge here is multinomial naive Bayes over token occurrences: fitting is two
aggregations (token counts by class, class totals), scoring is a lookup join
of the exploded tokens against the weight table and a sum per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions.mathx import toxicity_score
from parasol.functions.text import tokenize
from parasol.session import cut_lineage

# The judge's labels.
FLUENT_LABEL = "LABEL_1"
NOT_FLUENT_LABEL = "LABEL_0"

#: tokens whose weights every worker is sent, 24 bytes each; a larger model is looked up by a join
SENT_WEIGHTS = 1 << 23
HASH_KEYS = ("judge-of-tokens1", "judge-of-tokens2")


@dataclass
class NBModel:
    weights: DataFrame       # (token, w)
    prior: float
    label: str
    table: DataFrame | None = None   # shared weight table of a joint fit (token, w_<label> ...)
    col: str | None = None           # this model's column in ``table``

    def logit_column(self):
        """A column function, token array -> log odds, for a weight table of a
        checked small size, which every worker is sent once; None for a larger one."""
        if not hasattr(self, "_logit"):
            self._logit = None
            if self.weights.count() <= SENT_WEIGHTS:
                sent = _sorted_weights(self.weights.select("token", "w").toArrow())
                if sent is not None:
                    self._logit = _local_logit(self.weights.sparkSession.sparkContext.broadcast(sent), self.prior)
        return self._logit


def _hashed(words: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each word; words are equal where both are."""
    return [pd.util.hash_array(words, hash_key=key, categorize=False) for key in HASH_KEYS]


def _sorted_weights(table: pa.Table):
    """Both hashes of the tokens and their weights, in the order of the first
    hash; None if it isn't unique."""
    parts = [_hashed(c.to_numpy(zero_copy_only=False)) for c in table.column("token").chunks if len(c)]
    first, second = (np.concatenate([np.zeros(0, dtype=np.uint64), *[p[i] for p in parts]]) for i in (0, 1))
    order = np.argsort(first)
    first = first[order]
    if (first[1:] == first[:-1]).any():
        return None
    return first, second[order], table.column("w").to_numpy()[order]


def _looked_up(words: np.ndarray, sent) -> np.ndarray:
    """The words' weights, 0 for unknown ones."""
    first, second, weights = sent
    if not len(words) or not len(first):
        return np.zeros(len(words))
    a, b = _hashed(words)
    at = np.minimum(np.searchsorted(first, a), len(first) - 1)
    return np.where((first[at] == a) & (second[at] == b), weights[at], 0.0)


def _local_logit(sent, prior: float):
    """Sums of the tokens' weights, added up for all rows of an Arrow batch at once."""
    def logit(batches):
        for rows in batches:
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            coded = rows.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False)
            w = np.append(_looked_up(words, sent.value), 0.0)      # the last one for null tokens
            codes = pc.fill_null(coded.indices, len(words)).to_numpy(zero_copy_only=False)
            yield pa.array(prior + np.bincount(np.repeat(np.arange(len(rows)), sizes), weights=w[codes], minlength=len(rows)))
    logit.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(logit, T.DoubleType())


def labelled_tokens(documents: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y, tokens) for labelled documents; labels carry no broadcast hint
    because they grow with the corpus."""
    lab = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull())
    return lab.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "y", tokenize("text").alias("tokens"))


def _prior(mean: float | None, n: int) -> float:
    """Log odds of class 1; with one class only, as if half a row were of the other."""
    if not n:
        return 0.0
    mean = min(max(mean, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))
    return math.log(mean) - math.log(1 - mean)


def class_mean(documents: DataFrame, labels: DataFrame, label_col: str):
    """Mean label and number of the labelled documents that exist (reads only ``doc_id`` of the documents)."""
    lab = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull())
    return lab.join(documents.select("doc_id"), "doc_id").agg(F.avg("y").alias("m"), F.count("y").alias("n")).first()


def fit_nb(documents: DataFrame, labels: DataFrame, label_col: str) -> NBModel:
    """R1/R2 fit: w = ln((a+1)/(na+k)) - ln((b+1)/(nb+k)), prior = logit(mean y).

    ``a``/``b`` count token occurrences in positive/negative documents,
    ``na``/``nb`` are the class token totals and ``k`` the vocabulary size.
    The count table is the model: it is written once to the shared checkpoint
    folder (lineage cut), then the totals are one small aggregate over it and
    every scoring join reads it back instead of re-tokenising the corpus.
    """
    lt = labelled_tokens(documents, labels, label_col)
    occ = lt.select("y", F.explode("tokens").alias("token"))
    counts = occ.groupBy("token").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).cast("double").alias("b"))
    counts = cut_lineage(counts)
    tot = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count(F.lit(1)).alias("k")).first()
    prior = _prior(*class_mean(documents, labels, label_col))
    na, nb, k = float(tot["na"] or 0), float(tot["nb"] or 0), float(tot["k"] or 0)
    weights = counts.select("token", (F.ln((F.col("a") + 1) / F.lit(na + k))
                                      - F.ln((F.col("b") + 1) / F.lit(nb + k))).alias("w"))
    return NBModel(weights, prior, label_col)


def fit_nb_many(documents: DataFrame, labels: DataFrame, label_cols) -> dict:
    """R1 + R2 fitted together: one tokenisation pass and one aggregation for
    all label columns; same weights as ``fit_nb`` per label (a token unseen in
    a label's documents weighs 0 for that label)."""
    label_cols = list(label_cols)
    lab = labels.select("doc_id", *[F.col(c).cast("int").alias(c) for c in label_cols])
    any_label = None
    for c in label_cols:
        cond = F.col(c).isNotNull()
        any_label = cond if any_label is None else (any_label | cond)
    lab = lab.where(any_label)
    occ = lab.join(documents.select("doc_id", "text"), "doc_id") \
        .select(*label_cols, F.explode(tokenize("text")).alias("token"))
    aggs = []
    for c in label_cols:
        aggs.append(F.sum(F.when(F.col(c) == 1, 1).otherwise(0)).cast("double").alias(f"a_{c}"))
        aggs.append(F.sum(F.when(F.col(c) == 0, 1).otherwise(0)).cast("double").alias(f"b_{c}"))
    counts = cut_lineage(occ.groupBy("token").agg(*aggs))
    tot_aggs = []
    for c in label_cols:
        tot_aggs += [F.sum(f"a_{c}").alias(f"na_{c}"), F.sum(f"b_{c}").alias(f"nb_{c}"),
                     F.count(F.when(F.col(f"a_{c}") + F.col(f"b_{c}") > 0, 1)).alias(f"k_{c}")]
    tot = counts.agg(*tot_aggs).first()
    means = lab.join(documents.select("doc_id"), "doc_id").agg(
        *[F.avg(c).alias(c) for c in label_cols], *[F.count(c).alias(f"n_{c}") for c in label_cols]).first()
    wcols = {}
    for c in label_cols:
        na, nb, k = float(tot[f"na_{c}"] or 0), float(tot[f"nb_{c}"] or 0), float(tot[f"k_{c}"] or 0)
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        wcols[c] = F.when(a + b > 0, F.ln((a + 1) / F.lit(na + k)) - F.ln((b + 1) / F.lit(nb + k)))
    table = counts.select("token", *[w.alias(f"w_{c}") for c, w in wcols.items()])
    models = {}
    for c in label_cols:
        models[c] = NBModel(table.where(F.col(f"w_{c}").isNotNull()).select("token", F.col(f"w_{c}").alias("w")),
                            _prior(means[c], means[f"n_{c}"]), c, table, f"w_{c}")
    return models


def score_tokens(df: DataFrame, key, tokens_cols: dict, model: NBModel, output: str = "prob") -> DataFrame:
    """J4 + R1 scoring: probability of class 1 for each token-array column.

    ``tokens_cols`` maps output column to token-array column. Unknown tokens add
    0, null arrays give the prior. A small model scores every row in place; a
    larger one goes through one explode, one weight join and one group-by by
    ``key``, which then has to tell the rows apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if output not in ("prob", "logit"):
        raise ValueError("output must be 'prob' or 'logit'")
    local = model.logit_column()
    if local is not None:
        score = (lambda x: x) if output == "logit" else (lambda x: 1 / (1 + F.exp(-x)))
        return df.select(*keys, *[score(local(c)).alias(out) for out, c in tokens_cols.items()])
    parts = [F.struct(F.lit(out).alias("side"), F.col(c).alias("toks")) for out, c in tokens_cols.items()]
    e = df.select(*keys, F.explode(F.array(*parts)).alias("s")) \
        .select(*keys, "s.side", F.explode_outer("s.toks").alias("token"))
    j = e.join(model.weights, "token", "left")
    g = j.groupBy(*keys).agg(*[F.sum(F.when(F.col("side") == side, F.coalesce("w", F.lit(0.0)))).alias(side)
                               for side in tokens_cols])
    logit = {c: F.lit(model.prior) + F.coalesce(F.col(c), F.lit(0.0)) for c in tokens_cols}
    if output == "logit":
        return g.select(*keys, *[logit[c].alias(c) for c in tokens_cols])
    return g.select(*keys, *[(1 / (1 + F.exp(-logit[c]))).alias(c) for c in tokens_cols])


def fluency_label(p) -> F.Column:
    """R2 label: LABEL_1 when the fluency probability is at least 0.5."""
    return F.when(p >= 0.5, F.lit(FLUENT_LABEL)).otherwise(F.lit(NOT_FLUENT_LABEL))


def politeness(p_toxic) -> F.Column:
    """M5 on a class-1 probability."""
    return toxicity_score(1 - p_toxic, p_toxic)


def fit_ml_judge(documents: DataFrame, labels: DataFrame, label_col: str = "toxic",
                 num_features: int = 1 << 18, max_iter: int = 50):
    """R1 alternative: a Spark ML pipeline (regex tokens, hashed counts,
    logistic regression). Save and restore it with ``PipelineModel.write()``
    / ``PipelineModel.load()`` (S6)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    train = labels.select("doc_id", F.col(label_col).cast("double").alias("label")) \
        .where(F.col("label").isNotNull()).join(documents.select("doc_id", "text"), "doc_id")
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_toks", pattern="[a-zß-ÿ]+", gaps=False, toLowercase=True),
        HashingTF(inputCol="_toks", outputCol="_tf", numFeatures=num_features),
        LogisticRegression(featuresCol="_tf", labelCol="label", maxIter=max_iter, regParam=0.01),
    ])
    return pipe.fit(train)


def score_ml_judge(model, df: DataFrame, text_col: str, out: str = "p") -> DataFrame:
    """Probability of class 1 from a fitted ML judge."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(df.withColumnRenamed(text_col, "text"))
    return scored.withColumn(out, vector_to_array("probability")[1]) \
        .drop("_toks", "_tf", "rawPrediction", "probability", "prediction").withColumnRenamed("text", text_col)
