"""The flagship slice: learn a lexicon from labels, rewrite, score.

derived pairs -> R5 lexicon from ``labels`` -> R9 delete on the toxic side ->
A1 character BLEU against the gold and A2 style accuracy per batch of 16 ->
means over batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.functions.text import tokenize
from parasol.operators import judges as JU
from parasol.operators import metrics as ME
from parasol.operators import rewrite as RE
from parasol.operators import split as SP
from parasol.operators.bleu import bleu_rowlocal
from parasol.plans import derived as D
from parasol.session import cut_lineage


def flagship_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels")
    pairs = cut_lineage(D.pairs(spark, sf_dir), name="pairs").withColumn("x_tokens", F.split("toxic", " "))
    lex = RE.detox_lexicon(docs, labels)
    rewritten = RE.rewrite(pairs, "pair_id", "x_tokens", lex, "delete", out="y_pred")
    bleu = bleu_rowlocal(rewritten, "pair_id", "y_pred", "neutral1")
    judge = JU.fit_nb(docs, labels, "toxic")
    tox = JU.score_tokens(rewritten.select("pair_id", tokenize("y_pred").alias("t")), "pair_id",
                          {"p_toxic": "t"}, judge)
    batches = SP.eval_batches(pairs.select("pair_id"), 16)
    rows = bleu.join(tox, "pair_id").join(batches, "pair_id")
    return rows.groupBy("batch_id").agg(F.avg("bleu").alias("bleu"),
                                        ME.style_accuracy_expr("p_toxic").alias("sta"),
                                        F.count(F.lit(1)).alias("n_rows"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = flagship_batches(spark, sf_dir)
    return b.agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_rows").alias("n_pairs"),
                 F.round(F.avg("bleu"), 6).alias("bleu"), F.round(F.avg("sta"), 6).alias("sta"))
