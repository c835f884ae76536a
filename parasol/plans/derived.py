"""Derived inputs: the pair corpus and friends, built from the driver tables.

Each view here is defined a second time, independently, in DuckDB SQL
(``parasol.plans.oracle``); the two must agree row for row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.functions.text import split_sentences, tokenize

# The planted words that define the derived pair corpus.
NOUNS = ("idiot", "moron", "clown", "loser", "scum", "trash")
ADJECTIVES = ("worthless", "pathetic", "stupid", "disgusting")
NOUN_TARGET = "person"
ADJECTIVE_TARGET = "poor"

SPREAD_BYTES = 32 << 20
# more sentences than a text of the longest size that a row holds is likely to have;
# leaves room for 2^39 documents and conversations
PAIR_ID_STRIDE = 1 << 24
SEQ_ID_STRIDE = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over as many tasks as there are cores: one that is one row
    group would keep a single core busy with all that is done row by row. A
    table above ``SPREAD_BYTES`` for each core has row groups enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def numbered(major: str, minor: str, stride: int) -> F.Column:
    """One id from two numbers; fails where the minor number doesn't fit."""
    fits = F.col(minor) < stride
    return F.when(fits, F.col(major) * stride + F.col(minor)).otherwise(
        F.raise_error(F.concat(F.lit(f"{minor} beyond {stride}: "), F.col(major).cast("string"))))


def sentences(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """(pair_id, doc_id, lang, tokens): every sentence of every document that
    has a token, whatever its length.

    Row-local (posexplode + regexp), no shuffle.
    """
    if docs is None:
        docs = table(spark, sf_dir, "documents")
    docs = spread(docs.select("doc_id", "lang", "text"))
    s = docs.select("doc_id", "lang", F.posexplode(split_sentences("text")).alias("sent_ix", "sentence"))
    s = s.select(numbered("doc_id", "sent_ix", PAIR_ID_STRIDE).alias("pair_id"),
                 "doc_id", "lang", tokenize("sentence").alias("tokens"))
    return s.where(F.size("tokens") > 0)


def _listed() -> F.Column:
    return F.array(*[F.lit(w) for w in NOUNS + ADJECTIVES])


def neutral_tokens(tokens) -> F.Column:
    """The gold side of a token array: nouns -> person, adjectives -> poor."""
    nouns = F.array(*[F.lit(w) for w in NOUNS])
    adjs = F.array(*[F.lit(w) for w in ADJECTIVES])
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.transform(t, lambda x: F.when(F.array_contains(nouns, x), F.lit(NOUN_TARGET))
                       .when(F.array_contains(adjs, x), F.lit(ADJECTIVE_TARGET)).otherwise(x))


def holds_listed(tokens) -> F.Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.arrays_overlap(t, _listed())


def may_hold_listed(text: str) -> F.Column:
    """Exact pre-filter: a listed token implies that the lower-cased text contains
    it. The lowered text is an array's element, so that it is made once and not for each word."""
    return F.exists(F.array(F.lower(F.col(text))), lambda low: reduce(
        Column.__or__, [low.contains(w) for w in NOUNS + ADJECTIVES]))


def pair_vocabulary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tokens) per document: those of all its sentences, then those of the gold
    side of its pairs. No token crosses a sentence's end, so the text is taken as
    a whole; only documents that may hold a listed word are split."""
    docs = spread(table(spark, sf_dir, "documents").select("text"))
    held = F.filter(F.transform(split_sentences("text"), tokenize), holds_listed)
    gold = F.when(may_hold_listed("text"), F.flatten(F.transform(held, neutral_tokens))).otherwise(
        F.array().cast("array<string>"))
    return docs.where(F.col("text").isNotNull()).select(F.concat(tokenize("text"), gold).alias("tokens"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, lang, toxic, neutral1, hyp): sentences holding a listed word.

    ``neutral1`` replaces nouns and adjectives position by position (gold),
    ``hyp`` deletes every listed word (a rewriter's output).
    """
    listed = _listed()
    # documents that can't hold a listed word are never split or tokenised
    docs = table(spark, sf_dir, "documents").where(may_hold_listed("text"))
    s = sentences(spark, sf_dir, docs=docs).where(F.arrays_overlap("tokens", listed))
    return s.select(
        "pair_id", "lang",
        F.array_join("tokens", " ").alias("toxic"),
        F.array_join(neutral_tokens("tokens"), " ").alias("neutral1"),
        F.array_join(F.filter("tokens", lambda t: ~F.array_contains(listed, t)), " ").alias("hyp"),
    )


def all_sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, toxic, neutral1, hyp) of every sentence; one without a listed
    word is its own gold and rewrite."""
    listed = _listed()
    return sentences(spark, sf_dir).select(
        "pair_id", F.array_join("tokens", " ").alias("toxic"),
        F.array_join(neutral_tokens("tokens"), " ").alias("neutral1"),
        F.array_join(F.filter("tokens", lambda t: ~F.array_contains(listed, t)), " ").alias("hyp"))


def sentence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, toxic) of every sentence: what ``paired`` needs."""
    return sentences(spark, sf_dir).select("pair_id", F.array_join("tokens", " ").alias("toxic"))


def paired(texts: DataFrame) -> DataFrame:
    """``all_sentence_pairs`` from ``sentence_texts``, whose other columns stay."""
    tokens, listed = F.split("toxic", " "), _listed()
    return texts.withColumns({
        "neutral1": F.array_join(neutral_tokens(tokens), " "),
        "hyp": F.array_join(F.filter(tokens, lambda t: ~F.array_contains(listed, t)), " ")})


def candidates(spark: SparkSession, sf_dir: str, pairs_df: DataFrame | None = None) -> DataFrame:
    """(seq_id, kind, text, gold): greedy = hyp; sampled = only the nouns deleted."""
    nouns = F.array(*[F.lit(w) for w in NOUNS])
    p = pairs_df if pairs_df is not None else pairs(spark, sf_dir)
    sampled = F.array_join(F.filter(F.split("toxic", " "), lambda t: ~F.array_contains(nouns, t)), " ")
    return p.select(F.col("pair_id").alias("seq_id"),
                    F.explode(F.array(
                        F.struct(F.lit("greedy").alias("kind"), F.col("hyp").alias("text")),
                        F.struct(F.lit("sampled").alias("kind"), sampled.alias("text")))).alias("c"),
                    F.col("neutral1").alias("gold")) \
        .select("seq_id", "c.kind", "c.text", "gold")


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, conv_id, turn, pos, token) of every conversation turn."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return conv.select(numbered("conv_id", "turn", SEQ_ID_STRIDE).alias("seq_id"), "conv_id", "turn",
                       F.posexplode(tokenize("text")).alias("pos", "token"))


def turn_token_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tokens) of every conversation turn, one row per turn."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return conv.select(numbered("conv_id", "turn", SEQ_ID_STRIDE).alias("seq_id"),
                       tokenize("text").alias("tokens"))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, epoch, batch_id, loss) from ``events``: run = user, epoch = day."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    return ev.select(F.col("user_id").alias("run_id"),
                     F.unix_date(F.to_date("ts")).cast("bigint").alias("epoch"),
                     F.col("event_id").alias("batch_id"),
                     F.col("value").alias("loss"))
