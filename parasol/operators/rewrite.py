"""Lexicons learned from data and the rewrite of tokens and of texts.

The rewrite is row-local: a bounded lexicon is inlined into the plan as a
literal list or map, so the same expression runs in batch and streaming
plans with no join and no shuffle. For a lexicon above ``INLINE_MAX`` entries
each row gets the few entries that its words hit by a join, and the same
expression runs with those. Either way the lexicon is put into one form first
(``canonical``), so its size never changes a result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions import spans as SP
from parasol.operators.judges import labelled_tokens

INLINE_MAX = 1024   # inlined arrays and maps are scanned linearly per token
MIN_LOG_ODDS = 4.0
MIN_SHARE = 0.2


def detox_lexicon(documents: DataFrame, labels: DataFrame, label_col: str = "toxic",
                  min_lo: float = MIN_LOG_ODDS, min_share: float = MIN_SHARE) -> DataFrame:
    """(token, a, b, lo) with smoothed log-odds over document counts.

    ``a``/``b`` count positive/negative documents holding the token (distinct
    tokens per document are taken row-locally), ``na``/``nb`` are class sizes:
    ``lo = ln((a+.5)/(na-a+.5)) - ln((b+.5)/(nb-b+.5))``, kept when
    ``lo >= min_lo`` and ``a >= min_share * na``.

    Without positive documents the lexicon is empty.

    Size bound: every kept token lies in at least ``min_share`` of the positive
    documents, so the lexicon has at most ``max distinct tokens per document /
    min_share`` entries whatever the corpus size.
    """
    lt = labelled_tokens(documents, labels, label_col)
    lab = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull()) \
        .join(documents.select("doc_id"), "doc_id")
    cls = lab.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("na"),
                  F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("nb")).first()
    na, nb = float(cls["na"] or 0), float(cls["nb"] or 0)
    occ = lt.select("y", F.explode(F.array_distinct("tokens")).alias("token"))
    cnt = occ.groupBy("token").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).cast("bigint").alias("a"),
                                   F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).cast("bigint").alias("b"))
    lo = (F.ln((F.col("a") + 0.5) / (F.lit(na) - F.col("a") + 0.5))
          - F.ln((F.col("b") + 0.5) / (F.lit(nb) - F.col("b") + 0.5)))
    return cnt.withColumn("lo", lo).where(
        (F.col("a") > 0) & (F.col("lo") >= min_lo) & (F.col("a") >= min_share * na))


def replacement_table(pairs: DataFrame, source: str = "toxic", target: str = "neutral1") -> DataFrame:
    """Most frequent aligned target per source token, where it differs.

    Tokens are aligned by position (row-local ``arrays_zip`` of equal-length
    rows, no join); counting is one partial aggregation, the choice a
    ``max_by`` per source token (ties to the larger target).
    """
    s = F.split(F.col(source), " ")
    t = F.split(F.col(target), " ")
    aligned = pairs.where(F.size(s) == F.size(t)).select(F.explode(F.arrays_zip(s.alias("src"), t.alias("tgt"))).alias("z"))
    counts = aligned.groupBy(F.col("z.src").alias("src"), F.col("z.tgt").alias("tgt")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("src").agg(F.max_by("tgt", F.struct("n", "tgt")).alias("tgt"),
                                     F.max("n").alias("n"), F.sum("n").alias("n_src"))
    return best.where(F.col("src") != F.col("tgt"))


def canonical(lexicon: DataFrame, word_col: str = "token", target_col: str | None = None) -> DataFrame:
    """One row per word: ``word`` and, with targets, ``target``. Null words and
    null targets change nothing and go; of a word's targets the least counts."""
    lex = lexicon.where(F.col(word_col).isNotNull())
    if target_col is None:
        return lex.select(F.col(word_col).alias("word")).distinct()
    return lex.where(F.col(target_col).isNotNull()).groupBy(F.col(word_col).alias("word")).agg(F.min(target_col).alias("target"))


def bounded_collect(df: DataFrame, limit: int):
    """All rows, or None if there are more than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def delete_words(tokens: Column, words) -> Column:
    """R9 ``mode='delete'`` as an expression over an inlined word list."""
    words = sorted(words)
    return F.filter(tokens, lambda t: ~t.isin(words) if words else t.isNotNull())


def replace_words(tokens: Column, mapping: dict) -> Column:
    """R9 ``mode='replace'`` as an expression over an inlined map."""
    if not mapping:
        return tokens
    keys = sorted(mapping)
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(mapping[k]) for k in keys]))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(m, t), t))


def delete_words_udf(words):
    """R9 ``mode='delete'`` for lexicons above ``INLINE_MAX``, stateless and
    row-local (for streams, where a join-and-regroup would need state): an
    Arrow-batched UDF that checks tokens against a Python set."""
    lex = frozenset(words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _drop(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [t for t in ts if t not in lex])

    return _drop


def replace_words_udf(mapping: dict):
    """R9 ``mode='replace'`` for maps above ``INLINE_MAX``, as ``delete_words_udf``."""
    to = dict(mapping)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def _put(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [to.get(t, t) for t in ts])

    return _put


def lexicon_hits(df: DataFrame, key: str, words: Column, lex: DataFrame) -> DataFrame:
    """(_k, _hits): for every key the entries of a canonical lexicon that its
    rows' words hit, as a map. Only words that the lexicon has are regrouped."""
    target = F.col("target") if "target" in lex.columns else F.lit("")
    e = df.select(F.col(key).alias("_k"), F.explode(words).alias("_word")).where(F.col("_word").isNotNull())
    return e.join(lex, e["_word"] == lex["word"]).groupBy("_k").agg(
        F.map_from_entries(F.collect_set(F.struct("word", target))).alias("_hits"))


def _with_hits(df: DataFrame, key: str, words: Column, lex: DataFrame) -> DataFrame:
    hits = lexicon_hits(df, key, words, lex)
    none = F.create_map().cast("map<string,string>")
    return df.join(hits, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k") \
        .withColumn("_hits", F.coalesce("_hits", none))


def rewrite(df: DataFrame, key: str, tokens_col: str, lexicon: DataFrame, mode: str = "delete",
            out: str = "text", word_col: str = "token", target_col: str = "tgt") -> DataFrame:
    """Rewrite every row's tokens with a lexicon and join them by one blank.

    ``lexicon`` is a table of words (``delete``) or of ``(word, target)``
    pairs (``replace``), see ``canonical`` for nulls and repeated words. Null
    tokens vanish; null token arrays give null.
    """
    if mode not in ("delete", "replace"):
        raise ValueError("mode must be 'delete' or 'replace'")
    lex = canonical(lexicon, word_col, target_col if mode == "replace" else None)
    rows = bounded_collect(lex, INLINE_MAX)
    tokens = F.col(tokens_col)
    if rows is not None:
        expr = delete_words(tokens, [r[0] for r in rows]) if mode == "delete" else replace_words(tokens, dict(map(tuple, rows)))
        return df.withColumn(out, F.array_join(expr, " "))
    df = _with_hits(df.drop(out) if out != tokens_col else df, key, F.array_distinct(tokens), lex)
    hit = F.col("_hits")
    if mode == "delete":
        expr = F.filter(tokens, lambda t: ~F.map_contains_key(hit, t))
    else:
        expr = F.transform(tokens, lambda t: F.when(t.isNotNull(), F.coalesce(F.try_element_at(hit, t), t)))
    return df.withColumn(out, F.array_join(expr, " ")).drop("_hits")


def _changed(parts: Column, found, mode: str) -> Column:
    """Pieces with those words deleted or replaced that ``found`` gives a value for."""
    def one(p):
        to = found(F.lower(p))
        return F.when(to.isNull(), p).otherwise(F.lit("") if mode == "delete" else SP.in_case_of(to, p))
    return SP.joined(F.transform(parts, one))


def rewrite_piece_column(parts: Column, words=None, mapping: dict | None = None) -> Column:
    """R9 on pieces (``spans.pieces``) with an inlined lexicon: the listed words
    go, or give way to their targets in the word's own case; all other code
    points stay as they are."""
    if mapping:
        keys = sorted(mapping)
        m = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.lit(mapping[k]) for k in keys]))
        return _changed(parts, lambda w: F.try_element_at(m, w), "replace")
    words = sorted(words or ())
    return _changed(parts, lambda w: F.when(w.isin(words), F.lit("")), "delete") if words else SP.joined(parts)


def rewrite_pieces_udf(words=None, mapping: dict | None = None):
    """As ``rewrite_piece_column`` for a large lexicon inside a stream: an
    Arrow-batched UDF that looks the words up in a Python map."""
    to = dict(mapping) if mapping else dict.fromkeys(words or (), "")

    def cased(target: str, piece: str) -> str:
        if len(piece) > 1 and piece == piece.upper() != piece.lower():
            return target.upper()
        return target[:1].upper() + target[1:] if piece[0] != piece[0].lower() else target

    @F.pandas_udf(T.StringType())
    def change(parts: pd.Series) -> pd.Series:
        return parts.map(lambda ps: None if ps is None else "".join(
            p if (t := to.get(p.lower())) is None else cased(t, p) for p in ps))

    return change


def rewrite_text(df: DataFrame, key: str, text_col: str, lexicon: DataFrame, mode: str = "delete",
                 out: str = "rewritten", word_col: str = "token", target_col: str = "tgt") -> DataFrame:
    """R9 on whole texts: every word of the lexicon (lower case) goes, or gives
    way to its target; all other code points are equal to the text's.

    A null text gives null; a text without a listed word is returned as it
    is; rows that share a key are each rewritten by their own words.
    """
    if mode not in ("delete", "replace"):
        raise ValueError("mode must be 'delete' or 'replace'")
    lex = canonical(lexicon, word_col, target_col if mode == "replace" else None)
    rows = bounded_collect(lex, INLINE_MAX)
    parts = SP.pieces(text_col)
    if rows is not None:
        made = rewrite_piece_column(parts, [r[0] for r in rows]) if mode == "delete" else (
            rewrite_piece_column(parts, mapping=dict(map(tuple, rows))))
        return df.withColumn(out, made)
    df = _with_hits(df, key, SP.words(parts), lex)
    hit = F.col("_hits")
    return df.withColumn(out, _changed(parts, lambda w: F.try_element_at(hit, w), mode)).drop("_hits")
