"""Phrases (R5, R9): runs of words that mark toxic documents, and their
replacement by leftmost-longest matches.

A phrase is one to ``MAX_WORDS`` words, learned like the lexicon's words by
smoothed log-odds over documents. A longer phrase stays only if it tells more
than each phrase inside it, so a strong word does not bring in all its
neighbourhoods. The matcher is one automaton over all phrases (Aho-Corasick),
built from a table of a checked size and sent once to every worker; a word is
one symbol to it, so that phrases match whole words only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions.text import word_ngrams
from parasol.operators.judges import labelled_tokens
from parasol.operators.rewrite import INLINE_MAX, MIN_LOG_ODDS, MIN_SHARE, bounded_collect
from parasol.session import cut_lineage

MAX_WORDS = 3
#: phrases that a worker is sent; the sum of their lengths is bounded by MAX_CHARACTERS
MAX_PHRASES = 1_000_000
MAX_CHARACTERS = 64 << 20
#: candidates that a join may broadcast
SENT_PHRASES = 100_000


def _runs(tokens: str, max_words: int, words=None) -> Column:
    """Distinct runs of one to ``max_words`` words of a token column, and a
    null; with ``words``, only runs of those."""
    known = F.transform(tokens, lambda t: F.when(t.isin(words), t)) if words else F.col(tokens)
    runs = [known]
    for n in range(2, max_words + 1):     # null where a word isn't known, or beyond the end
        runs.append(F.zip_with(runs[-1], F.slice(known, n, F.size(tokens)), lambda run, t: F.concat(run, F.lit(" "), t)))
    return F.array_distinct(F.concat(*runs))


def sent_if_few(phrases: DataFrame) -> DataFrame:
    """Phrases for a join: broadcast up to ``SENT_PHRASES``, which are counted."""
    return F.broadcast(phrases) if phrases.limit(SENT_PHRASES + 1).count() <= SENT_PHRASES else phrases


def detox_phrases(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", max_words: int = MAX_WORDS,
                  min_lo: float = MIN_LOG_ODDS, min_share: float = MIN_SHARE) -> DataFrame:
    """R5 for phrases: (phrase, words, a, b, lo).

    ``a``/``b`` count positive/negative documents that hold the phrase; kept
    when ``lo >= min_lo`` and ``a >= min_share`` of the positive documents, and
    when no shorter phrase inside it has as much log-odds. Without positive
    documents there are no phrases. At most (words of the longest document
    times ``max_words`` / ``min_share``) phrases are kept, whatever the corpus.
    """
    lt = cut_lineage(labelled_tokens(documents, labels, label_col).select("y", "tokens"), name="labelled")
    cls = lt.agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("na"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("nb")).first()
    na, nb = float(cls["na"] or 0), float(cls["nb"] or 0)

    def held(rows, phrases, count):
        return rows.select(F.explode(phrases).alias("phrase")).where(F.col("phrase").isNotNull()).groupBy("phrase").agg(
            F.count(F.lit(1)).alias(count))
    enough = (F.col("a") > 0) & (F.col("a") >= min_share * na)
    # a phrase is in no more documents than each of its words: only runs of words with enough positive documents are made
    positive = lt.where("y = 1")
    words = bounded_collect(held(positive, F.array_distinct("tokens"), "a").where(enough).select("phrase"), INLINE_MAX)
    grams = _runs("tokens", max_words, words and [r[0] for r in words])
    candidates = cut_lineage(held(positive, grams, "a").where(enough), name="candidates")
    others = lt.where("y = 0").select(F.explode(grams).alias("phrase")).join(
        sent_if_few(candidates.select("phrase")), "phrase").groupBy("phrase").agg(F.count(F.lit(1)).alias("b"))
    counts = candidates.join(others, "phrase", "left").fillna({"b": 0})
    lo = (F.ln((F.col("a") + 0.5) / (F.lit(na) - F.col("a") + 0.5)) - F.ln((F.col("b") + 0.5) / (F.lit(nb) - F.col("b") + 0.5)))
    kept = counts.withColumn("lo", lo).where(F.col("lo") >= min_lo)
    kept = cut_lineage(kept.select("phrase", F.size(F.split("phrase", " ")).alias("words"), "a", "b", "lo"), name="phrases")
    tokens = F.split("phrase", " ")
    inside = F.array_distinct(F.concat(*[word_ngrams(tokens, n) for n in range(1, max_words)])) if max_words > 1 else F.array().cast("array<string>")
    parts = kept.select("phrase", "lo", F.explode(inside).alias("part")).where(F.col("part") != F.col("phrase"))
    worse = parts.join(kept.select(F.col("phrase").alias("part"), F.col("lo").alias("part_lo")), "part") \
        .where(F.round("part_lo", 9) >= F.round("lo", 9)).select("phrase").distinct()
    return kept.join(worse, "phrase", "left_anti")


def collect_phrases(phrases: DataFrame, phrase_col: str = "phrase", target_col: str | None = None) -> dict[str, str]:
    """phrase -> target (empty without targets), of a table whose size is
    checked; null and blank phrases go, of a phrase's targets the least counts."""
    target = F.coalesce(F.min(target_col), F.lit("")) if target_col else F.lit("")
    rows = phrases.where(F.trim(phrase_col) != "").groupBy(F.col(phrase_col).alias("phrase")).agg(target.alias("target"))
    size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("phrase") + F.length("target")), F.lit(0))).first()
    if size[0] > MAX_PHRASES or size[1] > MAX_CHARACTERS:
        raise ValueError(f"{size[0]} phrases of {size[1]} characters are too many to send to every worker")
    return {r["phrase"]: r["target"] for r in bounded_collect(rows, MAX_PHRASES)}


class PhraseMatcher:
    """Leftmost-longest matches of phrases in token lists."""

    def __init__(self, phrases):
        import ahocorasick
        self.symbols: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for phrase in sorted(phrases):
            words = phrase.split()
            coded = "".join(self.symbols.setdefault(w, self._symbol(len(self.symbols))) for w in words)
            self.automaton.add_word(coded, (len(words), phrase))
        self.empty = not phrases
        if not self.empty:
            self.automaton.make_automaton()

    @staticmethod
    def _symbol(i: int) -> str:
        """A code point for each word, 0 for unknown ones; surrogates are left out."""
        i += 1
        return chr(i if i < 0xD800 else i + 0x800)

    def matches(self, tokens) -> list[tuple[int, int, str]]:
        """(first token, number of tokens, phrase), from left to right, none within another."""
        if self.empty or tokens is None or not len(tokens):
            return []
        known = self.symbols
        coded = "".join([known.get(t, "\0") for t in tokens])
        best: dict[int, tuple[int, str]] = {}
        for end, (n, phrase) in self.automaton.iter(coded):
            start = end - n + 1
            if n > best.get(start, (0, ""))[0]:
                best[start] = n, phrase
        out, free = [], 0
        for start in sorted(best):
            if start >= free:
                out.append((start, *best[start]))
                free = start + best[start][0]
        return out

    def rewritten(self, tokens, targets: dict[str, str]) -> str | None:
        """The tokens with every match replaced by its target, joined by blanks."""
        if tokens is None:
            return None
        out, at = [], 0
        for start, n, phrase in self.matches(tokens):
            out += [t for t in tokens[at:start] if t is not None]
            out += targets[phrase].split()
            at = start + n
        return " ".join(out + [t for t in tokens[at:] if t is not None])


def phrase_rewriter(spark: SparkSession, targets: dict[str, str]):
    """A column function: token array -> text with the phrases replaced (or
    deleted, where the target is empty). Row-local, alike in batch and stream;
    each worker builds the automaton once."""
    if len(targets) > MAX_PHRASES:
        raise ValueError("too many phrases to send to every worker")
    sent = spark.sparkContext.broadcast(targets)

    def rewrite(batches):
        table = sent.value
        matcher = PhraseMatcher(table)
        for tokens in batches:
            yield tokens.map(lambda ts: matcher.rewritten(ts, table))
    from collections.abc import Iterator
    rewrite.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(rewrite, T.StringType())
