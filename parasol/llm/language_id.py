"""Operator 6, language identification by word-first backoff.

A word seen in training scores each language by the log of its frequency
there. An unseen word backs off to its character n-grams, the longest first:
the first length of which any n-gram is known scores the word by the mean log
frequency of those. A text's score per language is the sum over its words.

Words are runs of letters, lower-cased; n-grams are taken from the word with
a mark at either end. The model is fitted on a bounded sample of labelled
rows: ``SAMPLE_DOCS`` for each language, chosen by a hash of the id, and
keeps the ``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` n-grams of it,
so that it can be sent to every task. Every row is scored over its whole text.

Edge cases: a null text and one without letters is ``und`` with score 0; a
text none of whose n-grams is known gets the evenly shared score; ties go to
the first language by code point; without training rows all texts are
``und``; rows with a null label or a blank text teach nothing; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, segment_sum, stored, words

UNKNOWN = "und"
LONGEST = 5
SAMPLE_DOCS = 1000
MAX_WORDS = 50_000
MAX_GRAMS = 100_000
#: added to every count
SMOOTHING = 0.1
#: letters with their marks; digits, fractions and signs are none
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def letter_words(token: str) -> list[str]:
    return LETTERS.findall(token.lower())


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a marked word; a single character is taken unmarked."""
    if n == 1:
        return list(word)
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language of words and of n-grams by length.

    The tables are stacked: a word or n-gram is a row of ``logs``.
    """

    def __init__(self, langs: list[str], counts: list[dict[str, np.ndarray]]):
        """counts: of words, then of n-grams of length 1 to LONGEST."""
        self.langs = langs
        self.rows: list[dict[str, int]] = []
        logs = [np.zeros((0, max(1, len(langs))))]
        start = 0
        for table in counts:
            keys = list(table)
            seen = np.array([table[k] for k in keys], dtype=np.float64).reshape(len(keys), max(1, len(langs)))
            totals = seen.sum(0) + SMOOTHING * (len(keys) + 1)
            self.rows.append({k: start + i for i, k in enumerate(keys)})
            start += len(keys)
            logs.append(np.log((seen + SMOOTHING) / totals))
        self.logs = np.concatenate(logs)

    def scores(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed log score per language of each token's words, and how many
        words each token has."""
        known = self.rows[0]
        rows, weights, ends, lettered = [], [], [0], []
        for token in tokens:
            parts = letter_words(token)
            for word in parts:
                row = known.get(word)
                if row is not None:
                    rows.append(row)
                    weights.append(1.0)
                    continue
                for n in range(LONGEST, 0, -1):
                    table = self.rows[n]
                    found = [i for g in grams(word, n) if (i := table.get(g)) is not None]
                    if found:
                        rows += found
                        weights += [1 / len(found)] * len(found)
                        break
            ends.append(len(rows))
            lettered.append(len(parts))
        values = self.logs[np.array(rows, dtype=np.int64)] * np.array(weights)[:, None]
        return segment_sum(values, np.array(ends)), np.array(lettered, dtype=np.float64)


def sampled(rows: DataFrame, per_class: int, label: str) -> DataFrame:
    """About ``per_class`` rows of each class at most, chosen by the id's
    hash. Only the classes' sizes reach the driver."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("n")).collect()
    pick = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.coalesce(*[F.when(F.col(label) == r[label], F.lit(per_class / r["n"])) for r in sizes], F.lit(0.0))
    return rows.filter(pick < share)


def fit(documents: DataFrame, training: Column, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS,
        max_grams: int = MAX_GRAMS) -> Model:
    """Learn from text and lang of the rows where ``training`` holds."""
    rows = documents.filter(training & F.col("lang").isNotNull()).select("doc_id", "lang", "text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                ends, codes, uniques = words(part.column("text"), lower=False)
                split = [letter_words(t) for t in uniques.to_pylist()]
                langs = part.column("lang").to_pylist()
                found: dict[str, Counter] = {}
                for lang in set(langs):
                    mine = np.concatenate([codes[ends[i]:ends[i + 1]] for i, x in enumerate(langs) if x == lang])
                    tally = found.setdefault(lang, Counter())
                    for code, n in zip(*(x.tolist() for x in np.unique(mine, return_counts=True)), strict=True):
                        for w in split[code]:
                            tally[w] += n
                flat = [(lang, w, n) for lang, tally in found.items() for w, n in tally.items()]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*flat, strict=True)],
                                                     names=["lang", "key", "n"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "n")), strict=True):
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        tally[lang, size, g] += n
            flat = [(*k, n) for k, n in tally.items()]
            if flat:
                lang, size, key, n = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(size, pa.int32()), pa.array(key), pa.array(n)],
                                                 names=["lang", "size", "key", "n"])

    def most_frequent(counts: DataFrame, limit: int) -> Iterator[tuple[int, str, np.ndarray]]:
        by_lang = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}")
                   for i, x in enumerate(langs)]
        top = (counts.groupBy("size", "key").agg(F.sum("n").alias("total"), *by_lang)
               .orderBy(F.desc("total"), "size", "key").limit(limit).drop("total").toArrow())
        seen = np.stack([top.column(f"n{i}").to_numpy() for i in range(len(langs))], 1)
        yield from zip(top.column("size").to_pylist(), top.column("key").to_pylist(), seen, strict=True)

    chosen = sampled(rows, sample_docs, "lang").drop("doc_id")
    by_word = stored(chosen.mapInArrow(count_words, "lang string, key string, n long")
                     .groupBy("lang", "key").agg(F.sum("n").alias("n")), "lang-words")
    by_gram = stored(by_word.mapInArrow(count_grams, "lang string, size int, key string, n long")
                     .groupBy("lang", "size", "key").agg(F.sum("n").alias("n")), "lang-grams")
    langs = sorted(r["lang"] for r in by_word.select("lang").distinct().collect())
    counts: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    if langs:
        for table, limit in ((by_word.withColumn("size", F.lit(0)), max_words), (by_gram, max_grams)):
            for size, key, seen in most_frequent(table, limit):
                counts[size][key] = seen
    return Model(langs, counts)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (the share of the predicted
    language if all languages are as likely beforehand) for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in chunks(batch, "text"):
                ends, codes, uniques = words(part.column("text"), lower=False)
                scores, lettered = m.scores(uniques.to_pylist())
                total = segment_sum(scores[codes], ends)
                has = segment_sum(lettered[codes], ends) > 0.5
                best = total.argmax(1)
                share = 1 / np.exp(np.minimum(total - total.max(1, keepdims=True), 0)).sum(1)
                none = ~has | (not m.langs)
                names = [UNKNOWN if x else m.langs[b] for x, b in zip(none, best.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, share))],
                    names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def languages(documents: DataFrame) -> DataFrame:
    """Predictions for all documents by a model of three folds in four."""
    held_out = fold(F.col("doc_id"), 4) == 2
    model = fit(documents, ~held_out)
    return identify(documents, model).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score")


def accepted(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents in a language that the model tells with at least this
    share; texts without letters go. All columns are kept."""
    model = fit(documents, F.lit(True))
    good = identify(documents, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    keep = good.select(F.col("doc_id").alias("_keep")).distinct()
    return documents.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
