"""Word alignment of pairs whose sides may differ in length (R6), learned by
expectation maximisation.

The model is a table (given, made, p): the probability that a word of one
side is made from a word of the other side, or from none (``NONE``). A pair
counts through the distinct words of its sides and how often each occurs.

All that a made word's probabilities need but one number for each given word, the
sum of its shares, is in the pairs that hold the made word. So the pairs' given
words are dealt out by made word, in buckets of a bounded size, and a round in a
bucket shares each made word's count among the pair's given words in proportion
to their probabilities. Only the sums per given word leave the
bucket and are sent to all of the next round, which goes through the earlier
rounds again from their sums: no table of co-occurrences is ever stored, joined or
shuffled. Where the given words are too many to be sent, a round is three steps
over one stored table of co-occurrences instead:

1. join the probabilities on (given, made);
2. per pair and made word, share the word's count among the given words;
3. add up the shares per (given, made) and normalise per given word.

Of the words only those sums are collected; a frequent word is added up before it is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parasol.operators import judges as JU
from parasol.session import cut_lineage

# Fixed value: the given side's empty word.
NONE = ""
ITERATIONS = 3
#: co-occurrences that a bucket holds, unless one made word has more
CELLS = 1 << 21


def _counts(sides: DataFrame, tokens: str, word: str, n: str) -> DataFrame:
    e = sides.select("pair", F.explode(tokens).alias(word)).where(F.col(word).isNotNull() & (F.col(word) != NONE))
    return e.groupBy("pair", word).agg(F.count(F.lit(1)).alias(n))


def _sides(pairs: DataFrame, given: str, made: str) -> DataFrame:
    """The different pairs and how many copies there are of each."""
    return pairs.select(F.col(given).alias("g"), F.col(made).alias("m")).groupBy("g", "m").agg(F.count(F.lit(1)).alias("copies"))


def cooccurrences(pairs: DataFrame, given: str, made: str) -> DataFrame:
    """(pair, given, n_given, made, n_made, copies): the co-occurring words of
    each different pair, with their numbers in it. Equal pairs are one with a
    number of copies. The empty word stands once on every given side. A pair
    has as many rows as the product of its sides' distinct words."""
    sides = cut_lineage(_sides(pairs, given, made).withColumn("pair", F.monotonically_increasing_id()), name="sides")
    none = sides.select("pair", F.lit(NONE).alias("given"), F.lit(1).cast("bigint").alias("n_given"))
    words = _counts(sides, "g", "given", "n_given").unionByName(none)
    return words.join(_counts(sides, "m", "made", "n_made").join(sides.select("pair", "copies"), "pair"), "pair")


def _shares(co: DataFrame, model: DataFrame | None) -> DataFrame:
    """(given, made, share): each made word's count dealt to the pair's given
    words. A pair's given words of one made word meet in one row."""
    if model is None:   # all words are as likely at first
        weighed = co.withColumn("w", F.col("n_given").cast("double"))
    else:
        weighed = co.join(model.select("given", "made", "p"), ["given", "made"]).withColumn("w", F.col("n_given") * F.col("p"))
    rows = weighed.groupBy("pair", "made").agg(F.collect_list(F.struct("given", "w")).alias("ws"), F.sum("w").alias("total"),
                                               F.max(F.col("n_made") * F.col("copies")).alias("n"))
    return rows.select("made", "n", "total", F.explode("ws").alias("x")).select(
        F.col("x.given").alias("given"), "made", (F.col("n") * F.col("x.w") / F.col("total")).alias("share"))


def _normalised(shares: DataFrame) -> DataFrame:
    sums = cut_lineage(shares.groupBy("given", "made").agg(F.sum("share").alias("s")), name="shares")
    totals = sums.groupBy("given").agg(F.sum("s").alias("total"))
    return sums.join(totals, "given").select("given", "made", (F.col("s") / F.col("total")).alias("p"))


def _words(tokens: str) -> Column:
    """The words of a side that count."""
    return F.filter(F.coalesce(F.col(tokens), F.array().cast("array<string>")), lambda w: w.isNotNull() & (w != NONE))


def _dealt(sides: DataFrame) -> DataFrame:
    """(bucket, made, n, g): for each made word of each pair how often it counts and
    the pair's given words, repeats and the empty word included."""
    s = sides.select(F.concat(F.array(F.lit(NONE)), _words("g")).alias("g"), _words("m").alias("m"), "copies")
    cells = s.agg(F.sum(F.size("g").cast("bigint") * F.size(F.array_distinct("m")))).first()[0] or 0
    buckets = max(sides.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / CELLS))
    e = s.select("g", "m", "copies", F.explode(F.array_distinct("m")).alias("made"))
    n = F.col("copies") * F.size(F.filter("m", lambda w: w == F.col("made")))
    return e.select(F.pmod(F.xxhash64("made"), F.lit(buckets)).alias("bucket"), "made", n.cast("double").alias("n"), "g")


def _bucket_round(sums, final: bool):
    """A round in a bucket after those that ``sums`` are of: the shares of its
    given words, or (``final``) its probabilities."""
    def shared(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        made, flat = rows.column("made").combine_chunks().dictionary_encode(), pc.list_flatten(rows.column("g")).combine_chunks()
        given = flat.dictionary_encode()
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("g")).to_numpy())
        words = given.dictionary.to_numpy(zero_copy_only=False)
        cells, cell = np.unique(made.indices.to_numpy()[row].astype(np.int64) * len(words) + given.indices.to_numpy(), return_inverse=True)
        n, of = rows.column("n").to_numpy()[row], cells % len(words)

        def shares(p):
            w = p[cell]
            return np.bincount(cell, weights=n * w / np.bincount(row, weights=w)[row], minlength=len(cells))
        p = np.ones(len(cells))     # all words are as likely at first
        for sent in sums.value:
            p = shares(p) / JU._looked_up(words, sent)[of]
        if not final:
            return pa.table({"given": given.dictionary, "share": np.bincount(of, weights=shares(p), minlength=len(words))})
        return pa.table({"given": given.dictionary.take(pa.array(of)), "made": made.dictionary.take(pa.array(cells // len(words))), "p": p})
    shared.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    return shared


def _fit_in_buckets(sides: DataFrame, iterations: int) -> DataFrame | None:
    """The model from rounds in buckets; None if the given words are too many to be sent."""
    context = sides.sparkSession.sparkContext
    dealt, sums = _dealt(sides).groupBy("bucket"), []
    for _ in range(iterations):
        shares = dealt.applyInArrow(_bucket_round(context.broadcast(sums), False), "given string, share double")
        totals = cut_lineage(shares.groupBy("given").agg(F.sum("share").alias("w")), name="totals")
        if totals.count() > JU.SENT_WEIGHTS:
            return None
        sent = JU._sorted_weights(totals.select(F.col("given").alias("token"), "w").toArrow())
        if sent is None:
            return None
        sums = [*sums, sent]
    return dealt.applyInArrow(_bucket_round(context.broadcast(sums), True), "given string, made string, p double")


def fit_alignment(pairs: DataFrame, given: str, made: str, iterations: int = ITERATIONS) -> DataFrame:
    """(given, made, p) after some rounds of expectation maximisation.

    ``given`` and ``made`` name token arrays of any length. No pair is
    dropped: one without made words tells nothing, one without given words
    counts for the empty word. An empty table gives an empty model.
    """
    if iterations < 1:
        raise ValueError("at least one iteration")
    model = _fit_in_buckets(cut_lineage(_sides(pairs, given, made), name="sides"), iterations)
    if model is None:
        co = cut_lineage(cooccurrences(pairs, given, made), name="cooccurrences")
        for _ in range(iterations):
            model = _normalised(_shares(co, model))
    return cut_lineage(model, name="alignment")


def _best_given(rows: pa.Table, model: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For each row (made, g: its given words) the number of its likeliest given
    word and its probability by the model (given, made, p, r: p in nine digits);
    of as likely ones the smallest. The last result are the numbered words."""
    flat = pc.list_flatten(rows.column("g")).combine_chunks().dictionary_encode()
    order = pc.array_sort_indices(flat.dictionary)
    words, rank = flat.dictionary.take(order), np.argsort(order.to_numpy())
    made = pc.unique(rows.column("made"))
    of, given = (pc.index_in(model.column(c), v) for c, v in (("made", made), ("given", words)))
    known = pc.and_(pc.is_valid(of), pc.is_valid(given))
    model = model.append_column("cell", pc.add(pc.multiply(of.cast(pa.int64()), len(words)), given.cast(pa.int64()))).filter(known).sort_by("cell")
    cells, p, r = (np.append(model.column(c).to_numpy(), -1 if c == "cell" else 0.0) for c in ("cell", "p", "r"))
    sizes = pc.list_value_length(rows.column("g")).to_numpy().astype(np.int64)
    starts, of = np.cumsum(sizes) - sizes, pc.index_in(rows.column("made"), made).to_numpy().astype(np.int64)
    given, best, best_p = flat.indices.to_numpy(), np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows)
    at = 0
    while at < rows.num_rows:    # a bounded number of cells at a time
        end = max(at + 1, int(np.searchsorted(starts + sizes, starts[at] + CELLS, "right")))
        row = np.repeat(np.arange(at, end), sizes[at:end])
        word = rank[given[starts[at]:starts[end - 1] + sizes[end - 1]]]
        cell = of[row] * len(words) + word
        place = np.searchsorted(cells[:-1], cell)
        place = np.where(cells[place] == cell, place, len(cells) - 1)     # the last one for word pairs that the model lacks
        first = starts[at:end] - starts[at]
        most = r[place] == np.maximum.reduceat(r[place], first)[row - at]
        best[at:end] = np.minimum.reduceat(np.where(most, word, len(words)), first)
        found, where = np.unique(of[at:end] * len(words) + best[at:end], return_inverse=True)
        place = np.searchsorted(cells[:-1], found)
        best_p[at:end] = p[np.where(cells[place] == found, place, len(cells) - 1)][where]
        at = end
    return best, best_p, words


def _aligned_bucket(rows: pa.Table, model: pa.Table) -> pa.Table:
    rows, model = rows.combine_chunks(), model.combine_chunks()
    best, p, words = _best_given(rows, model)
    row = pc.list_parent_indices(rows.column("at")).combine_chunks()
    of = row.to_numpy()
    return pa.table({"_key": rows.column("_key").take(row), "pos": pc.list_flatten(rows.column("at")), "word": rows.column("made").take(row),
                     "source": words.take(pa.array(best[of])), "p": p[of]})


def aligned_words(pairs: DataFrame, model: DataFrame, given: str, made: str, key: str = "pair_id") -> DataFrame:
    """(key, pos, word, source, p): for every made word of every pair the given
    word that it most likely comes from, the empty word if none is as likely.
    Probabilities are compared to nine digits, ties go to the smaller word; a word pair that the model lacks has probability 0.

    The pairs' given words and the model are dealt out by made word, so a
    co-occurrence is a number within a task only; none is shuffled."""
    none = F.array(F.lit(NONE))
    g = F.array_distinct(F.concat(none, F.filter(F.coalesce(F.col(given), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    words = F.filter(F.array_distinct(made), lambda x: x.isNotNull())
    s = pairs.select(F.col(key).alias("_key"), g.alias("g"), F.col(made).alias("m"), words.alias("words"))
    cells = s.agg(F.sum(F.size("g").cast("bigint") * F.size("words"))).first()[0] or 0
    buckets = max(pairs.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / CELLS))
    places = F.filter(F.transform("m", lambda x, i: F.when(x == F.col("made"), i)), lambda i: i.isNotNull())
    bucket = F.pmod(F.xxhash64("made"), F.lit(buckets)).alias("bucket")
    e = s.select("_key", "g", "m", F.explode("words").alias("made")).select(bucket, "_key", "made", places.alias("at"), "g")
    known = model.select(bucket, "given", "made", "p", F.round("p", 9).alias("r"))
    kind = pairs.schema[key].dataType.simpleString()
    out = e.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        _aligned_bucket, f"_key {kind}, pos int, word string, source string, p double")
    return out.withColumnRenamed("_key", key)


def aligned_replacements(model: DataFrame, least: float = 0.0) -> DataFrame:
    """R6 from a model (given: a source word): the most likely word made from
    each source word, where it differs from it and has more than ``least``."""
    best = model.where(F.col("given") != NONE).groupBy("given").agg(
        F.min_by(F.struct("made", "p"), F.struct(-F.round("p", 9), F.col("made"))).alias("b"))
    return best.where((F.col("b.made") != F.col("given")) & (F.round("b.p", 9) > least)).select(
        F.col("given").alias("src"), F.col("b.made").alias("tgt"), F.col("b.p").alias("p"))
