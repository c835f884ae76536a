"""Operator 11, substring dedup: seeds by winnowing, extended both ways.

A window is ``WINDOW`` consecutive words of one text; a word goes if a window
that covers it occurs a second time anywhere. Of the runs of ``SEED`` words
inside a window the one with the least hash (of equal ones the last) is the
window's seed, so equal windows have equal seeds at equal places, and
neighbouring windows mostly share one: a text has about one seed for every 12
words. All that is repeated is found from seeds that occur twice.

A seed is extended both ways over all windows that chose it, to its extent: 35
to 58 words. Extents are compared within their seed. Where all are equal, all
their windows are repeated. Where they differ, those that occur twice are
repeated as a whole, and each different extent, once, puts up its windows:
those that occur in two extents are repeated as well. That keeps the longest
matches without a pair of occurrences ever being formed: a seed with a million
occurrences costs a row for each, and windows only for each different extent.
Neighbouring windows then join to maximal repeats.

Equal texts are one text from the start, with a number of copies; a text with
two copies is repeated as a whole. Extents are told apart by 64 bits of hash
within a seed of 64 other bits, windows and texts by 128 bits.

Edge cases: a null text has no words; a text of fewer than 35 words keeps them
all; rows that repeat a doc_id, or have none, count on their own by their text;
texts of any length are read whole, as a few million characters of Arrow data
at a time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRUNED, Settings, chunks, stored, words

WINDOW = 35
SEED = 12
CHOICES = WINDOW - SEED + 1
#: factors of the two hashes of word sequences, and the inverses modulo 2^64
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: characters of texts that are hashed at once (a longer text is taken as a whole)
PIECE = 2 << 20
NOTHING = hashlib.sha256(b"").digest()

SKETCH_SCHEMA = ("doc_id {}, d binary, n_words long, sha binary, h array<long>, e array<long>, a array<int>, m array<int>")
WINDOW_SCHEMA = "h long, e long, n long, bit long, w1 long, w2 long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over each other."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Hashes:
    """Hashes of any run of words of some texts, by sums of the words' hashes
    times powers of a factor. ``ends`` are the texts' word offsets."""

    def __init__(self, texts: pa.Array):
        from xxhash import xxh3_128_digest
        self.ends, codes, uniques = words(texts, lower=False)
        known = np.frombuffer(b"".join(map(xxh3_128_digest, uniques.cast(pa.large_binary()).to_pylist())), dtype=np.uint64).reshape(-1, 2)
        self.n = len(codes)
        self.sums, self.inverse = [], []
        for i, factor in enumerate(FACTORS):
            powers = np.full(self.n + 1, factor, dtype=np.uint64)
            powers[0] = 1
            inverse = np.full(self.n + 1, pow(factor, -1, 1 << 64), dtype=np.uint64)
            inverse[0] = 1
            powers, inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            if self.n:
                np.cumsum(known[codes, i] * powers[:-1], out=sums[1:])
            self.sums.append(sums)
            self.inverse.append(inverse)

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        """The hash of each run of words, alike for equal runs wherever they stand."""
        sums = self.sums[which]
        return _mixed((sums[ends] - sums[starts]) * self.inverse[which][starts])


def least_in_window(values: np.ndarray, width: int) -> np.ndarray:
    """Where each ``width`` neighbouring values have their least, the last of equal ones."""
    def better(x, y):
        return np.where(values[y] <= values[x], y, x)
    best, size = np.arange(len(values)), 1
    found, reach = None, 0
    while width:
        if width & size:
            if found is None:
                found = best
            else:
                n = max(0, min(len(found), len(best) - reach))
                found = better(found[:n], best[reach:reach + n])
            reach += size
            width -= size
        if width:
            best = better(best[:-size], best[size:]) if len(best) > size else best[:0]
            size *= 2
    return found


class Seeds:
    """The seeds of some texts in order: text number, first window ``a`` and
    number of windows ``m`` that chose the seed, the seed's hash ``h`` and the
    extent's ``e``. Windows are numbered over all texts."""

    def __init__(self, hashes: Hashes):
        n, ends = hashes.n, hashes.ends
        last = np.repeat(ends[1:], np.diff(ends))        # where each word's text ends
        starts = np.flatnonzero(np.arange(n) + WINDOW <= last)
        if not len(starts):
            self.text = self.a = self.m = np.zeros(0, dtype=np.int64)
            self.h = self.e = np.zeros(0, dtype=np.uint64)
            return
        at = np.arange(n - SEED + 1)
        values = hashes.of(at, at + SEED, 0)
        chosen = least_in_window(values, CHOICES)[starts]
        new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        self.a, self.m = starts[new], np.diff(np.append(new, len(starts)))
        place = chosen[new]
        self.text = np.searchsorted(ends, self.a, side="right") - 1
        self.h = values[place]
        shape = ((place - self.a) * WINDOW + self.m).astype(np.uint64)
        self.e = _mixed(hashes.of(self.a, self.a + self.m - 1 + WINDOW, 1) + _mixed(shape + np.uint64(1)))


def _joined(text: bytes) -> tuple[int, bytes]:
    split = text.split()          # blank and tab to carriage return, as ASCII white space of bytes
    return len(split), hashlib.sha256(b" ".join(split)).digest()


def _sketched(kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("d", pa.binary()), ("n_words", pa.int64()), ("sha", pa.binary()),
                        ("h", pa.list_(pa.int64())), ("e", pa.list_(pa.int64())), ("a", pa.list_(pa.int32())),
                        ("m", pa.list_(pa.int32()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", PIECE):
                texts = part.column("text")
                hashes = Hashes(texts)
                seeds = Seeds(hashes)
                counts, shas = zip(*(_joined(t.as_buffer().to_pybytes()) for t in texts.cast(pa.large_binary())))
                offsets = pa.array(np.searchsorted(seeds.text, np.arange(len(texts) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (
                    seeds.h.view(np.int64), seeds.e.view(np.int64),
                    (seeds.a - hashes.ends[seeds.text]).astype(np.int32), seeds.m.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d"), pa.array(counts, pa.int64()),
                                                  pa.array(shas, pa.binary()), *lists], schema=schema)
    return sketch


def _texts(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` (null as empty) and a 128-bit key ``d`` of the text."""
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("d"))


def sketches(documents: DataFrame) -> DataFrame:
    """Of each row its key, number of words, digest of all words, and seeds."""
    kind = documents.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    return _texts(documents).select("doc_id", "d", "text").mapInArrow(
        _sketched(to_arrow_type(kind)), SKETCH_SCHEMA.format(kind.simpleString()))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the extents that a text is asked for, a row each."""
    names = ["h", "e", "n", "bit", "w1", "w2"]
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            hashes = Hashes(part.column("text"))
            asked = part.column("extents")
            text = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            h, e, n, a, m = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("h", "e", "n", "a", "m"))
            of = np.repeat(np.arange(len(m)), m)
            j = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
            starts = hashes.ends[text[of]] + a[of] + j
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                h[of], e[of], n[of], np.int64(1) << j.astype(np.int64), hashes.of(starts, starts + WINDOW, 0).view(np.int64),
                hashes.of(starts, starts + WINDOW, 1).view(np.int64))], names)


def _asked(documents: DataFrame, extents: DataFrame, unique: DataFrame) -> DataFrame:
    """One row of each text with the extents that it stands for."""
    of = extents.groupBy("u").agg(F.collect_list(F.struct("h", "e", "n", "a", "m")).alias("extents"))
    wanted = stored(of.join(unique.select("u", F.col("d").alias("key"), F.col("doc_id").alias("holder")), "u"), "asked")
    with Settings(documents.sparkSession, PRUNED):
        held = _texts(documents).join(wanted.filter("key IS NOT NULL"), (F.col("d") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("holder")))
        return held.select("text", "extents")


def repeated_runs(documents: DataFrame, sketch: DataFrame) -> DataFrame:
    """``d`` of each text with a repeated window; ``whole`` if it has copies,
    else ``runs``: of windows from ``a`` on the bits of those that are repeated."""
    spark = documents.sparkSession
    unique = stored(sketch.filter(F.col("n_words") >= WINDOW).groupBy("d").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"),
        *[F.first(x).alias(x) for x in "heam"]).withColumn("u", F.monotonically_increasing_id()), "unique")
    seeds = unique.select("u", "copies", F.explode(F.arrays_zip("h", "e", "a", "m")).alias("s")).select("u", "copies", "s.*")
    shared = stored(seeds.groupBy("h").agg(F.sum("copies").alias("n"), F.min("e").alias("low"), F.max("e").alias("high"))
                    .filter("n > 1").select("h", (F.col("low") == F.col("high")).alias("alike")), "shared")
    with Settings(spark, PRUNED):
        # a text with copies needs no marks of its own, only its windows may be others' repeats
        rows = stored(seeds.join(shared.filter("h IS NOT NULL"), "h").filter("copies = 1 OR NOT alike"), "seeds")
    differ = rows.filter("NOT alike")
    extents = stored(differ.groupBy("h", "e").agg(F.sum("copies").alias("n"), F.min(F.struct("u", "a", "m")).alias("at"))
                     .select("h", "e", "n", "at.*"), "extents")
    windows = stored(_asked(documents, extents, unique).mapInArrow(_windows, WINDOW_SCHEMA), "windows")
    one = F.struct("h", "e")
    twice = windows.groupBy("w1", "w2").agg(F.min(one).alias("low"), F.max(one).alias("high"), F.max("n").alias("n")).filter(
        "n > 1 OR low <> high").select(F.col("w1").alias("x1"), F.col("w2").alias("x2"))
    found = windows.filter("n = 1").join(twice, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))).groupBy(
        "h", "e").agg(F.bit_or("bit").alias("bits"))
    every = F.lit(-1).cast("long").alias("bits")
    more = extents.filter("n > 1").select(F.col("h").alias("h2"), F.col("e").alias("e2"))
    runs = (rows.filter("alike").select("u", "a", "m", every)
            .unionByName(differ.filter("copies = 1").join(more, (F.col("h") == F.col("h2")) & (F.col("e") == F.col("e2")), "left_semi")
                         .select("u", "a", "m", every))
            .unionByName(extents.filter("n = 1").join(found, ["h", "e"]).select("u", "a", "m", "bits")))
    marked = runs.groupBy("u").agg(F.collect_list(F.struct("a", "m", "bits")).alias("runs"))
    none = F.array().cast("array<struct<a:int,m:int,bits:long>>")
    return stored(unique.filter("copies = 1").select("u", "d").join(marked, "u").select("d", F.lit(False).alias("whole"), "runs")
                  .unionByName(unique.filter("copies > 1").select("d", F.lit(True).alias("whole"), none.alias("runs"))), "runs")


def covered(ends: np.ndarray, text: np.ndarray, a: np.ndarray, m: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which words of some texts the given windows cover."""
    change = np.zeros(ends[-1] + 1, dtype=np.int64)
    start = ends[text] + a
    whole = bits == -1
    np.add.at(change, start[whole], 1)
    np.add.at(change, (start + m - 1 + WINDOW)[whole], -1)
    for j in range(CHOICES):
        some = start[~whole & ((bits >> j & 1) == 1)] + j
        np.add.at(change, some, 1)
        np.add.at(change, some + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts with repeated windows, and where their repeats are."""
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))
    for batch in batches:
        for part in chunks(batch, "text", PIECE):
            split = [t.as_buffer().to_pybytes().split() for t in part.column("text").cast(pa.large_binary())]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
            runs = part.column("runs")
            text = np.repeat(np.arange(len(split)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            gone = covered(ends, text, *(flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "m", "bits")))
            out = []
            for i, mine in enumerate(split):
                here = gone[ends[i]:ends[i + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], here.view(np.int8), [0]])))
                spans = [{"first": int(x), "n": int(y - x)} for x, y in zip(edges[::2], edges[1::2])]
                out.append((int(here.sum()), b" ".join(compress(mine, ~here)).decode("utf-8"), spans))
            n, kept, spans = zip(*out)
            yield pa.RecordBatch.from_arrays([part.column("d"), pa.array(n, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string()),
                                              pa.array(spans, spans_type)], ["d", "n_removed", "kept", "spans"])


def cleaned_texts(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """``d``, ``n_removed``, ``kept`` text and ``spans`` of the texts without copies that lose words."""
    marked = runs.filter("NOT whole").select(F.col("d").alias("key"), "runs")
    with Settings(documents.sparkSession, PRUNED):
        held = _texts(documents).join(marked.filter("key IS NOT NULL"), F.col("d") == F.col("key")).select("d", "text", "runs")
    return held.mapInArrow(_cleaned, "d binary, n_removed long, kept string, spans array<struct<first:long,n:long>>")


def _with(sketch: DataFrame, runs: DataFrame, cleaned: DataFrame, *columns: Column) -> DataFrame:
    """All rows of the sketch beside what their text loses: ``whole``, ``n_removed`` and others."""
    outcome = cleaned.select("d", F.lit(False).alias("whole"), "n_removed", *columns)
    copied = runs.filter("whole").select("d", "whole", *[F.lit(None).cast(t).alias(c) for c, t in outcome.dtypes[2:]])
    outcome = outcome.unionByName(copied).withColumnRenamed("d", "key")
    return sketch.select("doc_id", "d", "n_words", "sha").join(outcome, F.col("d") == F.col("key"), "left")


def substring_dedup(documents: DataFrame) -> DataFrame:
    """One row per document: n_words, n_removed and the SHA-256 of the words kept."""
    sketch = stored(sketches(documents), "sketches")
    runs = repeated_runs(documents, sketch)
    cleaned = stored(cleaned_texts(documents, runs).select("d", "n_removed", F.unhex(F.sha2("kept", 256)).alias("kept_sha")), "cleaned")
    rows = _with(sketch, runs, cleaned, F.col("kept_sha"))
    whole = F.coalesce("whole", F.lit(False))
    return rows.select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.lower(F.hex(F.when(whole, F.lit(NOTHING)).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"))


def maximal_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``first`` word and number of words ``n`` of each longest
    stretch of a document that repeated windows cover."""
    sketch = stored(sketches(documents), "sketches")
    runs = repeated_runs(documents, sketch)
    rows = _with(sketch, runs, stored(cleaned_texts(documents, runs), "cleaned"), F.col("spans"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("n")))
    return rows.select("doc_id", F.explode(F.when(F.col("whole"), all_of_it).otherwise(F.col("spans"))).alias("s")).select("doc_id", "s.*")


def deduplicated_texts(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` without its repeated stretches; a text that
    loses nothing stays as it is, white space included."""
    sketch = stored(sketches(documents), "sketches")
    runs = repeated_runs(documents, sketch)
    cleaned = stored(cleaned_texts(documents, runs).select(F.col("d").alias("key"), "kept"), "cleaned")
    whole = runs.filter("whole").select(F.col("d").alias("key"), F.lit("").alias("kept"))
    return _texts(documents).join(cleaned.unionByName(whole), F.col("d") == F.col("key"), "left").select(
        "doc_id", F.coalesce("kept", "text").alias("text"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT r, p, md5(array_to_string(words[p:p + 34], ' ')) AS h
  FROM (SELECT r, words, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35)),
twice AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, p FROM g WHERE h IN (SELECT h FROM twice)),
each AS (
  SELECT w.r, w.word, w.p, max(s.p) OVER (PARTITION BY w.r ORDER BY w.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w) w LEFT JOIN starts s ON s.r = w.r AND s.p = w.p),
kept AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS text FROM each GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""
