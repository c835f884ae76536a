"""Operator 10, token counts: an exact histogram of encoded lengths.

Every text is encoded whole by a byte-level BPE; documents are aggregated by
their number of tokens. Sums over the lengths from each one on, and over those
before it, answer for every context limit how many tokens there are in all,
how many remain when texts are truncated to the limit, and where the
quantiles lie, without another look at the texts.

The histogram's size is the number of different lengths. Its running sums are
taken within ranges of lengths and over the ranges' totals.

Edge cases: null and empty texts have length 0 and are counted; special
tokens' names in a text are ordinary text; repeated rows count each; an empty
table gives an empty histogram, whose totals are 0 and whose quantiles are
null; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the pattern that this vocabulary's texts are split by
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: lengths in a range of running sums
RANGE = 1024


@lru_cache(2)
def encoding(vocabulary: str):
    import tiktoken
    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``length`` in tokens for every row. ``vocabulary`` is a
    file of ranks that every worker has under this path."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            for part in chunks(batch, "text"):
                sizes = [len(encode(t)) if (t := x.as_py()) else 0 for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(sizes, np.int64))],
                                                 names=["doc_id", "length"])

    return documents.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """A row per length: ``docs`` and ``tokens`` of it, ``docs_from`` and
    ``tokens_from`` of it and longer ones, ``docs_to`` and ``tokens_to`` of it
    and shorter ones, and ``truncated_tokens``, the total when every text is
    cut to that length."""
    counts = stored(lengths.groupBy("length").agg(F.count("*").alias("docs"))
                    .withColumn("tokens", F.col("length") * F.col("docs"))
                    .withColumn("_range", F.floor(F.col("length") / RANGE)), "lengths")
    up_to = Window.partitionBy("_range").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.groupBy("_range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # one row for each range of lengths: a longest text of a billion tokens has a million
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_range", *[f(x).alias(x + y) for x in "dt" for y, f in (
        ("_before", lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))), ("_all", lambda x: F.sum(x).over(every)))])
    out = (counts.withColumn("_d", F.sum("docs").over(up_to)).withColumn("_t", F.sum("tokens").over(up_to))
           .join(ranges, "_range")
           .withColumn("docs_to", F.col("_d") + F.col("d_before"))
           .withColumn("tokens_to", F.col("_t") + F.col("t_before"))
           .withColumn("docs_from", F.col("d_all") - F.col("docs_to") + F.col("docs"))
           .withColumn("tokens_from", F.col("t_all") - F.col("tokens_to") + F.col("tokens")))
    return out.select("length", "docs", "tokens", "docs_from", "tokens_from", "docs_to", "tokens_to", (
        F.col("tokens_to") + F.col("length") * (F.col("docs_from") - F.col("docs"))).alias("truncated_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens when every text is cut to ``limit``, whichever limit."""
    row = histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("docs")).alias("n")).first()
    return row["n"] or 0


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that at least ``share`` of the documents don't exceed."""
    return histogram.filter(_reaches(share)).agg(F.min("length").alias("n")).first()["n"]


def _reaches(share: float) -> Column:
    return F.col("docs_to") >= share * (F.col("docs_to") + F.col("docs_from") - F.col("docs"))
