"""Tokens with positions (T1): a text of any alphabet as spans that cover it.

A span is a run of letters with their marks (``word``), of digits
(``number``), of white space (``space``), or any other single code point
(``sign``). Every code point is in one span, so the spans' texts joined give
the text again, and a rewrite that changes some words leaves all else as it
was: case, digits, punctuation, white space, other alphabets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a span is.
_SPACE = r"\x09-\x0D\x20"
SPAN_PATTERN = rf"\p{{L}}[\p{{L}}\p{{M}}]*|\p{{N}}+|[{_SPACE}]+|[^\p{{L}}\p{{N}}{_SPACE}]"
WORD, NUMBER, SPACE, SIGN = "word", "number", "space", "sign"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pieces(text) -> Column:
    """The texts of all spans, in order; null for a null text."""
    return F.regexp_extract_all(_c(text), F.lit(SPAN_PATTERN), 0)


def joined(parts) -> Column:
    """Pieces as one text again."""
    return F.array_join(_c(parts), "")


def kind(piece) -> Column:
    """What a piece is, by its first code point."""
    piece = _c(piece)
    return F.when(piece.rlike(r"^\p{L}"), F.lit(WORD)).when(piece.rlike(r"^\p{N}"), F.lit(NUMBER)) \
        .when(piece.rlike(rf"^[{_SPACE}]"), F.lit(SPACE)).otherwise(F.lit(SIGN))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts(lengths: pa.Array) -> pa.Array:
    """Running sums of each row's lengths, all rows of a batch at once."""
    offsets = lengths.offsets.to_numpy().astype(np.int64)
    values = lengths.values.to_numpy(zero_copy_only=False)[:offsets[-1]].astype(np.int64)
    before = np.concatenate([[0], np.cumsum(values)])
    starts = (before[:-1] - np.repeat(before[offsets[:-1]], np.diff(offsets)))[offsets[0]:] if len(values) else values
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(starts.astype(np.int32)),
                                    mask=lengths.is_null() if lengths.null_count else None)


def spans(parts) -> Column:
    """(start, end, kind, text) of every piece; places count code points from
    0, the end is behind the span."""
    parts = _c(parts)
    lengths = F.transform(parts, lambda p: F.char_length(p))
    return F.transform(F.arrays_zip(parts.alias("text"), _starts(lengths).alias("start")), lambda z: F.struct(
        z["start"].alias("start"), (z["start"] + F.char_length(z["text"])).alias("end"), kind(z["text"]).alias("kind"),
        z["text"].alias("text")))


def words(parts) -> Column:
    """The distinct words among the pieces, in lower case."""
    return F.array_distinct(F.transform(F.filter(_c(parts), lambda p: p.rlike(r"^\p{L}")), lambda p: F.lower(p)))


def in_case_of(target, piece) -> Column:
    """``target`` in capitals where ``piece`` is, or with a capital first letter."""
    target, piece = _c(target), _c(piece)
    first = F.substring(piece, 1, 1)
    capitals = (piece == F.upper(piece)) & (piece != F.lower(piece)) & (F.char_length(piece) > 1)
    return F.when(capitals, F.upper(target)).when(
        first != F.lower(first), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30))).otherwise(target)
