"""Text and array column functions.

All of these are built-in expressions, so they stay inside whole-stage codegen
and work the same in batch and streaming plans.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and sentence patterns, special ids.
TOKEN_PATTERN = "[a-zß-ÿ]+"
SENTENCE_SPLIT = "[.!?\n]+\\s*"
START_ID = 0
END_ID = 1          # the end token doubles as the pad token
PAD_ID = END_ID
UNK_ID = 2
FIRST_WORD_ID = 3
SPECIAL_IDS = (START_ID, END_ID, UNK_ID)
MAX_LENGTH = 38


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(text) -> Column:
    """All runs of letters in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def split_sentences(text) -> Column:
    """Sentence pieces of a text, empty pieces kept so positions are stable."""
    return F.split(_c(text), SENTENCE_SPLIT, -1)


def pad(ids, max_length: int = MAX_LENGTH, pad_id: int = PAD_ID) -> Column:
    """T4: right-pad an id array to ``max_length`` (longer arrays are left as is)."""
    ids = _c(ids)
    return F.concat(ids, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(max_length) - F.size(ids), F.lit(0))))


def attention_mask(ids, pad_id: int = PAD_ID, end_id: int = END_ID, distinct_pad: bool = False) -> Column:
    """1 where the id is not the pad id.

    The pad id is the end id, so the true end token is masked too; with
    ``distinct_pad=True`` only the trailing pad run after the first end token is
    masked.
    """
    ids = _c(ids)
    if not distinct_pad:
        return F.transform(ids, lambda t: F.when(t != pad_id, 1).otherwise(0))
    first_end = F.array_position(ids, end_id)
    return F.transform(ids, lambda t, i: F.when((first_end == 0) | (i < first_end), 1).otherwise(0))


def strip_special(ids, special=SPECIAL_IDS) -> Column:
    """Drop special ids (decode with skip_special_tokens)."""
    arr = F.array(*[F.lit(s) for s in special])
    return F.filter(_c(ids), lambda t: ~F.array_contains(arr, t))


def char_ngrams(text, n: int) -> Column:
    """Character n-grams (spaces included), empty when shorter than n."""
    text = _c(text)
    return F.when(F.length(text) >= n,
                  F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                              lambda i: F.substring(text, i, n))
                  ).otherwise(F.array().cast("array<string>"))


def word_ngrams(tokens, n: int) -> Column:
    """Word n-grams of a token array, joined by one blank."""
    tokens = _c(tokens)
    return F.when(F.size(tokens) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1),
                              lambda i: F.array_join(F.slice(tokens, i, n), " "))
                  ).otherwise(F.array().cast("array<string>"))


def ids_text(ids) -> Column:
    """Canonical text form of an id array, for comparisons and sinks."""
    return F.array_join(F.transform(_c(ids), lambda t: t.cast("string")), ",")
