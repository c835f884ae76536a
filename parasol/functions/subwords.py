"""Sub-word ids of a public vocabulary.

The vocabulary is a file of the ``tokenizers`` library that every worker can
read; its path is a parameter. It is loaded once per worker and applied to
Arrow batches of texts. Nothing is trained here. A byte-level vocabulary gives
every text back from its ids, whatever its alphabet.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: bytes of texts that are encoded, or ids that are decoded, at once
PIECE = 1 << 18


def _loaded(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark deals out the work
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True              # their strings in a text are ordinary text
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _pieces(rows: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """Slices of about ``PIECE`` bytes or ids; a longer row is one alone."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > start and held + n > PIECE:
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(rows):
        yield rows.slice(start)


def _lists(values: list[np.ndarray], null: np.ndarray) -> pa.Array:
    """Lists of ids, null where ``null``; ``values`` has the others."""
    sizes = np.zeros(len(null), dtype=np.int32)
    sizes[~null] = [len(v) for v in values]
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat), mask=pa.array(null))


def encode_text(path: str = VOCABULARY):
    """A column function: text -> array of ids, the whole text; null for null."""
    def encode(batches):
        tokenizer = _loaded(path)
        for texts in batches:
            out = [pa.array([], pa.list_(pa.int32()))]
            for part in _pieces(texts, pc.binary_length(texts)):
                # only ids are kept, as numbers of four bytes, before the next piece is encoded
                made = tokenizer.encode_batch_fast(part.drop_null().to_pylist(), add_special_tokens=False)
                out.append(_lists([np.array(e.ids, dtype=np.int32) for e in made], part.is_null().to_numpy(zero_copy_only=False)))
            yield pa.concat_arrays(out)
    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))


def decode_ids(path: str = VOCABULARY):
    """A column function: array of ids -> text; null for null, empty for an empty array."""
    def decode(batches):
        tokenizer = _loaded(path)
        for ids in batches:
            out = [pa.array([], pa.string())]
            for part in _pieces(ids, pc.list_value_length(ids)):
                texts = iter(tokenizer.decode_batch(part.drop_null().to_pylist(), skip_special_tokens=False))
                out.append(pa.array([next(texts) if x else None for x in part.is_valid().to_pylist()], pa.string()))
            yield pa.concat_arrays(out)
    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, T.StringType())
