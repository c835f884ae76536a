"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parasol.session import checkpoint_root

#: the white space of the contracts: blank and tab to carriage return
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Settings:
    """Session settings that hold while a table is written."""

    def __init__(self, spark: SparkSession, settings: dict[str, str]):
        self.spark, self.settings = spark, settings

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.settings}
        for k, v in self.settings.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


#: for a join of few keys with a large scan: prune the scan by a bloom filter of the keys
PRUNED = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
          "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
          "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g"}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder once and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A table of a counted size for a join: broadcast up to ``most`` rows,
    beyond them left to a shuffled join (with skewed keys split)."""
    return F.broadcast(df) if rows <= most else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator is about to add."""
    return df.drop(*names)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Split an Arrow column of texts on ASCII white space.

    Returns per-text offsets into ``codes``, the codes of all words in order,
    and the distinct words that the codes number. Null and blank texts have
    no words. A-Z are lower-cased unless ``lower`` is false.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # taken, not sliced: ascii_lower misreads the offsets of a slice
    texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))
    if lower:
        texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    ends = split.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    uniques = coded.dictionary
    blank = pc.index(uniques, pa.scalar("", uniques.type)).as_py() if len(uniques) else -1
    if blank >= 0:
        keep = codes != blank
        kept = np.concatenate([[0], np.cumsum(keep)])
        ends = kept[ends]
        codes = codes[keep]
        codes -= codes > blank
        uniques = pa.concat_arrays([uniques[:blank], uniques[blank + 1:]])
    return ends, codes, uniques


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` per segment; empty segments give zero."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def chunks(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Row ranges of a batch with about ``limit`` characters each; a longer
    text is a range of its own. Every row is in one range."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
