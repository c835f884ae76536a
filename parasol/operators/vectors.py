"""Token vectors, sentence embeddings and similarity.

A token's vector is row ``md5_int(token) % N`` of the ``embeddings`` table,
so occurrences look up the embeddings by ``vec_id`` directly, never the corpus
vocabulary. Rows are averaged in place, without a shuffle: a small table is
broadcast, a larger one goes to every executor once, as a file that its workers
map. Only tables beyond ``FILE_MAX_BYTES``, or with null vectors, are joined:
then sentence means are D ``sum`` aggregates per key (partial
aggregation, fixed-size state) instead of collecting vectors.
"""

from __future__ import annotations

import os
import tempfile
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parasol.functions.mathx import md5_int

BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# a larger table is a file on every executor's disk, which takes no memory of a worker
FILE_MAX_BYTES = 16 << 30
# vectors that are gathered at once
PIECE = 1 << 17


class _MappedMatrix:
    """A matrix in a file that Spark has sent to every executor; used like a
    broadcast variable, but mapped: workers share its pages."""

    def __init__(self, name: str):
        self.name = name

    @property
    def value(self) -> np.ndarray:
        if self.name not in _MAPPED:
            _MAPPED[self.name] = np.asarray(np.load(SparkFiles.get(self.name), mmap_mode="r"))
        return _MAPPED[self.name]


_MAPPED: dict[str, np.ndarray] = {}


def _mean_by_ids(matrix):
    """Mean rows of a matrix for lists of row numbers; null for an empty list.
    All lists of an Arrow batch are gathered at once, in pieces of a bounded size."""
    def mean(ids: pa.Array) -> pa.Array:
        vectors = matrix.value
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
        means = np.empty((len(some), vectors.shape[1]))
        at = 0
        while at < len(some):
            end = max(at + 1, int(np.searchsorted(ends[some], (ends[some[at - 1]] if at else 0) + PIECE)))
            first = ends[some[at]] - sizes[some[at]]
            starts = (ends - sizes)[some[at:end]] - first
            means[at:end] = np.add.reduceat(
                vectors[flat[first:ends[some[end - 1]]]], starts, axis=0, dtype=np.float64) / sizes[some[at:end], None]
            at = end
        offsets = np.concatenate([[0], np.cumsum(sizes > 0)]) * vectors.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(means.ravel()), mask=pa.array(sizes == 0))
    mean.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(mean, T.ArrayType(T.DoubleType()))


def row_numbers(words: pa.Array, n: int) -> np.ndarray:
    """``TokenVectors.vec_id`` of words, for ``n`` embeddings."""
    digests = b"".join([md5(w).digest() for w in words.cast(pa.binary()).to_pylist()])
    return np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % n


class TokenVectors:
    """The md5 token-to-row rule over an embeddings table."""

    def __init__(self, embeddings: DataFrame):
        ids = embeddings.agg(F.count("vec_id").alias("n"), F.countDistinct("vec_id").alias("d"),
                             F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"),
                             F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("dim"),
                             F.count_if(F.col("embedding").isNull() | F.exists("embedding", F.isnull)).alias("open")).first()
        self.n = ids["n"]
        if self.n and (ids["d"] != self.n or ids["lo"] != 0 or ids["hi"] != self.n - 1):
            raise ValueError("vec_id must number the embeddings from 0 without gaps")
        self.dim = ids["dim"] or 0     # an empty table: no token has a vector
        # a matrix has a row of numbers for each vector
        self.whole = ids["least"] == ids["dim"] and not ids["open"]
        tab = embeddings.select("vec_id", F.col("embedding").cast(f"array<double>").alias("vector"))
        # unit vectors are computed once per embeddings row, never per token occurrence
        normed = tab.withColumn("_norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))
        unit = normed.select("vec_id", F.transform("vector", lambda x: x / F.greatest(F.col("_norm"), F.lit(1e-8)))
                             .alias("vector"))
        # proven bound: n rows of dim doubles, checked here before any broadcast hint
        self.small = self.n * self.dim * 8 <= BROADCAST_MAX_BYTES
        self.table = F.broadcast(tab) if self.small else tab
        self.unit_table = F.broadcast(unit) if self.small else unit
        # as a file: no limit of memory, but one of disk and of what the driver hands out
        self.mapped = self.n * self.dim * 8 <= FILE_MAX_BYTES
        self._raw, self._unit, self._mean = embeddings.select("vec_id", F.col("embedding").alias("vector")), unit, None

    def unit_matrix(self):
        """The unit vectors by row number, for tables of a small size only."""
        if not self.small:
            raise ValueError("the table is too large to be sent to every task")
        return self._matrix(self._unit)

    def sent_units(self):
        """The unit vectors by row number, as a ``value`` that every task has in place."""
        return self._sent(self._unit)

    @property
    def in_place(self) -> bool:
        """Whether tasks can look vectors up without a join."""
        return self.whole and (self.small or self.mapped)

    def _matrix(self, table: DataFrame):
        rows = table.toArrow().sort_by("vec_id")
        return rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), self.dim)

    def _sent(self, table: DataFrame):
        """A matrix for every task: broadcast if it is small, else a file, whose
        rows come through the driver in pieces of the small size."""
        context = table.sparkSession.sparkContext
        if self.small:
            return context.broadcast(self._matrix(table))
        kind = np.float32 if table.schema["vector"].dataType.elementType == T.FloatType() else np.float64
        # Spark deletes this folder when the session ends
        path = os.path.join(tempfile.mkdtemp(dir=SparkFiles.getRootDirectory()), f"vectors-{os.urandom(6).hex()}.npy")
        file = np.lib.format.open_memmap(path, mode="w+", dtype=kind, shape=(self.n, self.dim))
        step = max(1, BROADCAST_MAX_BYTES // (self.dim * 8))
        for at in range(0, self.n, step):
            file[at:at + step] = self._matrix(table.where((F.col("vec_id") >= at) & (F.col("vec_id") < at + step)))
        file.flush()
        del file
        context.addFile(path)
        return _MappedMatrix(os.path.basename(path))

    def mean_column(self, tokens) -> F.Column:
        """Mean vector of a token array as a column, for tables that are looked up
        in place: the row turns its tokens into row numbers and averages; null
        for an empty array."""
        if not self.n:
            return F.lit(None).cast("array<double>")
        if self._mean is None:
            self._mean = _mean_by_ids(self._sent(self._raw))
        return self._mean(F.transform(tokens, self.vec_id))

    def vec_id(self, token) -> F.Column:
        return F.pmod(md5_int(token), F.lit(self.n)).cast("bigint") if self.n else F.lit(None).cast("bigint")

    def lookup(self, df: DataFrame, token_col: str = "token", unit: bool = False) -> DataFrame:
        """Attach ``vector`` (or its unit vector) to every row by its token."""
        tab = self.unit_table if unit else self.table
        return df.withColumn("vec_id", self.vec_id(F.col(token_col))).join(tab, "vec_id", "left") \
            .drop("vec_id")


class NamedVectors(TokenVectors):
    """A caller's (token, vector) table in place of the md5 rule; tokens it
    lacks have no vector."""

    def __init__(self, vectors: DataFrame, token_col: str = "token", vector_col: str = "vector"):
        tab = vectors.select(F.col(token_col).alias("_token"), F.col(vector_col).cast("array<double>").alias("vector"))
        first = tab.select(F.size("vector").alias("d")).first()
        self.dim = first["d"] if first else 0
        self.small = self.whole = False   # it grows with the vocabulary: AQE decides how it is joined
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        self.table = tab
        self.unit_table = tab.withColumn("_norm", norm).select("_token", F.transform(
            "vector", lambda x: x / F.greatest(F.col("_norm"), F.lit(1e-8))).alias("vector"))

    def lookup(self, df: DataFrame, token_col: str = "token", unit: bool = False) -> DataFrame:
        tab = self.unit_table if unit else self.table
        return df.join(tab, df[token_col] == tab["_token"], "left").drop("_token")


def mean_vector_finish(dim: int, prefix: str) -> F.Column:
    n = F.col(f"{prefix}n")
    if not dim:
        return F.lit(None).cast("array<double>")
    return F.when(n > 0, F.array(*[F.col(f"{prefix}{i}") / n for i in range(dim)]))


def sentence_embeddings(df: DataFrame, key: str, tokens_cols: dict, tv: TokenVectors) -> DataFrame:
    """Mean token vector per row and side (NULL for an empty side).

    In place where the table allows it. Otherwise one explode, one lookup join and one group-by for all sides: per side D
    conditional sums and a count.
    """
    if tv.in_place:
        return df.select(key, *[tv.mean_column(F.col(c)).alias(out) for out, c in tokens_cols.items()])
    parts = [F.struct(F.lit(out).alias("side"), F.col(c).alias("toks")) for out, c in tokens_cols.items()]
    e = df.select(key, F.explode(F.array(*parts)).alias("s")) \
        .select(key, "s.side", F.explode_outer("s.toks").alias("token"))
    v = tv.lookup(e)
    aggs = []
    for j, side in enumerate(tokens_cols):
        sv = F.when(F.col("side") == side, F.col("vector"))
        aggs += [F.sum(sv[i]).alias(f"_s{j}_{i}") for i in range(tv.dim)]
        aggs.append(F.count(sv).alias(f"_s{j}_n"))
    g = v.groupBy(key).agg(*aggs)
    return g.select(key, *[mean_vector_finish(tv.dim, f"_s{j}_").alias(side) for j, side in enumerate(tokens_cols)])
