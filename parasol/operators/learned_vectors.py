"""Token vectors learned from a corpus (R3): co-occurrence counts, positive
mutual information, and a randomised factorisation by blocked products.

The table of mutual information is a sparse symmetric matrix with a row for
each two words that occur near each other. Its best low-rank form is found
without ever holding it: a tall matrix of a few columns, a row for each word,
is multiplied by it again and again (a join and a sum of a fixed number of
columns per word) and made orthonormal each time by the small matrix of its
columns' products. Only that small matrix reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parasol.session import cut_lineage

WINDOW = 2
DIMENSIONS = 16
EXTRA = 8
ROUNDS = 3


def cooccurrences(seqs: DataFrame, tokens_col: str = "tokens", window: int = WINDOW) -> DataFrame:
    """(a, b, n): how often two words stand at most ``window`` places apart, in
    both directions. Null words take a place but don't count. Row-local up to the count."""
    t, n = F.col(tokens_col), F.size(tokens_col)
    near = [F.when(n > d, F.arrays_zip(F.slice(t, 1, n - d).alias("a"), F.slice(t, 1 + d, n - d).alias("b")))
            .otherwise(F.array().cast("array<struct<a:string,b:string>>")) for d in range(1, window + 1)]
    pairs = seqs.where(t.isNotNull()).select(F.explode(F.concat(*near)).alias("z")).select("z.a", "z.b").where(
        F.col("a").isNotNull() & F.col("b").isNotNull())
    once = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("a", "b").agg(F.sum("n").alias("n"))


def positive_pmi(counts: DataFrame) -> DataFrame:
    """(a, b, n, x): ln(n N / (n_a n_b)) where it is above zero."""
    counts = cut_lineage(counts, name="near")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sums = counts.groupBy("a").agg(F.sum("n").alias("s"))
    j = counts.join(sums.withColumnRenamed("s", "s_a"), "a").join(sums.select(F.col("a").alias("b"), F.col("s").alias("s_b")), "b")
    x = F.ln(F.col("n").cast("double") * F.lit(float(total)) / (F.col("s_a").cast("double") * F.col("s_b").cast("double")))
    return j.withColumn("x", x).where(F.round("x", 12) > 0).select("a", "b", "n", "x")


def _noise(columns: int, seed: int):
    def fill(batches):
        for batch in batches:
            rows = [np.random.default_rng((seed, h & 0xFFFFFFFFFFFFFFFF)).standard_normal(columns) for h in batch.column("h").to_pylist()]
            flat = np.concatenate(rows) if rows else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * columns), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("token"), lists], ["token", "v"])
    return fill


def _table(rows: pa.Array, columns: int) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)


def _products(columns: int, others: str | None = None):
    """The matrix of products of the columns, added up in each task."""
    def add(batches):
        total = np.zeros((columns, columns))
        for batch in batches:
            left = _table(batch.column("v"), columns)
            total += left.T @ (_table(batch.column(others), columns) if others else left)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["g"])
    return add


def _gram(df: DataFrame, columns: int, others: str | None = None) -> np.ndarray:
    parts = df.select("v", *([others] if others else [])).mapInArrow(_products(columns, others), "g array<double>")
    sums = parts.select(F.posexplode("g").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()   # columns squared numbers
    out = np.zeros(columns * columns)
    for r in sums:
        out[r["i"]] = r["x"]
    return out.reshape(columns, columns)


def _times(df: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Every row's vector times a small matrix."""
    columns = matrix.shape[0]

    def run(batches):
        for batch in batches:
            made = _table(batch.column("v"), columns) @ matrix
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(made.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("token"), lists], ["token", "v"])
    return df.select("token", "v").mapInArrow(run, "token string, v array<double>")


def _multiplied(pmi: DataFrame, tall: DataFrame, columns: int) -> DataFrame:
    """The sparse matrix times the tall one: a join and a fixed number of sums per word."""
    j = pmi.select("a", "b", "x").join(tall.withColumnRenamed("token", "b"), "b")
    return j.groupBy(F.col("a").alias("token")).agg(*[F.sum(F.col("x") * F.col("v")[i]).alias(f"s{i}") for i in range(columns)]).select(
        "token", F.array(*[F.col(f"s{i}") for i in range(columns)]).alias("v"))


def _orthonormal(tall: DataFrame, columns: int) -> DataFrame:
    values, vectors = np.linalg.eigh(_gram(tall, columns))
    good = values > max(values.max(initial=0), 1e-300) * 1e-12      # a rank below the number of columns leaves zeros
    scale = np.where(good, 1 / np.sqrt(np.where(good, values, 1)), 0)
    return cut_lineage(_times(tall, vectors * scale), name="basis")


def factorise(pmi: DataFrame, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """(token, vector) and the largest values of the symmetric matrix in falling
    size. A token's vector is its row of the leading eigenvectors, each times the
    root of its value's size. Without any row: an empty table and no values."""
    columns = dimensions + EXTRA
    pmi = cut_lineage(pmi.select("a", "b", "x"), name="pmi")
    words = pmi.select(F.col("a").alias("token")).distinct()
    tall = cut_lineage(words.select("token", F.xxhash64("token").alias("h")).mapInArrow(_noise(columns, seed), "token string, v array<double>"), name="noise")
    for _ in range(rounds + 1):
        tall = _orthonormal(cut_lineage(_multiplied(pmi, tall, columns), name="product"), columns)
    both = tall.join(_multiplied(pmi, tall, columns).withColumnRenamed("v", "mv"), "token")
    small = _gram(both, columns, "mv")
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dimensions]
    made = _times(tall, vectors[:, order] * np.sqrt(np.abs(values[order])))
    return cut_lineage(made, name="vectors").withColumnRenamed("v", "vector"), values[order]


def learn_vectors(seqs: DataFrame, tokens_col: str = "tokens", dimensions: int = DIMENSIONS, window: int = WINDOW) -> DataFrame:
    """(token, vector) of a corpus, for ``vectors.NamedVectors``."""
    return factorise(positive_pmi(cooccurrences(seqs, tokens_col, window)), dimensions)[0]
