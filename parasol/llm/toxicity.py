"""Operator 2, toxicity by a factorization machine over hashed terms.

A text's score is the logistic of a bias, a weight for each distinct term, and
for each pair of terms the product of their factor vectors: what neither an
insult nor the mention of a group says alone, their pair can. Terms are
lower-cased, stripped of what is neither letter nor digit at either end, and
hashed into ``BUCKETS`` rows, so the model has a fixed size and is sent to
every task. Pair sums are taken by the identity
``sum_{i<j} <v_i, v_j> = (|sum v|^2 - sum |v|^2) / 2``, linear in the terms.

The model is fitted on a bounded sample of labelled rows, at most
``SAMPLE_ROWS``, chosen by a hash of the id, with a gradient step per
mini-batch. Weights have an L1 penalty by which terms that tell nothing stay
at zero; factors are learned for terms with a weight and for common terms.
Terms in fewer than ``LEAST_ROWS`` sampled rows are left out. Every row is scored over its whole text.

Edge cases: null, empty and blank texts get the score of the bias alone;
without labelled rows all scores are 0.5; labels that are null are left out,
and a doc_id with several labels teaches them all; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, segment_sum, words

BUCKETS = 1 << 18
FACTORS = 6
SAMPLE_ROWS = 12_000
LEAST_ROWS = 3
#: share of the sampled rows that a common term is in
COMMON = 0.05
EPOCHS = 10
BATCH = 64
RATE = 1.0
RATE_FACTORS = 0.02
L1 = 16.0
L2 = 0.1
THRESHOLD = 0.3
CACHE = 400_000


def term_bucket(token: str) -> int:
    """The row of a token's term; -1 if it has no letter or digit."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return zlib.crc32(token[i:j].lower().encode()) % BUCKETS if i < j else -1


def term_sets(texts: pa.Array, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets per text into its distinct term rows, sorted."""
    ends, codes, uniques = words(texts)
    if len(cache) > CACHE:
        cache.clear()
    rows = np.empty(len(uniques), dtype=np.int64)
    for i, t in enumerate(uniques.to_pylist()):
        row = cache.get(t)
        if row is None:
            row = term_bucket(t)
            if len(t) < 24:
                cache[t] = row
        rows[i] = row
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    term = rows[codes]
    pair = np.unique(doc[term >= 0] * BUCKETS + term[term >= 0])
    return np.searchsorted(pair // BUCKETS, np.arange(len(ends))), pair % BUCKETS


class Machine:
    """Bias, weights and factors; rows of terms that tell nothing are zero."""

    def __init__(self, bias: float = 0.0, weights: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.bias = bias
        self.weights = np.zeros(BUCKETS, np.float32) if weights is None else weights
        self.factors = np.zeros((BUCKETS, FACTORS), np.float32) if factors is None else factors

    def logits(self, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
        used = (self.weights[terms] != 0) | self.factors[terms].any(1)
        offsets = np.concatenate([[0], np.cumsum(used)])[offsets]
        terms = terms[used]
        v = self.factors[terms]
        sums = segment_sum(v, offsets)
        return (self.bias + segment_sum(self.weights[terms], offsets)
                + (np.square(sums).sum(1) - segment_sum(np.square(v).sum(1), offsets)) / 2)

    def fit(self, offsets: np.ndarray, terms: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
        n = len(labels)
        if n == 0:
            return self
        rng = np.random.default_rng(seed)
        rows = np.bincount(terms, minlength=BUCKETS)
        often = rows[terms] >= LEAST_ROWS
        offsets = np.concatenate([[0], np.cumsum(often)])[offsets]
        terms = terms[often]
        ids, at = np.unique(terms, return_inverse=True)
        w, z, nw = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids))
        v = rng.normal(0, 0.02, (len(ids), FACTORS))
        nv = np.full(v.shape, 1.0)
        rate = (labels.sum() + 1) / (n + 2)
        bias, nb = float(np.log(rate / (1 - rate))), 1.0
        sizes = np.diff(offsets)
        # terms whose pairs are learned even while their own weight tells nothing
        common = np.bincount(at, minlength=len(ids)) >= COMMON * n
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                rows_ = order[i:i + BATCH]
                of = np.repeat(np.arange(len(rows_)), sizes[rows_])
                x = at[np.concatenate([np.arange(offsets[r], offsets[r + 1]) for r in rows_])]
                ends = np.concatenate([[0], np.cumsum(sizes[rows_])])
                active = common[x] | (np.abs(w[x]) > 0)
                vx = v[x] * active[:, None]
                sums = segment_sum(vx, ends)
                out = bias + segment_sum(w[x], ends) + (np.square(sums).sum(1) - segment_sum(
                    np.square(vx).sum(1), ends)) / 2
                miss = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows_]
                # weights: follow the regularised leader, which keeps idle terms at zero
                u, inv = np.unique(x, return_inverse=True)
                g = np.bincount(inv, weights=miss[of], minlength=len(u))
                turn = (np.sqrt(nw[u] + g * g) - np.sqrt(nw[u])) / RATE
                z[u] += g - turn * w[u]
                nw[u] += g * g
                w[u] = -np.sign(z[u]) * np.maximum(np.abs(z[u]) - L1, 0) / ((1 + np.sqrt(nw[u])) / RATE + L2)
                # factors: of common terms and of those with a weight
                if active.any():
                    xa, oa, va = x[active], of[active], vx[active]
                    u, inv = np.unique(xa, return_inverse=True)
                    pull = miss[oa][:, None] * (sums[oa] - va)
                    h = np.stack([np.bincount(inv, weights=pull[:, k], minlength=len(u)) for k in range(FACTORS)], 1)
                    h += L2 * v[u]
                    nv[u] += h * h
                    v[u] -= RATE_FACTORS * h / np.sqrt(nv[u])
                g0 = float(miss.sum())
                nb += g0 * g0
                bias -= RATE * g0 / nb ** 0.5
        self.bias = bias
        told = common | (np.abs(w) > 0)
        self.weights[ids[told]] = w[told]
        self.factors[ids[told]] = v[told]
        return self


def fit(documents: DataFrame, labels: DataFrame, training: Column, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learn ``labels.toxic`` from the labelled rows where ``training`` holds."""
    known = labels.filter(training & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n = known.count()
    pick = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    # limit() makes the bound a hard one, so the sample's ids may be sent to every task
    chosen = known.filter(pick * n < 0.95 * sample_rows).limit(sample_rows) if n > sample_rows else known
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                offsets, terms = term_sets(part.column("text"), cache)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic").cast(pa.int32()),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(terms, pa.int32()))],
                    names=["doc_id", "toxic", "terms"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(encode, f"doc_id {kind}, toxic int, terms array<int>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    if got.num_rows == 0:
        return Machine()
    lists = pa.concat_arrays(got.column("terms").chunks)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return Machine().fit(offsets - offsets[0], lists.flatten().to_numpy().astype(np.int64),
                         got.column("toxic").to_numpy().astype(np.float64))


def score(documents: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, for every row."""
    sent = documents.sparkSession.sparkContext.broadcast(machine)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                z = sent.value.logits(*term_sets(part.column("text"), cache))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))],
                    names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, score double")


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a machine of three folds in four."""
    held_out = fold(F.col("doc_id"), 4) == 2
    scored = score(documents, fit(documents, labels, ~held_out)).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
