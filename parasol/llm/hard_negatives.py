"""Operator 12, hard-negative mining by Kronecker-packed products.

Vectors become integers, ``floor(256 x)`` for each component. Tasks cut the
table into blocks of vectors where they read it; the anchors form blocks of
their own, and each block of anchors meets each block of candidates once. In
such a pair the candidates' components are raised by a bias so that none is
negative, and several candidates' components are put into separated fields of
one wide integer (64 bits; beyond that Python's unbounded ones). One product
of the wide integer with an anchor's component, summed over the components,
holds the scores of all its candidates at once: the fields are so wide that
none reaches the next. What the biases added is taken off after unpacking, so
scores are exact.

Two rounds, because the negatives asked for depend on the positives' scores.
The first multiplies only rows of equal labels and keeps each anchor's best in
each block, then overall; the second multiplies rows of different labels and
keeps, for each positive, the best whose scores lie in the positive's range.
Each block contributes a bounded number of rows for an anchor, so that nothing
grows with a label's or a vector's frequency.

Edge cases: rows with a null vec_id or label, a null vector, or a null or
non-finite component take no part; of rows that repeat a vec_id the least by
label, then by components, takes part; vectors of different lengths are
compared as if the shorter one ended in zeros, and an empty one scores zero
with all; ties go to the smaller vec_id; an anchor without another row of its
label, or a positive whose score is negative, has no rows; an empty table gives
an empty result; other columns are not read. A component of 2^63 or more after
scaling, or a score that a long can't hold, ends the job with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Settings, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
#: rows of a block of candidates and of a block of anchors
CANDIDATES, ANCHORS = 4096, 2048
#: anchors multiplied at once
SLICE = 256
#: bytes of anchor blocks that are sent to every task; beyond, they are dealt out by a shuffle
SENT_BYTES = 32 << 20
#: fields of an unbounded integer, where 64 bits hold no field
WIDE_FIELDS = 16

BLOCK_SCHEMA = ("block long, vec_ids binary, labels binary, dim int, components binary, "
                "wanted binary, wanted_ids binary, wanted_scores binary")
BEST_SCHEMA = "anchor_id long, vec_id long, score long"
FOUND = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
#: pairs of blocks that are sent to Python at once
SENT_PAIRS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}


def relabelled(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``label`` and ``embedding`` of the rows that take part; the
    labels of every seventh id are moved on by one."""
    label = F.col("label").cast("long")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                             & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"))


def one_row_each(vectors: DataFrame) -> DataFrame:
    """The vectors, of those that share a vec_id the least one."""
    repeated = stored(vectors.groupBy("vec_id").count().filter("count > 1").select(F.col("vec_id").alias("repeated")), "repeated")
    if not repeated.limit(1).count():
        return vectors
    same = F.col("vec_id") == F.col("repeated")
    least = vectors.join(repeated, same, "left_semi").groupBy("vec_id").agg(
        F.min(F.struct("label", "embedding")).alias("row")).select("vec_id", "row.label", "row.embedding")
    return vectors.join(repeated, same, "left_anti").unionByName(least)


def _integers(values: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * values)
    if len(scaled) and np.abs(scaled).max() >= 2.0 ** 63:
        raise OverflowError("a scaled component does not fit into 64 bits")
    return scaled.astype(np.int64)


def _block(batch: pa.RecordBatch, number: int) -> dict:
    """A batch of vectors as one row: labels in order, components as small as
    they can be, and of each vector how many positives it has, and which."""
    batch = batch.take(pa.array(np.argsort(batch.column("label").to_numpy(zero_copy_only=False), kind="stable")))
    vectors, wanted = batch.column("embedding"), batch.column("wanted")
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    table[np.arange(table.shape[1]) < lengths[:, None]] = _integers(vectors.flatten().to_numpy(zero_copy_only=False))
    kind = next(k for k in (np.int16, np.int32, np.int64)
                if np.iinfo(k).min <= table.min(initial=0) and table.max(initial=0) <= np.iinfo(k).max)

    def raw(column):
        return column.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
    return {"block": number, "vec_ids": raw(batch.column("vec_id")), "labels": raw(batch.column("label")),
            "dim": table.shape[1], "components": table.astype(kind).tobytes(),
            "wanted": raw(pc.list_value_length(wanted)), "wanted_ids": raw(wanted.flatten().field("vec_id")),
            "wanted_scores": raw(wanted.flatten().field("score"))}


def _cut(rows: int):
    """Each task's rows as blocks of at most ``rows`` vectors."""
    def cut(batches):
        from pyspark import TaskContext
        number, waiting, held = TaskContext.get().partitionId() << 33, [], 0
        schema = pa.schema([("block", pa.int64()), ("vec_ids", pa.binary()), ("labels", pa.binary()), ("dim", pa.int32()),
                            ("components", pa.binary()), ("wanted", pa.binary()), ("wanted_ids", pa.binary()),
                            ("wanted_scores", pa.binary())])

        def made():
            whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pylist([_block(whole, number)], schema)
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - held)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                held += part.num_rows
                if held == rows:
                    yield made()
                    number, waiting, held = number + 1, [], 0
        if held:
            yield made()
    return cut


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of about ``rows`` vectors, cut where the vectors are read."""
    if "wanted" not in vectors.columns:
        vectors = vectors.withColumn("wanted", F.array().cast("array<struct<vec_id:long,score:long>>"))
    tasks = max(1, -(-vectors.count() // rows))
    return vectors.select("vec_id", "label", "embedding", "wanted").coalesce(tasks).mapInArrow(_cut(rows), BLOCK_SCHEMA)


def _met(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Each block of anchors beside each block of candidates, once."""
    size = anchors.agg(F.coalesce(F.sum(sum((F.octet_length(n) for n, kind in anchors.dtypes if kind == "binary"), F.lit(0))),
                                  F.lit(0))).first()[0]
    n_candidates, n_anchors = candidates.count(), anchors.count()
    tasks = max(1, min(n_candidates, max(2 * candidates.sparkSession.sparkContext.defaultParallelism,
                                         n_candidates * n_anchors // 8)))
    c, a = (df.select(*[F.col(x).alias(f"{side}_{x}") for x in df.columns]) for side, df in (("c", candidates), ("a", anchors)))
    if size <= SENT_BYTES:
        numbers = sorted(r[0] for r in anchors.select("block").collect())  # a block has some hundred bytes at least
        every = c.repartitionByRange(tasks, "c_block").withColumn("to", F.explode(
            F.array(*[F.lit(x) for x in numbers]).cast("array<bigint>")))
        return every.join(F.broadcast(a), F.col("to") == F.col("a_block")).drop("to")
    places = max(n_candidates, 1)
    at = c.withColumn("place", F.pmod(F.xxhash64("c_block"), F.lit(places)))
    every = a.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return every.join(at, F.col("to") == F.col("place")).drop("to", "place")


class Rows:
    """A block's vectors as arrays."""

    def __init__(self, row: dict, side: str):
        self.ids = np.frombuffer(row[f"{side}_vec_ids"], dtype=np.int64)
        self.labels = np.frombuffer(row[f"{side}_labels"], dtype=np.int64)
        dim, raw = row[f"{side}_dim"], row[f"{side}_components"]
        size = len(raw) // (len(self.ids) * dim) if dim else 8
        self.components = np.frombuffer(raw, dtype=f"i{size}").reshape(len(self.ids), dim)
        counts, positives, scores = (np.frombuffer(row[f"{side}_{x}"], dtype=np.int64).tolist()
                                     for x in ("wanted", "wanted_ids", "wanted_scores"))
        ends = np.cumsum(counts, dtype=np.int64).tolist()
        #: of each vector its positives with their scores
        self.wanted = [list(zip(positives[e - n:e], scores[e - n:e])) for n, e in zip(counts, ends)]

    def padded(self, dim: int) -> np.ndarray:
        return np.pad(self.components, ((0, 0), (0, dim - self.components.shape[1])))


class Packed:
    """Candidates packed for products with anchors whose components have the
    given least and largest value: ``fields`` candidates in each wide integer,
    ``width`` bits for each."""

    def __init__(self, candidates: np.ndarray, least: int, most: int):
        self.n, self.dim = candidates.shape
        self.up = -min(0, int(candidates.min(initial=0)))
        self.anchor_up = -min(0, least)
        largest = (int(candidates.max(initial=0)) + self.up) * (max(0, most) + self.anchor_up) * self.dim
        self.width = max(1, largest.bit_length())
        self.kind = np.uint64 if self.width < 64 else object  # so that no score needs the sign bit
        self.fields = 64 // self.width if self.kind is np.uint64 else WIDE_FIELDS
        groups = -(-self.n // self.fields)
        raised = np.zeros((groups * self.fields, self.dim), dtype=self.kind)
        raised[:self.n] = candidates.astype(object) + self.up if self.kind is object else (
            candidates.astype(np.int64).astype(np.uint64) + np.uint64(self.up))
        raised = raised.reshape(groups, self.fields, self.dim)
        self.words = raised[:, 0].copy()
        for i in range(1, self.fields):
            self.words += raised[:, i] << self._number(self.width * i)
        sums = candidates.astype(object if self.kind is object else np.int64).sum(axis=1)
        self.sums = sums if self.n else np.zeros(0, dtype=np.int64)

    def _number(self, x: int):
        return np.uint64(x) if self.kind is np.uint64 else x

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows) and candidates (columns)."""
        if self.kind is object:
            raised = anchors.astype(object) + self.anchor_up
        else:
            raised = anchors.astype(np.int64).astype(np.uint64) + np.uint64(self.anchor_up)
        products = np.matmul(raised, self.words.T)
        mask = self._number((1 << self.width) - 1)
        apart = np.empty((len(anchors), len(self.words), self.fields), dtype=self.kind)
        for i in range(self.fields):
            apart[:, :, i] = products >> self._number(self.width * i) & mask
        apart = apart.reshape(len(anchors), -1)[:, :self.n]
        wide = object if self.kind is object else np.int64
        own = anchors.astype(wide).sum(axis=1) if self.dim else np.zeros(len(anchors), dtype=np.int64)
        added = self.anchor_up * self.sums[None, :] + self.up * own[:, None] + self.dim * self.up * self.anchor_up
        if self.kind is object:
            found = apart - added
            if found.size and max(abs(x) for x in found.flat) >= 1 << 63:
                raise OverflowError("a score does not fit into a long")
            return found.astype(np.int64)
        # modulo 2^64 the difference is the score, which is in range
        return apart.view(np.int64) - added


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by score, then id."""
    if len(scores) > n:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:n]


def _ranges(labels: np.ndarray) -> dict:
    """Where each label's rows begin and end in a block."""
    values, starts = np.unique(labels, return_index=True)
    return dict(zip(values.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(labels)])))


def _best_in_pair(batches):
    """The first rows of an anchor's label in each block of candidates."""
    for batch in batches:
        for row in batch.to_pylist():
            a, c = Rows(row, "a"), Rows(row, "c")
            dim = max(a.components.shape[1], c.components.shape[1])
            left, right, out = a.padded(dim), c.padded(dim), []
            mine = _ranges(c.labels)
            for label, (start, end) in _ranges(a.labels).items():
                if label not in mine:
                    continue
                low, high = mine[label]
                packed = Packed(right[low:high], int(left.min(initial=0)), int(left.max(initial=0)))
                for at in range(start, end, SLICE):
                    scores = packed.scores(left[at:min(end, at + SLICE)])
                    for i, line in enumerate(scores):
                        others = np.flatnonzero(c.ids[low:high] != a.ids[at + i])
                        best = others[_first(line[others], c.ids[low:high][others], POSITIVES)]
                        out += [(int(a.ids[at + i]), int(c.ids[low + j]), int(line[j])) for j in best]
            yield pa.RecordBatch.from_pylist([dict(zip(("anchor_id", "vec_id", "score"), x)) for x in out], pa.schema(
                [("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))


def score_range(score: int) -> tuple[int, int]:
    """Least and largest integer n with 30 score <= 100 n <= 90 score."""
    return -(-LEAST_PERCENT * score // 100), MOST_PERCENT * score // 100


def _in_range_in_pair(batches):
    """For each positive of an anchor the first rows of other labels in its
    range, in each block of candidates."""
    schema = pa.schema([(n, pa.int64()) for n in FOUND])
    for batch in batches:
        for row in batch.to_pylist():
            a, c, out = Rows(row, "a"), Rows(row, "c"), []
            dim = max(a.components.shape[1], c.components.shape[1])
            left, right = a.padded(dim), c.padded(dim)
            asked = np.array([k for k, positives in enumerate(a.wanted) if positives], dtype=np.int64)
            packed = Packed(right, int(left.min(initial=0)), int(left.max(initial=0)))
            for at in range(0, len(asked), SLICE):
                some = asked[at:at + SLICE]
                for k, line in zip(some, packed.scores(left[some])):
                    ranges = [(positive, score, *score_range(score)) for positive, score in a.wanted[k]]
                    low, high = min(r[2] for r in ranges), max(r[3] for r in ranges)
                    near = np.flatnonzero((line >= low) & (line <= high) & (c.labels != a.labels[k]))
                    order = near[np.lexsort((c.ids[near], -line[near]))]
                    falling = -line[order]
                    for positive, score, least, most in ranges:
                        first, last = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
                        out += [(int(a.ids[k]), positive, score, int(c.ids[j]), int(line[j]))
                                for j in order[first:min(last, first + NEGATIVES)]]
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND, x)) for x in out], schema)


def _ranked(df: DataFrame, keys: list[str], score: str, name: str, most: int) -> DataFrame:
    """The first rows of each key; all but these are dropped before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(name))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def positives(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor_id``, ``vec_id`` and ``score`` of each anchor's positives."""
    with Settings(candidates.sparkSession, SENT_PAIRS):
        best = stored(_met(candidates, anchors).mapInArrow(_best_in_pair, BEST_SCHEMA), "best")
    return _ranked(best, ["anchor_id"], "score", "vec_id", POSITIVES).drop("rank")


def negatives(candidates: DataFrame, anchors: DataFrame) -> DataFrame:
    """The ranked negatives of the anchors' ``wanted`` positives."""
    with Settings(candidates.sparkSession, SENT_PAIRS):
        found = stored(_met(candidates, anchors).mapInArrow(_in_range_in_pair, ", ".join(f"{n} long" for n in FOUND)), "in-range")
    return _ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, anchor_every: int = 100) -> DataFrame:
    """One row per anchor (the vec_ids that ``anchor_every`` divides), positive
    and negative, ranked from 1."""
    vectors = one_row_each(relabelled(embeddings))
    chosen = vectors.filter(F.col("vec_id") % anchor_every == 0)
    candidates = stored(blocks(vectors, CANDIDATES), "candidates")
    best = stored(positives(candidates, stored(blocks(chosen, ANCHORS), "anchors")), "positives")
    wanted = best.groupBy(F.col("anchor_id").alias("of")).agg(F.collect_list(F.struct("vec_id", "score")).alias("wanted"))
    asking = chosen.join(wanted, F.col("vec_id") == F.col("of")).drop("of")
    return negatives(candidates, stored(blocks(stored(asking, "asking"), ANCHORS), "asking-blocks"))


ORACLE = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.c, b.c)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT * FROM (
  SELECT p.anchor_id, p.positive_id,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
         n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 100 * n.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score)
WHERE rank <= 10"""
