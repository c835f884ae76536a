"""Operator 4, SimHash near-dedup by a binary trie self-join.

Fingerprints are computed per document in Arrow batches. Distinct fingerprints
are then joined with themselves as paths of a binary trie: a pair of nodes
descends together, adds up the bits in which its two paths differ, and is
dropped as soon as they exceed what is allowed.

To spread the work and to prune early, the join runs over ``TURNS`` tries that
hold the same fingerprints rotated to start at different segments. Two
fingerprints at most ``distance`` bits apart differ by at most
``distance // TURNS`` bits in one of the segments, so the trie that starts
there finds them with that smaller budget for the segment's bits; no pair is
lost. Subtrees below a prefix are the unit of distribution: each is sent to
the subtrees whose prefixes are within the budget. A task keeps a spanning
forest of the links that it finds, so output never exceeds the fingerprints
it read, however many of them lie close together.

Edge cases: null, empty and blank texts have fingerprint zero and are linked
like any other; equal fingerprints are linked; an empty table gives an empty
result; extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored
from .components import connected_components

SHINGLE = 4
DISTANCE = 4
BITS = 64
TURNS = 3
#: fingerprints that a subtree holds on average
SUBTREE = 4096
#: node pairs of the trie that are expanded at once
FRONTIER = 1 << 19
ONE = np.uint64(1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the 64-bit hashes; zero if there are none."""
    if len(hashes) == 0:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    set_ = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(set_.view("<u8")[0])


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each shingle's UTF-8 bytes, words joined by blanks."""
    from xxhash import xxh64_intdigest
    split = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not split:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(split)
    if len(split) <= width:
        return np.array([xxh64_intdigest(joined, 42)], dtype=np.uint64)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:len(split) - width + 1].tolist()
    ends = ends[width - 1:].tolist()
    return np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(starts, ends, strict=True)),
                       np.uint64, len(starts))


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint as a signed long)."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                fps = [fingerprint(shingle_hashes(t.as_py(), width)) for t in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))],
                    names=["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(compute, f"doc_id {kind}, fp long")


def _rotate(fp: np.ndarray, by: int) -> np.ndarray:
    by %= BITS
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def trie_pairs(left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, segment: int,
               segment_most: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two subtrees (or of one with itself, ``right`` None) that
    differ by ``most`` bits at most, and by ``segment_most`` in the first
    ``segment`` bits. The arrays are sorted; each subtree's paths agree in the
    first ``depth`` bits, and the two prefixes differ in ``differing`` bits.
    """
    own = right is None
    other = left if own else right
    if not len(left) or not len(other):
        return
    # a frontier: node pairs as ranges of the arrays, the bits that differ so far
    stack = [(depth, np.array([[0, len(left), 0, len(other), differing]], dtype=np.int64))]
    while stack:
        at, nodes = stack.pop()
        if len(nodes) > FRONTIER:
            stack += [(at, nodes[i:i + FRONTIER]) for i in range(0, len(nodes), FRONTIER)]
            continue
        a0, a1, b0, b1, err = nodes.T
        small = ((a1 - a0) * (b1 - b0) <= 16) | (at == BITS)
        if small.any():
            yield from _leaves(left, other, nodes[small], own, most, segment, segment_most)
            nodes = nodes[~small]
            if not len(nodes):
                continue
            a0, a1, b0, b1, err = nodes.T
        bit = ONE << np.uint64(BITS - 1 - at)
        high = ~(bit | (bit - ONE))  # the bits above
        am = np.searchsorted(left, (left[a0] & high) | bit)
        bm = np.searchsorted(other, (other[b0] & high) | bit)
        same = (a0 == b0) & (a1 == b1) if own else np.zeros(len(nodes), dtype=bool)
        budget = min(segment_most, most) if at < segment else most
        far = err < budget
        children = [np.stack([a0, am, b0, bm, err], 1), np.stack([am, a1, bm, b1, err], 1),
                    np.stack([a0, am, bm, b1, err + 1], 1)[far],
                    np.stack([am, a1, b0, bm, err + 1], 1)[far & ~same]]
        nodes = np.concatenate(children)
        nodes = nodes[(nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])]
        if len(nodes):
            stack.append((at + 1, nodes))


def _leaves(left: np.ndarray, right: np.ndarray, nodes: np.ndarray, own: bool, most: int, segment: int,
            segment_most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compare all pairs below small node pairs, a bounded number at a time."""
    counts = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    for i in range(0, len(nodes), 1 << 16):
        part, n = nodes[i:i + (1 << 16)], counts[i:i + (1 << 16)]
        of = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        width = (part[:, 3] - part[:, 2])[of]
        a, b = part[of, 0] + k // width, part[of, 2] + k % width
        apart = left[a] ^ right[b]
        good = np.bitwise_count(apart) <= most
        if segment < BITS:
            good &= np.bitwise_count(apart >> np.uint64(BITS - segment)) <= segment_most
        if own:
            good &= a < b
        if good.any():
            yield a[good], b[good]


def _forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: at most n - 1 of them."""
    parent = np.arange(n)
    kept = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for a, b in pairs:
        # drop what is joined already before looping over the rest
        pa_, pb = parent[a], parent[b]
        apart = pa_ != pb
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                kept.append((x, y))
        hop = parent[parent]
        while (hop != parent).any():
            parent[:] = hop
            hop = parent[parent]
    return kept


def trie_links(fps: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (``a``, ``b``) that connect all distinct fingerprints ``fp`` at
    most ``distance`` bits apart; ``n`` is about their number."""
    turns = min(TURNS, distance + 1)
    size = BITS // turns
    segment_most = distance // turns
    depth = min(size, max(0, int(np.ceil(np.log2(max(1, n) / SUBTREE)))))

    def prefix_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each fingerprint, per trie, for its own subtree and for those with
        a smaller prefix within the segment's budget."""
        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            for t in range(turns):
                turned = _rotate(fp, t * size)
                own = turned >> np.uint64(BITS - depth) if depth else np.zeros_like(turned)
                yield pd.DataFrame({"trie": t, "subtree": own.view(np.int64), "prefix": own.view(np.int64), "fp": turned.view(np.int64)})
                reach = [(own, own, turned, 0)]
                for _ in range(segment_most if depth else 0):
                    more = []
                    for base, home, key, least in reach:
                        for i in range(least, depth):
                            flipped = base ^ np.uint64(1 << i)
                            more.append((flipped, home, key, i + 1))
                            lower = flipped < home
                            yield pd.DataFrame({"trie": t, "subtree": flipped[lower].view(np.int64),
                                                "prefix": home[lower].view(np.int64), "fp": key[lower].view(np.int64)})
                    reach = more

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        trie, subtree = int(key[0]), np.uint64(key[1])
        by = {int(p): np.sort(g.to_numpy().view(np.uint64)) for p, g in group.groupby("prefix")["fp"]}
        left = by.pop(int(subtree), np.zeros(0, np.uint64))
        every = np.concatenate([left, *by.values()])
        segment = size

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from trie_pairs(left, None, depth, 0, segment, segment_most, distance)
            start = len(left)
            for p, right in by.items():
                apart = int(np.bitwise_count(np.uint64(p) ^ subtree))
                for a, b in trie_pairs(left, right, depth, apart, segment, segment_most, distance):
                    yield a, b + start
                start += len(right)

        links = np.array(_forest(found(), len(every)), dtype=np.int64).reshape(-1, 2)
        back = _rotate(every, BITS - trie * size).view(np.int64)
        return pd.DataFrame({"a": back[links[:, 0]], "b": back[links[:, 1]]})

    copies = fps.select("fp").mapInPandas(prefix_copies, "trie int, subtree long, prefix long, fp long")
    return copies.groupBy("trie", "subtree").applyInPandas(join, "a long, b long")


def near_duplicates(documents: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest doc_id reachable
    over links of at most ``distance`` differing bits, itself included."""
    marked = stored(fingerprints(documents, width), "fingerprints")
    # copies meet here: one row per fingerprint, combined before the shuffle
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = trie_links(distinct, distinct.count(), distance)
    groups = connected_components(links, "a", "b")
    named = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = stored(named.join(least, "component").select(F.col("fp").alias("_fp"), "component_id"), "classes")
    return (marked.join(classes, F.col("fp") == F.col("_fp"))
            .select("doc_id", "fp", "component_id"))


def one_per_group(documents: DataFrame, width: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents that are their group's smallest doc_id, all columns kept.

    Rows that repeat a doc_id stay together, as they are one document.
    """
    groups = near_duplicates(documents, width, distance).select(F.col("doc_id").alias("_doc"), "component_id")
    keep = groups.filter(F.col("_doc").eqNullSafe(F.col("component_id"))).select("_doc").distinct()
    return documents.join(keep, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
