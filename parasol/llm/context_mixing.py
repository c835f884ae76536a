"""Operator 3, language-model scoring by online logistic context mixing.

A text is a sequence of words and one end. A word of the vocabulary (the
``MAX_VOCABULARY`` most frequent ones) is a path of bits in a Huffman tree;
another one is an escape there and then its bytes, each a path in a tree of
bytes. Every bit is predicted by several predictors, one for each context,
that look up how often each bit followed this context at this node in the
training texts, in tables reached by a hash of context and node:

* words: the node alone; the word before, if it is frequent; the last very
  frequent word, which tells the language;
* bytes: the last three, four and five bytes of the word; all of its
  bytes so far.

The predictors' log odds are summed with weights. A gate, made of how much
each predictor has seen, chooses the set of weights. Weights learn online:
after every ``SEGMENT`` words of a text they all move along the gradient of its
coding cost, so each text is predicted from its own past only, starting from
weights learned on training texts. An adaptive map per gate, learned there
too, refines the mixed log odds. The costs of all bits are the text's total.

Steps: (1) texts become blocks of word numbers, words are counted over all
training texts; (2) the byte predictors are counted from the distinct words;
(3) each block meets its words' counts: base score, escapes' costs, and texts
as vocabulary numbers; (4) the word predictors are counted, in tables that
grow with the corpus up to ``MAX_BITS``; (5) every text is scored. Weights are
fitted on one fold of the training texts with tables of the others, so that
they see how far a count can be trusted; then all folds' tables are added up.

Edge cases: a null text is empty and has just its end; rows that repeat a
doc_id are scored each; without training texts the base score is that of an
empty vocabulary and every bit costs one bit; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, segment_sum, stored, words

FOLDS, HELD_OUT, FITTING = 7, 2, 6
MAX_VOCABULARY = 1 << 15
#: words with a rank below this tell the language
FREQUENT = 64
#: the word before is a context of its own with a rank below this
PREVIOUS = 512
#: a predictor's table has two to the power of this many slots: by corpus size, between these
MIN_BITS, MAX_BITS = 16, 21
BYTE_BITS = 20
SEGMENT = 64
BLOCK_CHARS = 16 << 20
#: distinct words in a row of a block's list
LIST_WORDS = 20_000
#: words whose counts and costs are sent to every task; the others' meet their blocks by a join
MAX_HEAD = 1 << 19
#: words whose bits are expanded at once
STEP = 1 << 13
PRIOR = 0.4
LEAST_SEEN = np.array([3, 30])
RATE = 0.008
FIT_RATE = 0.02
LIMIT = 9.0
CELLS = 24


# ---------------------------------------------------------------- binary trees

class Tree:
    """A Huffman tree: for each symbol its nodes and bits, flat."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        self.size = n
        heap = [(int(c), i) for i, c in enumerate(counts)]
        heapq.heapify(heap)
        parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
        node = n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = node
            side[y] = 1
            heapq.heappush(heap, (a + b, node))
            node += 1
        paths, bits = [], []
        for i in range(n):
            path, bit = [], []
            while i != 2 * n - 2:
                bit.append(side[i])
                i = parent[i]
                path.append(i - n)
            paths.append(path[::-1])
            bits.append(bit[::-1])
        self.length = np.array([len(p) for p in paths], dtype=np.int32)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.node = np.array([x for p in paths for x in p], dtype=np.uint32)
        self.bit = np.array([x for b in bits for x in b], dtype=np.uint8)

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For all bits of the symbols: which symbol, node, bit."""
        n = self.length[symbols]
        of = np.repeat(np.arange(len(symbols)), n)
        at = (self.start[symbols] - (np.cumsum(n) - n))[of]
        at += np.arange(len(of))
        return of, self.node[at], self.bit[at]


def _join(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    """Hash of two 32-bit values."""
    h = (a.astype(np.uint32) ^ np.uint32(salt * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h = (h + np.asarray(b, dtype=np.uint32)) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(13))


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    h = (context ^ (node * np.uint32(0x9E3779B1))) * np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of bit 1 per slot; counts of bit 0 and 1 alternate. The two
    lowest bits of each number say how much was seen (0 to 2), so that one
    look into a large table gives both."""
    zero, one = counts[0::2].astype(np.float64), counts[1::2].astype(np.float64)
    odds = np.clip(np.log((one + PRIOR) / (zero + PRIOR)), -LIMIT, LIMIT).astype(np.float32)
    seen = np.searchsorted(LEAST_SEEN, zero + one, side="right").astype(np.uint32)
    return ((odds.view(np.uint32) & ~np.uint32(3)) | seen).view(np.float32)


def _look(tables: list[np.ndarray], slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each predictor's log odds, and the gate: how much each has seen."""
    found, gate = [], np.zeros(len(slots[0]), np.intp)
    for table, s in zip(tables, slots, strict=True):
        odds = table[s]
        gate *= 3
        gate += (odds.view(np.uint32) & np.uint32(3)).view(np.int32)
        found.append(odds)
    return found, gate


class Mixer:
    """Weights per gate and a refining map per gate."""

    def __init__(self, predictors: int, gates: int):
        self.weights = np.full((gates, predictors), 0.3, np.float32)
        self.cells = np.tile(np.linspace(-LIMIT, LIMIT, CELLS + 1, dtype=np.float32), (gates, 1))

    def refined(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed log odds and their refinement in equal parts; the cell."""
        cell = ((np.clip(z, -LIMIT, LIMIT) + np.float32(LIMIT)) * np.float32(CELLS / (2 * LIMIT))
                + np.float32(0.5)).astype(np.intp)
        cell += gate * (CELLS + 1)
        return (z + self.cells.ravel()[cell]) * np.float32(0.5), cell


def _outcome(z: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that the outcome costs at these log odds, and the outcome less
    its expectation."""
    sign = bit.astype(np.float32)
    sign *= np.float32(2)
    sign -= np.float32(1)
    wrong = np.exp(-sign * z)
    wrong += np.float32(1)
    cost = np.log2(wrong)
    # what did not happen had 1 - 1 / wrong
    np.reciprocal(wrong, out=wrong)
    np.subtract(np.float32(1), wrong, out=wrong)
    wrong *= sign
    return cost, wrong


def fit_mixer(mixer: Mixer, batches: Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]) -> float:
    """Move shared weights and cells batch by batch: inputs, gates, bits and
    how often each counts. Returns the bits that counted."""
    gates, k = mixer.weights.shape
    seen_w = np.full((gates, k), 1.0)
    seen_c = np.full(mixer.cells.size, 1.0)
    total = 0.0
    for inputs, gate, bit, times in batches:
        z = sum(mixer.weights[gate, i] * x for i, x in enumerate(inputs))
        final, cell = mixer.refined(z, gate)
        total += float(times.sum())
        miss = _outcome(z, bit)[1] * times
        for i, x in enumerate(inputs):
            g = np.bincount(gate, weights=miss * x, minlength=gates)
            seen_w[:, i] += g * g
            mixer.weights[:, i] += 5 * FIT_RATE * g / np.sqrt(seen_w[:, i])
        miss = _outcome(final, bit)[1] * times
        g = np.bincount(cell, weights=miss, minlength=len(seen_c))
        seen_c += g * g
        mixer.cells += (5 * FIT_RATE * g / np.sqrt(seen_c)).reshape(mixer.cells.shape)
    return total


# ----------------------------------------------------------------- the bytes of a word

END_OF_WORD = 256


class Spelling:
    """The byte model: costs of words outside the vocabulary."""

    ORDERS = (3, 4, 5)
    KINDS = len(ORDERS) + 1

    def __init__(self, tree: Tree):
        self.tree = tree
        self.odds: list[np.ndarray] = []
        self.mixer = Mixer(self.KINDS, 3 ** self.KINDS)

    def load(self, counts: np.ndarray) -> None:
        self.odds = [_log_odds(counts[i]) for i in range(self.KINDS)]

    def bits_of(self, spelled: pa.Array) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """For some words at a time: the word, slots and outcome of each bit."""
        spelled = spelled.cast(pa.large_binary())
        for i in range(0, len(spelled), STEP):
            part = spelled[i:i + STEP].take(pa.array(np.arange(len(spelled[i:i + STEP]))))
            ends = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1)
            raw = np.frombuffer(part.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            ends = ends - ends[0]
            n = np.diff(ends) + 1
            total = int(n.sum())
            stops = np.cumsum(n) - 1
            symbol = np.empty(total, np.int64)
            inside = np.ones(total, dtype=bool)
            inside[stops] = False
            symbol[inside] = raw
            symbol[stops] = END_OF_WORD
            starts = stops - n + 1
            place = np.arange(total) - np.repeat(starts, n)
            contexts, last = [], np.zeros(total, np.uint32)
            for back in range(1, max(self.ORDERS) + 1):
                byte = np.full(total, END_OF_WORD + 1, np.uint32)
                byte[back:] = symbol[:-back]
                byte[place < back] = END_OF_WORD + 1
                last = _join(last, byte, back)
                if back in self.ORDERS:
                    contexts.append(last)
            # the word so far: a sum of its bytes' hashes by place, which a prefix sum gives
            term = _join(symbol.astype(np.uint32), place, 9).astype(np.uint64)
            run = np.concatenate([[0], np.cumsum(term, dtype=np.uint64)[:-1]]).astype(np.uint64)
            prefix = (run - np.repeat(run[starts], n)).astype(np.uint32)
            contexts.append(_join(prefix, place, 3))
            of, node, bit = self.tree.expand(symbol)
            word = np.repeat(np.arange(len(part), dtype=np.int32), n)[of] + i
            yield word, [_slot(c[of], node, BYTE_BITS) for c in contexts], bit

    def costs(self, spelled: pa.Array) -> np.ndarray:
        out = np.zeros(len(spelled))
        for word, slots, bit in self.bits_of(spelled):
            inputs, gate = _look(self.odds, slots)
            z = sum(self.mixer.weights[gate, i] * x for i, x in enumerate(inputs))
            cost = _outcome(self.mixer.refined(z, gate)[0], bit)[0]
            out += np.bincount(word, weights=cost, minlength=len(out))
        return out


# ----------------------------------------------------------------- the words of a text

class Phrasing:
    """The word model over vocabulary numbers: ESCAPE is n, END n + 1."""

    KINDS = 2

    def __init__(self, tree: Tree, node_counts: np.ndarray, bits: int):
        self.tree = tree
        self.bits = bits
        self.own = _log_odds(node_counts)
        self.odds: list[np.ndarray] = []
        self.mixer = Mixer(self.KINDS + 1, 3 ** self.KINDS)

    def load(self, counts: np.ndarray) -> None:
        self.odds = [_log_odds(counts[i]) for i in range(self.KINDS)]

    def contexts(self, symbols: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Context hashes of every word; each text starts anew."""
        n = len(symbols)
        none = np.uint32(self.tree.size)
        starts = offsets[:-1]
        one = np.empty(n, np.uint32)
        one[1:] = symbols[:-1]
        one[starts] = none
        often = np.flatnonzero(symbols < FREQUENT)
        # number of frequent words before each place, and before each text
        before = np.concatenate([[0], np.cumsum(symbols < FREQUENT)])
        rank = before[:-1]
        first = np.repeat(before[starts], np.diff(offsets))
        padded = np.concatenate([[none], symbols[often].astype(np.uint32)])
        last = np.where(rank > first, padded[rank], none)
        one = np.where(one < PREVIOUS, one, none - np.uint32(1))
        return [_join(one, 0, 4), _join(last, 0, 5)]

    def slots(self, contexts: list[np.ndarray], of: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
        return [_slot(c[of], node, self.bits) for c in contexts]

    def count(self, symbols: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        """Add the outcomes of all bits to the tables' counts."""
        contexts = self.contexts(symbols, offsets)
        for i in range(0, len(symbols), STEP):
            of, node, bit = self.tree.expand(symbols[i:i + STEP])
            for k, s in enumerate(self.slots([c[i:i + STEP] for c in contexts], of, node)):
                np.add.at(table[k], s * np.uint32(2) + bit, np.uint32(1))

    def inputs(self, contexts: list[np.ndarray], of: np.ndarray, node: np.ndarray):
        found, gate = _look(self.odds, self.slots(contexts, of, node))
        return [self.own[node], *found], gate

    def fitting(self, symbols: np.ndarray, offsets: np.ndarray):
        contexts = self.contexts(symbols, offsets)
        for i in range(0, len(symbols), 1 << 11):
            of, node, bit = self.tree.expand(symbols[i:i + (1 << 11)])
            yield *self.inputs([c[i:i + (1 << 11)] for c in contexts], of, node), bit, np.ones(len(bit))

    def costs(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text. Texts go along side by side, a segment of each
        at a time; each has weights of its own, which move after it."""
        sizes = np.diff(offsets)
        out = np.zeros(len(sizes))
        contexts = self.contexts(symbols, offsets)
        order = np.argsort(-sizes, kind="stable")
        k = self.mixer.weights.shape[1]
        columns = [np.ascontiguousarray(self.mixer.weights[:, j]) for j in range(k)]
        lot = max(1, STEP // SEGMENT)
        for i in range(0, len(order), lot):
            texts = order[i:i + lot]
            shift = np.zeros((k, len(texts)), np.float32)
            for at in range(0, int(sizes[texts[0]]), SEGMENT):
                active = int(np.searchsorted(-sizes[texts], -at, side="left"))
                n = np.minimum(sizes[texts[:active]] - at, SEGMENT)
                word = np.repeat(offsets[texts[:active]] + at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                symbol = symbols[word]
                of, node, bit = self.tree.expand(symbol)
                found, gate = self.inputs([c[word] for c in contexts], of, node)
                # bits of a text stand together
                ends = np.cumsum(np.add.reduceat(self.tree.length[symbol], np.cumsum(n) - n))
                starts = ends - np.diff(ends, prepend=0)
                text = np.repeat(np.arange(active), ends - starts)
                z = (columns[0][gate] + shift[0][text]) * found[0]
                for j in range(1, k):
                    z += (columns[j][gate] + shift[j][text]) * found[j]
                cost, miss = _outcome(self.mixer.refined(z, gate)[0], bit)
                out[texts[:active]] += np.add.reduceat(cost, starts, dtype=np.float64)
                if int(sizes[texts[0]]) > at + SEGMENT:
                    for j in range(k):
                        shift[j, :active] += np.float32(RATE) * np.add.reduceat(miss * found[j], starts)
        return out


# ----------------------------------------------------------------- Spark steps

def _encode(documents: DataFrame) -> DataFrame:
    """Blocks: a row per text with its words as numbers (kind 0), and rows of
    some thousand of the block's distinct words, from number ``ix`` on, with
    their training counts (kind 1)."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = (f"kind int, block long, doc_id {kind}, fold int, codes binary, n_bytes long, ix int, "
              "words array<string>, n array<long>, m array<long>")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_CHARS):
                ends, codes, uniques = words(part.column("text"))
                folds = part.column("fold").to_numpy()
                of = np.repeat(folds, np.diff(ends))
                n = np.bincount(codes[(of != HELD_OUT) & (of != FITTING)], minlength=len(uniques))
                m = np.bincount(codes[of == FITTING], minlength=len(uniques))
                rows, distinct = part.num_rows, len(uniques)
                low, high = (codes & 0xFFFF).astype("<u2"), (codes >> 16).astype("u1" if distinct < 1 << 24 else "<u4")
                cut = [low[a:b].tobytes() + high[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = [pa.nulls(rows, pa.list_(x)) for x in (pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(rows, np.int32)), pa.array(np.full(rows, number)), part.column("doc_id"),
                     part.column("fold"), pa.array(cut, pa.binary()), part.column("n_bytes"),
                     pa.nulls(rows, pa.int32()), *lists], names=names)
                for i in range(0, distinct, LIST_WORDS):
                    own = slice(i, min(i + LIST_WORDS, distinct))
                    whole = pa.array([0, own.stop - i], pa.int32())
                    lists = [pa.ListArray.from_arrays(whole, x) for x in (
                        uniques[own].cast(pa.string()), pa.array(n[own]), pa.array(m[own]))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([1], pa.int32()), pa.array([number]), pa.nulls(1, part.column("doc_id").type),
                         pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                         pa.array([i], pa.int32()), *lists], names=names)
                number += 1
                del ends, codes, low, high, uniques, of, n, m, cut, lists
                pa.default_memory_pool().release_unused()

    return documents.select(
        "doc_id", "text", fold(F.col("doc_id"), FOLDS).cast("int").alias("fold"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).mapInArrow(run, schema)


def _counted(lists: DataFrame) -> DataFrame:
    """Training counts of every distinct word, held-out ones with 0."""
    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c).flatten() for c in ("words", "n", "m")],
                                             names=["word", "n", "m"])

    return lists.select("words", "n", "m").mapInArrow(flat, "word string, n long, m long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("m").alias("m"))


def _word_hashes(column: pa.Array) -> np.ndarray:
    """What ``xxhash64(word)`` gives in SQL."""
    from xxhash import xxh64_intdigest
    return np.fromiter((xxh64_intdigest(w, 42) for w in column.cast(pa.binary()).to_pylist()), np.uint64,
                       len(column)).view(np.int64)


class Head:
    """Counts, ranks and costs of the most frequent words, found by hash."""

    def __init__(self, found: pa.Table):
        found = found.sort_by("h").combine_chunks()
        self.hash = found.column("h").to_numpy()
        self.count = found.column("c").to_numpy()
        self.rank = found.column("rank").to_numpy()
        self.cost = found.column("cost").to_numpy().astype(np.float32)

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which words are in it, and their places."""
        h = _word_hashes(column)
        if not len(self.hash):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h), np.int64)
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        return self.hash[at] == h, at


SLICE = 1 << 15
TABLE = "part int, kind int, slice int, counts binary"


def _packed(counts: np.ndarray) -> bytes:
    """Counts in as many bytes as the largest needs, compressed."""
    size = 1 if counts.max() < 1 << 8 else 2 if counts.max() < 1 << 16 else 4
    return bytes([size]) + pa.compress(counts.astype(f"<u{size}").tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    size = packed[0]
    return np.frombuffer(pa.decompress(packed[1:], decompressed_size=SLICE * size, codec="zstd", asbytes=True), f"<u{size}")


def _slices(part: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a task's table: those parts of it that counted anything."""
    for k, row in enumerate(table):
        for i in range(0, len(row), SLICE):
            piece = row[i:i + SLICE]
            if piece.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([i // SLICE], pa.int32()),
                     pa.array([_packed(piece)], pa.binary())], names=["part", "kind", "slice", "counts"])


def _summed(rows: DataFrame, kinds: int, bits: int) -> dict[int, np.ndarray]:
    """All tasks' tables added up, slice by slice; the model has a fixed size."""
    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum((_unpacked(piece).astype(np.uint64) for piece in group["counts"]), np.zeros(1, np.uint64))
        total = np.minimum(total, np.iinfo(np.uint32).max)
        return pd.DataFrame({"part": [key[0]], "kind": [key[1]], "slice": [key[2]], "counts": [_packed(total)]})

    out = {p: np.zeros((kinds, 2 << bits), np.uint32) for p in (0, 1)}
    for r in rows.groupBy("part", "kind", "slice").applyInPandas(add, TABLE).toLocalIterator():
        piece = _unpacked(r["counts"])
        out[r["part"]][r["kind"], r["slice"] * SLICE:r["slice"] * SLICE + len(piece)] = piece
    return out


def _averaged(mixer: Mixer, rows: list) -> None:
    """The tasks' mixers, weighed by the bits that each saw."""
    total = sum(r["seen"] for r in rows)
    if total:
        mixer.weights = np.sum([np.frombuffer(r["weights"], "<f4") * (r["seen"] / total) for r in rows], 0).astype(
            np.float32).reshape(mixer.weights.shape)
        mixer.cells = np.sum([np.frombuffer(r["cells"], "<f4") * (r["seen"] / total) for r in rows], 0).astype(
            np.float32).reshape(mixer.cells.shape)


MIXED = "seen double, weights binary, cells binary"


def _mixed(mixer: Mixer, seen: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([seen]), pa.array([mixer.weights.astype("<f4").tobytes()], pa.binary()),
         pa.array([mixer.cells.astype("<f4").tobytes()], pa.binary())], names=["seen", "weights", "cells"])


def _spelling(counts: DataFrame, vocabulary: list) -> Spelling:
    """Count the byte predictors over all words outside the vocabulary."""
    spark = counts.sparkSession
    seen = np.ones(257, np.int64)
    for r in vocabulary:
        np.add.at(seen, np.frombuffer(r["word"].encode(), np.uint8), r["n"] + r["m"])
        seen[END_OF_WORD] += r["n"] + r["m"]
    model = Spelling(Tree(seen))
    sent = spark.sparkContext.broadcast(model)
    rare = counts.filter("rank IS NULL AND n + m > 0").select("word", "n", "m")

    def counter(part: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros((Spelling.KINDS, 2 << BYTE_BITS), np.uint32)
            for batch in batches:
                times = batch.column("times").to_numpy().astype(np.uint32)
                for word, slots, bit in sent.value.bits_of(batch.column("word")):
                    for k, s in enumerate(slots):
                        np.add.at(table[k], s * np.uint32(2) + bit, times[word])
            yield from _slices(part, table)
        return count

    # a part of the counts at a time, so that a task holds one table of each kind
    parts = [rare.filter(f"{c} > 0").select("word", F.col(c).alias("times")).mapInArrow(counter(p), TABLE)
             for p, c in enumerate("nm")]
    tables = _summed(parts[0].unionByName(parts[1]), Spelling.KINDS, BYTE_BITS)
    model.load(tables[0])
    sent = spark.sparkContext.broadcast(model)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value

        def bits():
            for batch in batches:
                times = batch.column("m").to_numpy().astype(np.float64)
                for word, slots, bit in m.bits_of(batch.column("word")):
                    for i in range(0, len(word), 1 << 14):
                        inputs, gate = _look(m.odds, [s[i:i + (1 << 14)] for s in slots])
                        yield inputs, gate, bit[i:i + (1 << 14)], times[word[i:i + (1 << 14)]]

        yield _mixed(m.mixer, fit_mixer(m.mixer, bits()))

    _averaged(model.mixer, rare.filter("m > 0").mapInArrow(fit, MIXED).collect())
    model.load(tables[0] + tables[1])
    return model


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary numbers of a batch's texts, flat, and the texts' offsets."""
    codes = batch.column("symbols").to_pylist()
    flat = np.frombuffer(b"".join(codes), "<u2")
    return flat, np.concatenate([[0], np.cumsum([len(c) // 2 for c in codes])]).astype(np.int64)


def _lots(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    return chunks(batch, "symbols", 2 * limit)


def score(documents: DataFrame, max_vocabulary: int = MAX_VOCABULARY, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` (log10 probabilities) and ``bits_per_byte``."""
    spark = documents.sparkSession
    sc = spark.sparkContext
    kind = documents.schema["doc_id"].dataType.simpleString()
    encoded = stored(_encode(documents), "lm-blocks")
    texts, lists = encoded.filter("kind = 0"), encoded.filter("kind = 1")
    counted = stored(_counted(lists), "lm-counts")
    in_training = counted.filter("n + m > 0")
    totals = in_training.agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.sum("m").alias("m")).first()
    ends = {r["fold"]: r["count"] for r in texts.groupBy("fold").count().collect()}
    end_n = sum(c for f, c in ends.items() if f not in (HELD_OUT, FITTING))
    end_m = ends.get(FITTING, 0)
    n_train = (totals["n"] or 0) + (totals["m"] or 0) + end_n + end_m
    n_words = totals["v"] + (1 if end_n + end_m else 0)
    vocabulary = (in_training.orderBy(F.desc(F.col("n") + F.col("m")), "word").limit(max_vocabulary).collect())
    size = len(vocabulary)
    ranks = F.broadcast(spark.createDataFrame([(r["word"], i) for i, r in enumerate(vocabulary)], "word string, rank int"))
    counts = counted.join(ranks, "word", "left")
    spelling = _spelling(counts, vocabulary)

    # the tree of words, and what its nodes have seen
    in_n, in_m = (np.array([r[c] for r in vocabulary], dtype=np.int64) for c in ("n", "m"))
    seen = {p: np.concatenate([own, [(t or 0) - own.sum(), e]]) for p, (own, t, e) in enumerate(
        ((in_n, totals["n"], end_n), (in_m, totals["m"], end_m)))}
    tree = Tree(seen[0] + seen[1] + 1)
    of, node, bit = tree.expand(np.arange(tree.size))
    nodes = {p: np.bincount(node * np.uint32(2) + bit, weights=s[of], minlength=2 * tree.size) for p, s in seen.items()}
    bits = int(np.clip(np.ceil(np.log2(max(1, n_train) / 2)), MIN_BITS, max_bits))

    # costs of all words outside the vocabulary, once for each
    spelled = sc.broadcast(spelling)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").fill_null(-1).to_numpy()
            cost = np.zeros(len(rank))
            rare = np.flatnonzero(rank < 0)
            cost[rare] = spelled.value.costs(batch.column("w").take(pa.array(rare)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("w"), batch.column("h"), batch.column("c"), pa.array(rank), pa.array(cost)],
                names=["w", "h", "c", "rank", "cost"])

    costed = stored(counts.select(F.col("word").alias("w"), F.xxhash64("word").alias("h"), (F.col("n") + F.col("m")).alias("c"),
                                  "rank").mapInArrow(spell, "w string, h long, c long, rank int, cost double"), "lm-costed")
    # the head: all words with at least so many occurrences, as many as fit
    sizes = costed.groupBy(F.least("c", F.lit(100_000)).alias("c")).count().orderBy(F.desc("c")).collect()
    least, held = 100_001, 0
    for r in sizes:
        held += r["count"]
        if held > MAX_HEAD:
            break
        least = r["c"]
    head = sc.broadcast(Head(costed.filter((F.col("c") >= least) | (F.col("rank") >= 0)).select("h", "c", "rank", "cost").toArrow()))

    def tail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ix, own in zip(batch.column("block").to_pylist(), batch.column("ix").to_pylist(),
                                      batch.column("words"), strict=True):
                rest = np.flatnonzero(~head.value.find(own.values)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rest), block)), pa.array((rest + ix).astype(np.int32)),
                     own.values.take(pa.array(rest)).cast(pa.string())], names=["b", "ix", "word"])

    def of_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ix, own in zip(batch.column("block"), batch.column("ix"), batch.column("words"), strict=True):
                has, at = head.value.find(own.values)
                n = len(has)
                count, rank, cost = (np.where(has, x[at], y) if len(x) else np.full(n, y, x.dtype) for x, y in (
                    (head.value.count, 0), (head.value.rank, -1), (head.value.cost, np.float32(0))))
                data = [count.astype("<i8").tobytes(), rank.astype("<i4").tobytes(), cost.astype("<f4").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()]), pa.array([ix.as_py()], pa.int32()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.float32()), *(pa.array([x], pa.binary()) for x in data)],
                    names=["b", "ix", "c", "cost", "counts", "ranks", "costs"])

    lists = lists.select("block", "ix", "words")
    nothing = [F.lit(None).cast("binary").alias(x) for x in ("counts", "ranks", "costs")]
    known = lists.mapInArrow(tail, "b long, ix int, word string").join(
        costed.filter((F.col("c") < least) & (F.col("rank") < 0)), F.col("word") == F.col("w")).select(
        "b", "ix", "c", F.col("cost").cast("float").alias("cost"), *nothing).unionByName(lists.mapInArrow(
            of_head, "b long, ix int, c long, cost float, counts binary, ranks binary, costs binary"))
    coded_schema = (f"doc_id {kind}, fold int, n_bytes long, n_tokens long, n_known long, base_score double, "
                    "escape_bits double, symbols binary")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        heads = right.filter(pc.is_valid(right.column("counts"))).sort_by("ix")
        rest = right.filter(pc.is_null(right.column("counts")))
        c, rank, cost = (np.frombuffer(b"".join(heads.column(x).to_pylist()), t) for x, t in (
            ("counts", "<i8"), ("ranks", "<i4"), ("costs", "<f4")))
        c, cost = c.astype(np.float64), cost.astype(np.float64)
        at = rest.column("ix").to_numpy()
        c[at], cost[at] = rest.column("c").to_numpy(), rest.column("cost").to_numpy()
        symbol = np.where(rank >= 0, rank, size).astype("<u2")
        raw = left.column("codes").to_pylist()
        wide = 3 if len(c) < 1 << 24 else 6  # bytes of a word: two low ones of all, then the high ones
        sizes = np.array([len(x) // wide for x in raw], dtype=np.int64)
        codes = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, "<u2", n) + (
            np.frombuffer(x, "u1" if wide == 3 else "<u4", n, 2 * n).astype(np.int64) << 16) for x, n in zip(raw, sizes.tolist(), strict=True))])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        end_c = end_n + end_m
        log_c, has = np.log10(c + 1), (c > 0).astype(np.float64)
        base = segment_sum(log_c[codes], offsets) + np.log10(end_c + 1) - (sizes + 1) * np.log10(n_train + n_words + 1)
        n_known = np.rint(segment_sum(has[codes], offsets)).astype(np.int64) + int(end_c > 0)
        every = symbol[codes]
        stop = np.array([size + 1], "<u2").tobytes()
        symbols = [every[a:b].tobytes() + stop for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return pa.table({
            "doc_id": left.column("doc_id"), "fold": left.column("fold"), "n_bytes": left.column("n_bytes"),
            "n_tokens": pa.array(sizes + 1), "n_known": pa.array(n_known), "base_score": pa.array(base),
            "escape_bits": pa.array(segment_sum(cost[codes], offsets)), "symbols": pa.array(symbols, pa.binary())})

    coded = stored(texts.select("block", "doc_id", "fold", "codes", "n_bytes").groupBy("block").cogroup(
        known.groupBy("b")).applyInArrow(code, coded_schema), "lm-coded")

    # the word predictors
    model = Phrasing(tree, nodes[0], bits)
    sent = sc.broadcast(model)

    def counter(part: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros((Phrasing.KINDS, 2 << bits), np.uint32)
            for batch in batches:
                for lot in _lots(batch):
                    sent.value.count(*_texts(lot), table)
            yield from _slices(part, table)
        return count

    folds = ((F.col("fold") != HELD_OUT) & (F.col("fold") != FITTING), F.col("fold") == FITTING)
    parts = [coded.filter(f).select("symbols").mapInArrow(counter(p), TABLE) for p, f in enumerate(folds)]
    tables = _summed(parts[0].unionByName(parts[1]), Phrasing.KINDS, bits)
    model.load(tables[0])
    first = sc.broadcast(model)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = first.value
        pieces = (x for batch in batches for lot in _lots(batch) for x in m.fitting(*_texts(lot)))
        yield _mixed(m.mixer, fit_mixer(m.mixer, pieces))

    fitting = coded.filter(F.col("fold") == FITTING).select("symbols")
    _averaged(model.mixer, fitting.mapInArrow(fit, MIXED).collect())
    model.own = _log_odds(nodes[0] + nodes[1])
    model.load(tables[0] + tables[1])
    del tables
    final = sc.broadcast(model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lot in _lots(batch):
                total = final.value.costs(*_texts(lot)) + lot.column("escape_bits").to_numpy()
                size_ = np.maximum(lot.column("n_bytes").to_numpy(), 1)
                yield pa.RecordBatch.from_arrays(
                    [*(lot.column(c) for c in ("doc_id", "fold", "n_tokens", "n_known", "base_score")),
                     pa.array(-total * np.log10(2)), pa.array(total / size_)],
                    names=["doc_id", "fold", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    out = coded.mapInArrow(finish, f"doc_id {kind}, fold int, n_tokens long, n_known long, base_score double, "
                                   "score double, bits_per_byte double")
    return out.select("doc_id", (F.col("fold") == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                      F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
