"""Operator 5, benchmark decontamination: CGK embedding and bit-sampling LSH.

Texts and benchmark items are sequences of words (lower-cased, letters and
digits only). A window of words is embedded by a CGK random walk: at step t it
shows the word under its pointer and moves on if a random bit, drawn by step
and word, is set. Two windows at a small edit distance walk in step again
after each edit, so their embeddings differ in few steps (Hamming distance).
Bit-sampling LSH then takes the words shown at ``SAMPLES`` random steps as a
key. The walk and the sampled steps are drawn anew for each of
``REPETITIONS``; each item enters with windows from each of its words on that
has ``span`` words to its end, each text with windows from every word on, so
an edit spoils few keys and some other one is found. A key whose walk rested
on too few words to tell an item is left to the other windows, unless the item
has none better. The spans follow the items' sizes (``CLASSES``).

Edits spread over letters spoil nearly every word, so items are also looked for
by their letters, blanks left out: a run of ``RUN`` letters (``SHORT_RUN`` for
items of fewer than ``PART`` letters) that an item shares with a text is a
place where both are compared, ``PART`` letters of the item around the run
against the text there, by edit distances of many places at once. Places where
this part needs more than ``PART_EDITS`` of it are dropped.

A place that is left, or a window of a text that shares a key with an item, is
followed by an exact check: the least edit distance in characters between the item and any part of
the text around that place, the item's size and some words more. The text
contains the item if it is at most ``MOST_EDITS`` of the item's characters.

A walk is given up as soon as the words it showed at the sampled steps start
no key, so most windows end at their first word. Items are sent to the tasks
in blocks of bounded size, one pass over the texts for each block.

Edge cases: null and blank texts contain nothing; items without words are
contained in nothing; equal items are reported each; an empty table on either
side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, words

MOST_EDITS = 0.2
REPETITIONS = 6
#: by least words of an item: steps of a walk, sampled steps, words that a key should show
CLASSES = ((14, 14, 5, 4), (6, 6, 4, 3), (4, 4, 4, 3), (3, 3, 3, 2), (2, 2, 2, 2), (1, 1, 1, 1))
PADDING = 14
#: characters of items that are sent to the tasks at once
BLOCK_CHARS = 4 << 20
SEED = 41
#: letters of a run by which an item is found, and of a run of an item shorter than a part
RUN, SHORT_RUN = 8, 4
#: letters of an item that are compared first, and the edits that they may need
PART, PART_EDITS = 64, 0.3
#: places compared at once; words whose letters are laid out at once, and words around them
PLACES, WORDS_AT_ONCE, AROUND = 1 << 15, 1 << 18, 128
#: places of an item that differ by less are one
NEAR = 8
ONE, LOW = np.uint64(1), np.uint64(0xFFFF)
#: characters of the texts that are searched at once
CHUNK_CHARS = 32 << 20


def plain(words_: pa.Array) -> pa.Array:
    """Words in lower case, without what is neither letter nor digit."""
    return pc.replace_substring_regex(pc.utf8_lower(words_), r"[^\p{L}\p{N}]+", "")


def symbol_hashes(plain_words: pa.Array) -> np.ndarray:
    """A number for each word, 0 for the empty one."""
    own = plain_words.cast(pa.large_binary())
    hashes = np.fromiter(map(zlib.crc32, own.to_pylist()), np.uint64, len(own))
    hashes[pc.binary_length(own).to_numpy(zero_copy_only=False) > 0] += ONE
    return hashes


def _known(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the keys that are among the known ones, which are in order,
    after a look at their low bits."""
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[known & LOW] = True
    stay = np.flatnonzero(maybe[keys & LOW])
    some = keys[stay]
    return stay[known[np.minimum(np.searchsorted(known, some), len(known) - 1)] == some] if len(known) else stay[:0]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of 64-bit values; one for each salt."""
    x = (h + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def sampled_steps(repetition: int, span: int, samples: int) -> list[int]:
    """The first step, at which a window is told by its first word, and
    others at random."""
    rng = np.random.default_rng([SEED, repetition, span])
    return [0, *sorted(rng.choice(np.arange(1, span), samples - 1, replace=False).tolist())] if span > 1 else [0]


def _advance(bits: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Move the pointers from step ``first`` to step ``last``."""
    for t in range(first, last):
        at = at + ((bits[at] >> np.uint64(t)) & np.uint64(1)).astype(np.int64)
    return at


def _extend(key: np.ndarray, shown: np.ndarray, step: int) -> np.ndarray:
    return _mix(key * np.uint64(31) + shown, step + 1)


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _runs(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` (a power of two) symbols."""
    h = _mix(symbols.astype(np.uint64), 1)
    step = 1
    while step < length:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + h[step:] if len(h) > step else h[:0]
        h ^= h >> np.uint64(32)
        step *= 2
    return h


class Letters:
    """The runs of letters of a block of items."""

    def __init__(self, texts: list[str], limits: list[int]):
        self.limits = np.array(limits, dtype=np.int64)
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.bases = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.concatenate([_symbols("".join(texts)), np.zeros(PART, np.uint32)])
        #: per length: a look at low bits, keys in order, where each one's spots begin, spots as (item, offset)
        self.tables = []
        for length, which in ((RUN, self.sizes >= PART), (SHORT_RUN, self.sizes < PART)):
            own = [(i, o) for i in np.flatnonzero(which).tolist() for o in range(self.sizes[i] - length + 1)]
            if not own:
                continue
            spots = np.array(own, dtype=np.int64)
            hashes = _runs(self.flat, length)[self.bases[spots[:, 0]] + spots[:, 1]]
            order = np.argsort(hashes, kind="stable")
            keys, begin = np.unique(hashes[order], return_index=True)
            maybe = np.zeros(1 << 20, dtype=bool)
            maybe[keys & np.uint64(0xFFFFF)] = True
            self.tables.append((length, maybe, keys, np.append(begin, len(order)), spots[order]))

    def places(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, offsets of letters in them, and places of these in the text,
        where a part of the item is near the text."""
        for length, maybe, keys, begin, spots in self.tables:
            hashes = _runs(symbols, length)
            at = np.flatnonzero(maybe[hashes & np.uint64(0xFFFFF)])
            found = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
            same = keys[found] == hashes[at]
            at, found = at[same], found[same]
            many = begin[found + 1] - begin[found]
            # as many runs at once as have about PLACES places
            cuts = np.flatnonzero(np.diff(np.cumsum(many) // PLACES)) + 1 if len(at) else []
            for a, f, n in zip(np.split(at, cuts), np.split(found, cuts), np.split(many, cuts), strict=True):
                if len(a):
                    yield self._near(symbols, np.repeat(a, n), spots[
                        np.repeat(begin[f] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    def _near(self, symbols: np.ndarray, at: np.ndarray, spots: np.ndarray):
        item, offset = spots[:, 0], spots[:, 1]
        size = np.minimum(self.sizes[item], PART)
        part = np.clip((offset - PART // 2 + 4) // 16 * 16, 0, self.sizes[item] - size)
        places = (at - offset) // NEAR
        places -= places.min()
        _, first = np.unique((self.bases[item] + part) * (int(places.max()) + 1) + places, return_index=True)
        at, item, offset, size, part = at[first], item[first], offset[first], size[first], part[first]
        # letters of the parts, as masks by a letter's low bits
        starts, own = np.unique(self.bases[item] + part, return_inverse=True)
        masks = np.zeros((len(starts), 64), dtype=np.uint64)
        lengths = np.zeros(len(starts), dtype=np.int64)
        lengths[own] = size
        for j in range(PART):
            rows = np.flatnonzero(lengths > j)
            masks[rows, self.flat[starts[rows] + j] & 63] |= ONE << np.uint64(j)
        limit = np.where(self.sizes[item] > PART, int(PART_EDITS * PART), self.limits[item])
        most = int(limit.max()) + NEAR
        top = (size - 1).astype(np.uint64)
        more, less = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        score, best = size.astype(np.int64), size.astype(np.int64)
        diagonal, up, down, eq = (np.empty(len(at), np.uint64) for _ in range(4))
        # letters of the text from the first place on, 64 for what is before or behind it
        begin = at - (offset - part) - most
        before, end = int(begin.min()), int(begin.max()) + 2 * most + PART
        inner = symbols[max(0, before):max(0, min(end, len(symbols)))] & 63
        text = np.full(end - before, 64, dtype=np.int32)
        text[max(0, -before):max(0, -before) + len(inner)] = inner
        masks = np.concatenate([masks, np.zeros((len(starts), 1), np.uint64)], axis=1).ravel()
        own, begin = own * 65, begin - before
        for step in range(2 * most + PART):
            np.take(masks, own + text[step:].take(begin), out=eq, mode="clip")
            # diagonal = (((eq & more) + more) ^ more) | eq | less
            np.bitwise_and(eq, more, out=diagonal)
            diagonal += more
            diagonal ^= more
            diagonal |= eq
            diagonal |= less
            # up, down = less | ~(diagonal | more), more & diagonal
            np.bitwise_or(diagonal, more, out=up)
            np.invert(up, out=up)
            up |= less
            np.bitwise_and(more, diagonal, out=down)
            for moved, change in ((up, np.add), (down, np.subtract)):
                np.right_shift(moved, top, out=eq)
                eq &= ONE
                change(score, eq.view(np.int64), out=score)
                moved <<= ONE
            # more, less = down | ~(diagonal | up), up & diagonal
            np.bitwise_or(diagonal, up, out=more)
            np.invert(more, out=more)
            more |= down
            np.bitwise_and(up, diagonal, out=less)
            np.minimum(best, score, out=best)
        good = best <= limit
        return item[good], offset[good], at[good]


class Index:
    """LSH tables of a block of items."""

    def __init__(self, items: list[tuple[object, str]], most_edits: float = MOST_EDITS):
        self.ids: list[object] = []
        self.texts: list[str] = []
        self.sizes: list[int] = []
        sequences = []
        for item_id, text in items:
            ends, codes, uniques = words(pa.array([text], pa.string()), lower=False)
            own = plain(uniques).take(pa.array(codes))
            own = own.filter(pc.not_equal(own, ""))
            if len(own):
                self.ids.append(item_id)
                self.texts.append(" ".join(own.to_pylist()))
                self.sizes.append(len(own))
                sequences += [symbol_hashes(own), np.zeros(PADDING, dtype=np.uint64)]
        flat = np.concatenate(sequences) if sequences else np.zeros(0, np.uint64)
        bases = np.concatenate([[0], np.cumsum(np.array(self.sizes, dtype=np.int64) + PADDING)])
        #: per table: walk's number, sampled steps, keys going on after each, and (item, offset) by full key
        self.tables: list[tuple[int, list[int], list[np.ndarray], dict[int, list[tuple[int, int]]]]] = []
        most = 1 << 62
        for least, span, samples, words_ in CLASSES:
            spots = np.array([(bases[i] + o, i, o) for i, n in enumerate(self.sizes) if least <= n < most
                              for o in range(n - span + 1)], dtype=np.int64).reshape(-1, 3)
            most = least
            for r in range(REPETITIONS if len(spots) else 0):
                self.tables.append(self._table(flat, spots, r, sampled_steps(r, span, samples), words_))
        self.letters = Letters([t.replace(" ", "") for t in self.texts],
                               [int(most_edits * len(t)) for t in self.texts])

    @staticmethod
    def _table(flat: np.ndarray, spots: np.ndarray, repetition: int, steps: list[int], words_: int):
        bits = _mix(flat, 1000 + repetition)
        at, key, before = spots[:, 0], np.zeros(len(spots), np.uint64), 0
        keys, told = [], np.zeros(len(spots), dtype=np.int64)
        last = np.full(len(spots), -1)
        for t in steps:
            at, before = _advance(bits, at, before, t), t
            key = _extend(key, flat[at], t)
            told += at != last
            last = at
            keys.append(key)
        # the words that an item's best key shows, if none shows enough
        best = np.zeros(int(spots[:, 1].max()) + 1, dtype=np.int64)
        np.maximum.at(best, spots[:, 1], told)
        good = told >= np.minimum(best[spots[:, 1]], words_)
        full = defaultdict(list)
        for k, (_, i, o) in zip(key[good].tolist(), spots[good].tolist(), strict=True):
            full[k].append((i, o))
        return repetition, steps, [np.unique(k[good]) for k in keys], dict(full)

    def candidates(self, hashes: np.ndarray, codes: np.ndarray) -> set[tuple[int, int]]:
        """(word position at which an item would start, item) of all windows
        that share a key, given the distinct words' hashes and the texts' words
        as numbers of these."""
        found: set[tuple[int, int]] = set()
        hashes = np.concatenate([hashes, np.zeros(1, np.uint64)])  # the word behind the last text
        codes = np.concatenate([codes, np.full(PADDING, len(hashes) - 1)])
        symbols = hashes[codes]
        # at the first step a window is known by its word: one look per distinct word
        word_key = _extend(np.zeros(len(hashes), np.uint64), hashes, 0)
        firsts = np.zeros(len(hashes), dtype=np.uint64)  # a bit for each table, which are fewer than 64
        for table, (_, _, going, _) in enumerate(self.tables):
            firsts[_known(word_key, going[0])] |= ONE << np.uint64(table)
        firsts[-1] = 0
        begins = np.flatnonzero((firsts != 0)[codes])
        begin_codes = codes[begins]
        own_firsts = firsts[begin_codes]
        bits_of = {r: _mix(hashes, 1000 + r) for r in {table[0] for table in self.tables}}
        for table, (repetition, steps, going, full) in enumerate(self.tables):
            bits = bits_of[repetition]
            own = np.flatnonzero(own_firsts & (ONE << np.uint64(table)))
            start = at = begins[own]
            key, before = word_key[begin_codes[own]], 0
            for t, known in zip(steps[1:], going[1:], strict=True):
                for step in range(before, t):
                    at = at + ((bits[codes[at]] >> np.uint64(step)) & ONE).astype(np.int64)
                before = t
                key = _extend(key, symbols[at], t)
                stay = _known(key, known)
                start, at, key = start[stay], at[stay], key[stay]
            for s, k in zip(start.tolist(), key.tolist(), strict=True):
                found.update((s - o, i) for i, o in full[k])
        return found


def least_edits(pattern: str, text: str) -> int:
    """The least edit distance between ``pattern`` and any part of ``text``,
    a column of the table for each character, held in the bits of integers."""
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    more, less, score = full, 0, m
    best = m
    for c in text:
        eq = masks.get(c, 0)
        diagonal = (((eq & more) + more) ^ more) | eq | less
        up = less | (~(diagonal | more) & full)
        down = more & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        more = down | (~(diagonal | up) & full)
        less = up & diagonal
        best = min(best, score)
    return best


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(row["text"] or "")
        if block and held + size > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    if block:
        yield block


def contained_items(documents: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``, ``item_chars`` and ``start_word``
    of every item that a document contains, at its best place."""
    spark = documents.sparkSession
    doc_kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType
    schema = (f"doc_id {doc_kind}, item_id {item_kind.simpleString()}, edits long, item_chars long, "
              "start_word long")
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(Index(block, most_edits))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for part in chunks(batch, "text", CHUNK_CHARS):
                    rows = list(_search(index, part, most_edits))
                    if rows:
                        columns = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("doc_id").take(pa.array(columns[0])),
                             pa.array([index.ids[i] for i in columns[1]]), *(pa.array(c) for c in columns[2:])],
                            names=["doc_id", "item_id", "edits", "item_chars", "start_word"])

        out = out.unionByName(documents.select("doc_id", "text").mapInArrow(search, schema))
    return out


def _search(index: Index, part: pa.RecordBatch, most_edits: float) -> Iterator[tuple]:
    ends, codes, uniques = words(part.column("text"), lower=False)
    names = plain(uniques)
    hashes = symbol_hashes(names)
    keep = (hashes != 0)[codes]
    ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    codes = codes[keep]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    by_text: dict[tuple[int, int], set[int]] = defaultdict(set)
    for start, i in index.candidates(hashes, codes):
        # the text whose window it was; an item may start before or end after its text
        middle = min(max(start + index.sizes[i] // 2, 0), len(codes) - 1)
        for doc in {int(np.searchsorted(ends, min(max(x, 0), len(codes) - 1), "right")) - 1
                    for x in (start, middle, start + index.sizes[i] - 1)}:
            by_text[doc, i].add(start)
    for (doc, i), starts in by_text.items():
        size = index.sizes[i]
        slack = 2 + size // 4
        limit = int(most_edits * len(index.texts[i]))
        checked: set[tuple[int, int]] = set()
        for start in sorted(starts):
            a, b = max(int(ends[doc]), start - slack), min(int(ends[doc + 1]), start + size + slack)
            if a >= b or (a, b) in checked:
                continue
            checked.add((a, b))
            edits = least_edits(index.texts[i], " ".join(names.take(pa.array(codes[a:b])).to_pylist()))
            if edits <= limit and (edits, start) < best.get((doc, i), (limit + 1, 0)):
                best[doc, i] = (edits, start)
            if edits == 0:
                break
    for doc, i, start, text in _letter_places(index, names, codes, ends):
        if best.get((doc, i), (1, 0))[0] > 0:
            limit = int(most_edits * len(index.texts[i]))
            edits = least_edits(index.texts[i], text)
            if edits <= limit and (edits, start) < best.get((doc, i), (limit + 1, 0)):
                best[doc, i] = (edits, start)
    for (doc, i), (edits, start) in best.items():
        yield doc, i, edits, len(index.texts[i]), max(0, start - int(ends[doc]))


def _letter_places(index: Index, names: pa.Array, codes: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
    """Text, item, first word and the part of the text in which the item must
    lie if it is near the text at a run of its letters."""
    letters = index.letters
    sizes = pc.utf8_length(names).to_numpy(zero_copy_only=False).astype(np.int64)
    behind = np.cumsum(sizes[codes])  # letters up to the end of each word
    seen: set[tuple[int, int, int]] = set()
    for first in range(0, len(codes), WORDS_AT_ONCE):
        a, b = max(0, first - AROUND), min(len(codes), first + WORDS_AT_ONCE + AROUND)
        some, base = codes[a:b], int(behind[a] - sizes[codes[a]])
        joined = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), names.take(pa.array(some)))
        symbols = _symbols(pc.binary_join(joined, pa.scalar("", names.type))[0].as_py())
        for items, offsets, places in letters.places(symbols):
            docs = np.searchsorted(ends, np.searchsorted(behind, places + base, "right"), "right") - 1
            places = places + base
            # one of each text, item and place: the first
            spots = np.stack([docs, items, (places - offsets) // NEAR], axis=1)
            one = np.sort(np.unique(spots, axis=0, return_index=True)[1])
            for i, o, p, doc in zip(items[one].tolist(), offsets[one].tolist(), places[one].tolist(), docs[one].tolist(),
                                    strict=True):
                if (doc, i, (p - o) // NEAR) in seen:
                    continue
                seen.add((doc, i, (p - o) // NEAR))
                lowest = int(behind[ends[doc] - 1]) if ends[doc] else 0
                low = max(lowest, p - o - int(letters.limits[i]) - NEAR)
                high = min(int(behind[ends[doc + 1] - 1]), p - o + int(letters.sizes[i] + letters.limits[i]) + NEAR)
                c, d = int(np.searchsorted(behind, low, "right")), int(np.searchsorted(behind, high - 1, "right"))
                words_ = names.take(pa.array(codes[c:d + 1])).to_pylist()
                words_[-1] = words_[-1][:len(words_[-1]) - (int(behind[d]) - high)]
                words_[0] = words_[0][low - (int(behind[c]) - int(sizes[codes[c]])):]
                start = int(np.searchsorted(behind, max(lowest, p - o), "right"))
                yield doc, i, start, " ".join(words_)


def decontaminated(documents: DataFrame, benchmark: DataFrame, most_edits: float = MOST_EDITS) -> DataFrame:
    """The documents that contain no item, all columns kept."""
    bad = contained_items(documents, benchmark, most_edits).select(F.col("doc_id").alias("_bad")).distinct()
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("_bad")), "left_anti")
