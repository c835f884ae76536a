import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parasol.llm import context_mixing as cm


def tokens(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w] + [None]  # None: the end


def brute_base(rows):
    def crc(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 7
    counts = Counter(t for i, text in rows if crc(i) != 2 for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {i: (crc(i) == 2, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n,
                sum(math.log10((counts[x] + 1) / (n + 1 * (v + 1))) for x in tokens(t))) for i, t in rows}


def check_base(got, rows):
    want = brute_base(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = cm.score(docs, max_vocabulary=500).collect()
    assert len(got) == len(rows)
    check_base(got, rows)
    again = {r.doc_id: r.score for r in cm.score(docs, max_vocabulary=500).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-3 * abs(r.score) for r in got)


def test_better_than_counts_on_held_out_texts(spark):
    got = [r for r in cm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert 1.5 < np.median([r.bits_per_byte for r in got]) < 2.5


def tree_costs():
    rng = np.random.default_rng(1)
    tree = cm.Tree(rng.integers(1, 1000, 40))
    model = cm.Phrasing(tree, rng.integers(0, 9, 2 * tree.size), 10)
    model.load(rng.integers(0, 50, (cm.Phrasing.KINDS, 2 << 10)))
    model.mixer.weights = rng.normal(0.3, 0.2, model.mixer.weights.shape).astype(np.float32)
    return model


def test_next_word_probabilities_add_up():
    model = tree_costs()
    prefix = list(np.random.default_rng(2).integers(0, 40, 2 * cm.SEGMENT + 5))
    before = model.costs(np.array(prefix, "<u2"), np.array([0, len(prefix)]))[0]
    texts = [prefix + [w] for w in range(40)]
    flat = np.array([x for t in texts for x in t], "<u2")
    costs = model.costs(flat, np.arange(41) * len(texts[0]))
    assert sum(2.0 ** (before - c) for c in costs) == pytest.approx(1, abs=1e-3)


def test_a_text_is_scored_alike_in_any_company():
    model = tree_costs()
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 40, n) for n in (1, 3, 70, 500, 2, 64, 128)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    together = model.costs(np.concatenate(texts).astype("<u2"), offsets)
    for t, cost in zip(texts, together, strict=True):
        assert model.costs(t.astype("<u2"), np.array([0, len(t)]))[0] == pytest.approx(cost, rel=1e-5)


def test_spellings_add_up():
    """All words of up to three bytes of a small alphabet, ended or going on."""
    rng = np.random.default_rng(4)
    model = cm.Spelling(cm.Tree(rng.integers(1, 99, 257)))
    model.load(rng.integers(0, 9, (cm.Spelling.KINDS, 2 << cm.BYTE_BITS)))
    letters = [chr(i) for i in range(1, 128)]
    one = model.costs(pa.array(letters))
    assert sum(2.0 ** -c for c in one) < 1
    two = model.costs(pa.array(["q" + x for x in letters]))
    assert sum(2.0 ** -c for c in two) < 1
    mixed = model.costs(pa.array(["q", "é" * 50, "qq", "", "z" * 100000]))
    assert mixed[0] == pytest.approx(one[letters.index("q")]) and np.isfinite(mixed).all()


def test_adapting_to_the_own_past():
    model = tree_costs()
    same = np.zeros(4000, "<u2")
    cost = model.costs(same, np.array([0, 4000]))[0]
    first = model.costs(same[:64], np.array([0, 64]))[0]
    assert cost < 0.9 * first * 4000 / 64


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, "a B\tc"), (4, "the cat"), (6, "the dog " * 20000), (None, "x"), (11, " \n "),
            (12, "THE É")]
    twice = rows + [(3, "a B\tc")]
    got = cm.score(docs_of(twice)).collect()
    assert len(got) == 9
    n, v = None, None
    check = brute_base(twice)
    for r in got:
        assert r.n_tokens == check[r.doc_id][1] and r.n_known == check[r.doc_id][2]
        assert r.base_score == pytest.approx(check[r.doc_id][4])
    assert cm.score(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = cm.score(docs_of([(held, "no training texts")])).collect()
    assert alone[0].train_tokens == 0 and alone[0].base_score == 0 and alone[0].n_known == 0
