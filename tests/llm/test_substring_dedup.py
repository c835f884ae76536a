import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parasol.llm import substring_dedup as S

WORD = r"[^\x20\x09-\x0D]+"


def gone(rows):
    """Of each row its words and which of them go, by counting all windows."""
    split = [re.findall(WORD, t or "") for _, t in rows]
    windows = Counter(tuple(w[p:p + 35]) for w in split for p in range(len(w) - 34))
    out = []
    for w in split:
        bad = [False] * len(w)
        for p in range(len(w) - 34):
            if windows[tuple(w[p:p + 35])] > 1:
                bad[p:p + 35] = [True] * 35
        out.append((w, bad))
    return out


def brute(rows):
    return sorted(((i, len(w), sum(bad), hashlib.sha256(" ".join(x for x, b in zip(w, bad) if not b).encode()).hexdigest())
                   for (i, _), (w, bad) in zip(rows, gone(rows))), key=repr)


def check(docs_of, rows):
    assert sorted(map(tuple, S.substring_dedup(docs_of(rows).repartition(3)).collect()), key=repr) == brute(rows)


def prose(rng, n, of=5000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def corpus(seed):
    """Texts that share passages of all lengths about the threshold, with neighbours that agree by chance."""
    rng = random.Random(seed)
    passages = [prose(rng, n) for n in (12, 20, 33, 34, 35, 36, 40, 58, 59, 70, 200)]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randrange(0, 80), of=rng.choice([3, 5000]))
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(0, 6)
            words += p[cut:len(p) - rng.randrange(0, 6)] + prose(rng, rng.randrange(0, 50))
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shared_passages(docs_of, seed):
    check(docs_of, corpus(seed))


def test_edges(docs_of):
    rng = random.Random(9)
    a, b = prose(rng, 35), prose(rng, 34)
    long = prose(rng, 30000, of=40000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, " ".join(a)), (5, "\n".join(a)), (6, " ".join(b)), (7, " ".join(b)),
            (8, "x " * 34), (9, "y " * 35), (10, "z " * 36), (11, "ab " * 200), (12, " ".join(["p", "q", "r"] * 40)),
            (13, " ".join(long)), (14, " ".join(prose(rng, 10) + long[20000:20040] + prose(rng, 10))),
            (15, " ".join(prose(rng, 5) + a[:34])), (16, " ".join(a + prose(rng, 3) + a)), (17, " ".join(w.upper() for w in a)),
            (18, "\x85".join(a)), (19, "é" * 50000), (None, " ".join(prose(rng, 60))), (None, " ".join(prose(rng, 60))),
            (20, " ".join(a)), (20, " ".join(a)), (21, " ".join(long[:100])), (21, " ".join(prose(rng, 50)))]
    check(docs_of, rows)


def test_crowds(docs_of):
    """One text many times, a template with a number in it, and a line in all texts."""
    rng = random.Random(4)
    head, tail, line = prose(rng, 40), prose(rng, 45), prose(rng, 37)
    rows = [(i, " ".join(prose(random.Random(7), 90))) for i in range(300)]
    rows += [(1000 + i, " ".join(head + [f"n{i}"] + tail)) for i in range(300)]
    rows += [(2000 + i, " ".join(prose(rng, 40) + line + prose(rng, 40))) for i in range(300)]
    check(docs_of, rows)


def test_spans_and_texts(spark, docs_of):
    rows = corpus(5) + [(500, None), (501, "left  as\tit is"), (502, "k " * 50)] + [(600 + i, " ".join(f"c{j}" for j in range(50))) for i in range(2)]
    docs = docs_of(rows)
    want, texts = set(), {}
    for (i, text), (words, bad) in zip(rows, gone(rows)):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], np.array(bad, dtype=int), [0]])))
        want |= {(i, int(x), int(y - x)) for x, y in zip(edges[::2], edges[1::2])}
        texts[i] = " ".join(w for w, b in zip(words, bad) if not b) if any(bad) else text or ""
    assert {tuple(r) for r in S.maximal_repeats(docs).collect()} == want
    assert all(n >= 35 for _, _, n in want)
    assert {r.doc_id: r.text for r in S.deduplicated_texts(docs).collect()} == texts


def test_empty_and_clashing_columns(spark, docs_of):
    assert S.substring_dedup(docs_of([])).collect() == []
    rows = corpus(6)[:40]
    more = docs_of(rows).selectExpr("*", "1 AS d", "2 AS h", "3 AS whole", "4 AS n_words", "5 AS key", "6 AS runs")
    assert sorted(map(tuple, S.substring_dedup(more).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 8, 24, 31])
def test_least_in_window(width):
    values = np.random.default_rng(width).integers(0, 6, 60).astype(np.uint64)
    want = [max(p + j for j in range(width) if values[p + j] == values[p:p + width].min()) for p in range(60 - width + 1)]
    assert S.least_in_window(values, width).tolist() == want


def test_equal_windows_have_equal_seeds():
    """Whatever stands around a window, its seed is at the same place in it."""
    rng = random.Random(3)
    common = prose(rng, 35, of=4)
    texts = [" ".join(prose(rng, rng.randrange(30), of=4) + common + prose(rng, rng.randrange(30), of=4)) for _ in range(50)]
    hashes = S.Hashes(pa.array(texts))
    seeds, found = S.Seeds(hashes), set()
    for i, text in enumerate(texts):
        words = text.split()
        at = next(p for p in range(len(words)) if words[p:p + 35] == common)
        mine = [k for k in range(len(seeds.a)) if seeds.text[k] == i and 0 <= at + hashes.ends[i] - seeds.a[k] < seeds.m[k]]
        assert len(mine) == 1
        found.add(int(seeds.h[mine[0]]))
    assert len(found) == 1
