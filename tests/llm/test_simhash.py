import random

import numpy as np
import xxhash

from parasol.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(fps)
    assert got == {i: (fps[i], want[i]) for i in fps}


def test_edges(docs_of):
    rows = [(5, None), (3, ""), (9, " \t\n"), (1, "One two"), (2, "one\vTWO"), (4, "x " * 30000), (4, "x " * 30000)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    by = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in got}
    assert len(got) == len(rows)
    assert by[5] == by[3] == by[9] == (0, 3)
    assert by[1] == by[2] == (brute_fingerprint("one two"), 1)
    assert by[4][1] == 4
    kept = simhash.one_per_group(docs_of(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 4]
    assert kept.columns == docs_of(rows).columns
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_trie_finds_every_close_pair(spark, monkeypatch):
    rng = random.Random(3)
    fps = set()
    for _ in range(300):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(3):
            for k in rng.sample(range(64), rng.randint(1, 6)):
                base ^= 1 << k
            fps.add(base)
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "SUBTREE", 16)  # so that prefixes differ, too
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from parasol.llm.components import connected_components
    links = simhash.trie_links(df, len(fps))
    got = {r.node % (1 << 64): r.component % (1 << 64) for r in connected_components(links, "a", "b").collect()}
    want = brute_components(dict(enumerate(fps)))
    classes = {}
    for i, c in want.items():
        classes.setdefault(c, set()).add(fps[i])
    for members in classes.values():
        assert len({got.get(f, f) for f in members}) == 1
    assert len({got.get(f, f) for f in fps}) == len(classes)


def test_long_chain_and_star(spark):
    from parasol.llm.components import connected_components
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, 1000 + i) for i in range(1, 500)]
    edges = spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(401)}, **{1000 + i: 1000 for i in range(500)}}
