import random

import numpy as np
import pyarrow as pa

from parasol.llm import decontamination as dc


def plain(text):
    return " ".join(w for w in dc.plain(pa.array((text or "").split(), pa.string())).to_pylist() if w)


def brute_edits(pattern, text):
    """Least edit distance to any part of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        b = "".join(rng.choices("abcd", k=rng.randint(0, 40)))
        assert dc.least_edits(a, b) == brute_edits(a, b)


def edited(words, rate, vocabulary, rng):
    words = list(words)
    for _ in range(max(1, int(rate * len(words)))):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[i] = rng.choice(vocabulary)
        elif kind == 1:
            words.insert(i, rng.choice(vocabulary))
        elif len(words) > 3:
            del words[i]
    return words


def test_recall_against_brute_force(spark, sf):
    rng = random.Random(3)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    vocabulary = " ".join(r.text for r in docs.limit(50).collect()).split()
    rows, texts = [], {r.item_id: r.text for r in items.collect()}
    for i, text in texts.items():
        for rate in (0, 0.1, 0.2):
            passage = edited(text.split(), rate, vocabulary, rng) if rate else text.split()
            rows.append((len(rows), " ".join(rng.choices(vocabulary, k=30) + passage + rng.choices(vocabulary, k=9))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contained_items(df, items).collect()}
    want = {}
    names = {i: plain(t) for i, t in texts.items()}
    for doc, text in rows:
        i = list(texts)[doc // 3]
        edits = dc.least_edits(names[i], plain(text))
        if edits <= int(0.2 * len(names[i])):
            want[doc, i] = edits
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[k] == want[k] for k in got)
    assert all((3 * n, i) in got for n, i in enumerate(texts))  # what is whole is always found


def test_no_false_finds_in_the_whole_table(spark, sf):
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = {r.doc_id: plain(r.text) for r in docs.collect()}
    found = dc.contained_items(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert found
    for r in found:
        assert dc.least_edits(items[r.item_id], names[r.doc_id]) == r.edits <= 0.2 * r.item_chars
    exact = {(d, i) for d, t in names.items() for i, p in items.items() if f" {p} " in f" {t} "}
    assert exact <= {(r.doc_id, r.item_id) for r in found}


def test_edges(spark, docs_of, monkeypatch):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "!!! ..."), (5, "zebra"), (6, "red fox ran"),
                                   (7, item)], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, item.upper().replace(" ", "  \n")), (3, item), (4, "the red fox, ran"),
            (5, "x " * 50000 + item + " y" * 50000), (6, "one two three four"), (None, "a Zebra!"), (7, "clean text")]
    want = {(3, 1), (3, 7), (4, 6), (5, 1), (5, 7), (None, 5)}
    for block in (dc.BLOCK_CHARS, 1):  # one block of items, or one for each
        monkeypatch.setattr(dc, "BLOCK_CHARS", block)
        got = dc.contained_items(docs_of(rows), items).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        assert sum(r.doc_id == 3 and r.item_id == 1 for r in got) == 2
    left = dc.decontaminated(docs_of(rows), items)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 6, 7]
    assert left.columns == docs_of([]).columns
    assert dc.contained_items(docs_of([]), items).count() == 0
    assert dc.decontaminated(docs_of(rows), items.limit(0)).count() == len(rows)
    assert np.array_equal(dc.Index([]).candidates(np.zeros(0, np.uint64), np.zeros(0, np.int64)), set())


def test_recall_of_letter_edits_against_brute_force(spark, sf):
    rng = random.Random(6)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.item_id: plain(r.text) for r in items.collect()}
    around = plain(" ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(20).collect())).split()
    rows = []
    for text in texts.values():
        for rate in (0.1, 0.15, 0.19):
            letters = [c if c == " " or rng.random() >= rate else rng.choice("abcdefghijklmnopqrstuvwxyz") for c in text]
            rows.append((len(rows), " ".join(rng.choices(around, k=30)) + f" {''.join(letters)} " + rng.choice(around)))
        rows.append((len(rows), text.replace(" ", "")))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contained_items(df, items).collect()}
    want = {}
    for doc, text in rows:
        i = list(texts)[doc // 4]
        edits = dc.least_edits(texts[i], plain(text))
        if edits <= int(0.2 * len(texts[i])):
            want[doc, i] = edits
    found = {k: got[k] for k in want if k in got}
    print(len(found), len(want))
    assert len(found) >= 0.97 * len(want) and all(want[k] == e for k, e in found.items())


def test_words_are_mixed_once_a_repetition(monkeypatch):
    rng = random.Random(31)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n)) for n in (1, 2, 3, 4, 6, 14, 30)]
    index = dc.Index(list(enumerate(texts)))
    assert len(index.tables) > 4 * dc.REPETITIONS
    ends, codes, uniques = dc.words(dc.pa.array([" ".join(texts) + " and more words"]), lower=False)
    mixed, mix = [], dc._mix
    monkeypatch.setattr(dc, "_mix", lambda h, salt: mixed.append(salt) or mix(h, salt))
    found = index.candidates(dc.symbol_hashes(dc.plain(uniques)), codes)
    assert {i for _, i in found} == set(range(len(texts)))
    assert sum(salt >= 1000 for salt in mixed) == dc.REPETITIONS
    assert dc._known(np.array([1, 5, 9, 70000], np.uint64), np.array([5, 9, 65545], np.uint64)).tolist() == [1, 2]
    assert dc._known(np.array([1], np.uint64), np.zeros(0, np.uint64)).tolist() == []
