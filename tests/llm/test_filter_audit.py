import itertools
import re

import pytest

from parasol.llm import filter_audit as A
from tests.llm.conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"


def masks(docs, labels):
    """(part, failed letters, good, toxic) of each document."""
    first = {}
    for r in docs:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
                  "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)),
                  "E": doc_id is not None and text in first and first[text] < doc_id}
        mine = [r for r in labels if r[0] is not None and r[0] == doc_id]
        yield (lang or "", "".join(k for k, v in failed.items() if v), any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine))


def brute(docs, labels):
    rows = list(masks(docs, labels))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        sums, found = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for i, name in enumerate(order):
                gone, left = [r for r in left if name in r[1]], [r for r in left if name not in r[1]]
                failing = [r for r in mine if name in r[1]]
                sums[name] += len(gone)
                found.append(("".join(order), i + 1, name, len(left), len(gone), len(failing) - len(gone),
                              sum(r[1] == name for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(part, o, i, *rest, sums[name]) for o, i, name, *rest in found]
    return sorted(out)


def words(n, of=1000, sign=""):
    return " ".join(f"w{i % of}{sign}" for i in range(n))


EDGE = [(1, words(120), "en"), (2, words(120), "en"), (3, words(120), None), (4, None, "en"), (5, "", ""), (6, None, "de"),
        (7, "A" * 50, "de"), (8, words(200, 100), "en"), (9, words(99), "en"), (10, words(150, 1000, "#"), "en"),
        (11, words(5000), "de"), (None, words(120), "en"), (None, "x", "fr"), (12, "x", "fr"), (13, "\x1c \x85", "fr"),
        (14, words(125, 100), "en"), (14, words(125, 100), "en"), (15, words(126, 100), "en"), (16, "Ab" * 5 + "c" * 90, "en"),
        (17, "é" * 70000, "fr"), (18, "\U0001F600" * 9 + "A", "fr")]
LABELLED = [(1, 1, 0), (2, 1, 1), (3, None, 1), (7, 0, None), (8, 1, 0), (8, 0, 1), (None, 1, 1), (99, 1, 1), (10, 1, 0), (10, 1, 0)]


def tables(spark, docs, labels):
    return (spark.createDataFrame([(*r[:3], None, len(r[1] or "")) for r in docs], DOCS).repartition(3),
            spark.createDataFrame(labels, LABELS))


def test_edges(spark):
    got = A.filter_audit(*tables(spark, EDGE, LABELLED))
    assert sorted(map(tuple, got.collect())) == brute(EDGE, LABELLED)


def test_one_hot_text(spark):
    docs = [(i, words(120) if i % 3 else f"{words(130)} {i}", "en") for i in range(600)]
    got = A.filter_audit(*tables(spark, docs, []))
    assert sorted(map(tuple, got.collect())) == brute(docs, [])


def test_empty_and_clashing_columns(spark):
    docs, labels = tables(spark, [], LABELLED)
    assert A.filter_audit(docs, labels).collect() == []
    docs, labels = tables(spark, EDGE, LABELLED)
    more = docs.selectExpr("*", "'p' AS part", "1 AS mask", "2 AS digest", "3 AS first_id")
    assert sorted(map(tuple, A.filter_audit(more, labels.selectExpr("*", "1 AS good", "2 AS n")).collect())) == brute(EDGE, LABELLED)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_plain_changes_visit_every_order(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for place in A.plain_changes(n):
        order[place], order[place + 1] = order[place + 1], order[place]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert len(seen) == len(list(itertools.permutations(range(n))))


def test_swaps_keep_the_diagram():
    weights = {m: (m % 7 + 1, m % 3, m % 2) for m in range(32) if m % 5}
    diagram = A.Diagram("ABCDE", weights)

    def counts():
        """The weight of each set of failures, read off the diagram."""
        def walk(node, level, failed):
            if level == 5:
                yield failed, diagram.weight[node]
                return
            passes, fails = diagram.below[node]
            yield from walk(passes, level + 1, failed)
            yield from walk(fails, level + 1, failed | {diagram.order[level]})
        return dict(walk(diagram.root, 0, frozenset()))
    before = counts()
    assert before[frozenset("AC")] == weights.get(5, (0, 0, 0))
    for level in (0, 3, 1, 2, 0, 3, 2):
        diagram.swap(level)
        assert counts() == before
    # equal nodes are shared: of 16 on the last level three differ
    assert max(len(t) for t in A.Diagram("ABCDE", {0: (5,), 1: (2,)}).levels) == 3
