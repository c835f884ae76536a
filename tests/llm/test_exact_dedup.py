import hashlib
import re

import pytest
from pyspark.sql import functions as F

from parasol.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        digest = hashlib.sha256(norm.encode()).hexdigest()
        out += [(i, keep, len(members), i == keep, digest) for i, _ in members]
    return sorted(out, key=repr)


EDGE = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n"), (7, "é" * 70000), (8, "é" * 70000),
        (9, "a b\x0c"), (None, "ab"), (10, "A b"), (11, "a b"), (12, "b"), (12, "b")]


def write(docs_of, path, rows):
    docs_of(rows).repartition(3).write.parquet(str(path))
    return str(path)


@pytest.mark.parametrize("digest", [exact_dedup.sha256,
                                    lambda t: F.substring(exact_dedup.sha256(t), 1, 1)])  # collisions galore
def test_edges_and_collisions(spark, docs_of, tmp_path, digest):
    path = write(docs_of, tmp_path / "docs", EDGE)
    got = exact_dedup.exact_duplicates(spark, path, digest=digest)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(EDGE)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = exact_dedup.exact_duplicates(spark, f"{sf}/documents.parquet")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_state_outlives_the_run(spark, docs_of, tmp_path):
    path, checkpoint = tmp_path / "docs", str(tmp_path / "state")
    write(docs_of, path, EDGE[:6])
    assert len(exact_dedup.exact_duplicates(spark, str(path), checkpoint=checkpoint).collect()) == 6
    docs_of(EDGE[6:]).write.mode("append").parquet(str(path))
    got = exact_dedup.exact_duplicates(spark, str(path), checkpoint=checkpoint)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(EDGE)
    kept = exact_dedup.deduplicated(spark, str(path))
    assert kept.columns == docs_of([]).columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(EDGE) if r[3]}


def test_many_small_batches_and_empty(spark, docs_of, tmp_path):
    path = write(docs_of, tmp_path / "docs", EDGE)
    got = exact_dedup.exact_duplicates(spark, path, batch_bytes=1)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(EDGE)
    empty = write(docs_of, tmp_path / "none", [])
    assert exact_dedup.exact_duplicates(spark, empty).collect() == []
