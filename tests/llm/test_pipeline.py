from collections import Counter

import pytest

import corpus_pipeline as cp
from parasol.llm import decontamination, language_id, mixing, sharding, simhash


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The rows that each stage returned."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.collect())
    for _, stage in cp.STAGES:
        made = stage(spark, docs, sf)
        rows = made.collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, made.schema)
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns(steps):
    for rows in steps[:-1]:
        assert rows[0].__fields__ == cp.DOCUMENT_COLUMNS
    assert set(steps[-1][0].__fields__) == {*cp.DOCUMENT_COLUMNS, "shard"}


def test_language_keeps_clean_documents(steps):
    gone = set(ids(steps[0])) - set(ids(steps[1]))
    texts = {r.doc_id: r.text for r in steps[0]}
    assert len(gone) <= 0.01 * len(texts)
    assert all(any(c.isalpha() for c in texts[i] or "") for i in ids(steps[1]))


def test_near_duplicates_against_brute_force(steps):
    from tests.llm.test_simhash import brute_components, brute_fingerprint
    groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in steps[1]})
    assert ids(steps[2]) == sorted(i for i, c in groups.items() if i == c)


def test_decontamination_against_brute_force(spark, sf, steps):
    from tests.llm.test_decontamination import plain
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: plain(r.text) for r in steps[2]}
    gone = set(ids(steps[2])) - set(ids(steps[3]))
    whole = {i for i, t in texts.items() if any(f" {p} " in f" {t} " for p in items)}
    assert whole <= gone
    for i in gone:
        assert any(decontamination.least_edits(p, texts[i]) <= 0.2 * len(p) for p in items)


def test_mix_meets_targets(steps):
    sizes = {r.doc_id: (r.source, len(r.text.split())) for r in steps[3]}
    by, took = Counter(), Counter()
    for s, n in sizes.values():
        by[s] += n
    counts = Counter(r.doc_id for r in steps[4])
    for i, n in counts.items():
        assert n <= 2
        took[sizes[i][0]] += n * sizes[i][1]
    names = sorted(by)
    for name, goal in zip(names, mixing.targets([by[n] for n in names]), strict=True):
        biggest = max(n for s, n in sizes.values() if s == name)
        assert abs(took[name] - goal) <= biggest / 2 + 1


def test_shards(steps):
    assert len(steps[5]) == len(steps[4])
    assert {r.shard for r in steps[5]} <= set(range(cp.N_SHARDS))
    assert len({(r.doc_id, r.shard) for r in steps[5]}) == len({r.doc_id for r in steps[5]})


def test_run_and_names(spark, sf, steps):
    assert ids(cp.run(spark, sf).collect()) == ids(steps[-1])
    uses = {"language_id": language_id, "simhash_near_dedup": simhash, "decontamination": decontamination,
            "mixing": mixing, "sharding": sharding}
    assert [n for n, _ in cp.STAGES] == list(uses)


def test_empty_and_odd_tables(spark, sf, docs_of):
    from pyspark.sql import functions as F
    for rows in ([], [(1, None), (2, ""), (2, ""), (None, "the cat"), (4, "the dog " * 40000)]):
        docs = docs_of(rows).withColumn("shard", F.lit("x")).withColumn("component_id", F.lit(1))
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() <= 2 * len(rows)
