import zlib
from collections import Counter, defaultdict

import pytest

from parasol.llm import sharding


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = sharding.shard_records(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard == 8 for r in rows)
    assert 0 < moved < 3 * len(rows) / 9


def test_numbering_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP_ROWS", 7)
    df = spark.range(1000).selectExpr("id", "if(id < 700, 0, id % 3) AS g", "'x' AS slot")
    got = sharding.number_within(df, "g", ["id"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.g].append(r.slot)
    assert sum(map(len, by.values())) == 1000
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_weights(spark):
    df = spark.range(40000).withColumnRenamed("id", "k")
    got = Counter(r.shard for r in sharding.assign_shards(df, ["k"], [1.0, 3.0]).collect())
    assert abs(got[1] / 40000 - 0.75) < 0.02


def test_edges(docs_of):
    rows = [(None, None), (None, "a"), (3, ""), (3, ""), (4, "é" * 100000)]
    got = sharding.shard_records(docs_of(rows)).collect()
    assert len(got) == 5
    assert {r["size"] for r in got if r.text_crc32 == 0} == {1}
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert [r["size"] for r in got if r.doc_id == 4] == [200001]
    assert sharding.shard_records(docs_of([])).count() == 0
    clash = docs_of(rows).withColumnRenamed("lang", "shard").withColumnRenamed("source", "GROWN_SHARD")
    out = sharding.assign_shards(clash, ["doc_id"], [1.0] * 4, [1.0] * 5)
    assert sorted(out.columns) == sorted(["doc_id", "text", "n_chars", "shard", "grown_shard"])
    with pytest.raises(ValueError):
        sharding.assign_shards(clash, ["doc_id"], [])
