import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parasol.llm import toxicity


def brute_logit(machine, text):
    rows = sorted({r for w in (text or "").split() if (r := toxicity.term_bucket(w)) >= 0})
    z = machine.bias + sum(float(machine.weights[r]) for r in rows)
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            z += float(machine.factors[a].astype(float) @ machine.factors[b].astype(float))
    return z


def test_logits_are_the_pair_sums():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(-1.0, rng.normal(size=toxicity.BUCKETS).astype(np.float32),
                         rng.normal(size=(toxicity.BUCKETS, toxicity.FACTORS)).astype(np.float32))
    texts = ["One two, three!", "one ONE one", None, "", "  ... ", "x " * 5000, "à la carte"]
    got = m.logits(*toxicity.term_sets(pa.array(texts, pa.string()), {}))
    assert np.allclose(got, [brute_logit(m, t) for t in texts], atol=1e-4)


def test_learns_a_pair_that_weights_alone_miss():
    rng = random.Random(1)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["insult"] * a + ["group"] * b + [f"w{rng.randrange(400)}" for _ in range(8)]))
        labels.append(float(a == b))  # no weight for either word tells this
    sets = toxicity.term_sets(pa.array(texts), {})
    m = toxicity.Machine().fit(*sets, np.array(labels))
    predicted = m.logits(*sets) > 0
    assert (predicted == np.array(labels, bool)).mean() > 0.95


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").select("held_out", "predicted", "toxic").collect()
    assert got.count() == docs.count()
    hits = sum(r.predicted and r.toxic for r in rows if r.held_out)
    assert hits / sum(r.predicted for r in rows if r.held_out) > 0.9
    assert hits / sum(r.toxic for r in rows if r.held_out) > 0.7


def test_edges(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "idiot " * 30000), (3, "idiot " * 30000), (None, "you")]
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs_of(rows), labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(docs_of(rows), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.5}
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    held = {r.doc_id: r.held_out for r in got}
    import zlib
    assert all(held[i] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) for i in held)
    clash = docs_of(rows).withColumn("score", F.lit("x")).withColumn("terms", F.lit(1))
    assert toxicity.toxicity(clash, labels).columns == ["doc_id", "held_out", "score", "predicted"]
