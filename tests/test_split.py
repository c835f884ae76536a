from collections import Counter

from pyspark.sql import functions as F

from parasol.operators import split as SP


def test_split_lengths():
    assert SP.split_lengths(11, (0.8, 0.1, 0.1)) == [9, 1, 1]
    assert SP.split_lengths(353, (0.8, 0.1, 0.1)) == [283, 35, 35]


def test_random_split_exact_disjoint_repeatable(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "pair_id")
    a = {r.pair_id: (r.split, r.split_rank) for r in SP.random_split(df).collect()}
    b = {r.pair_id: (r.split, r.split_rank) for r in SP.random_split(df.repartition(7)).collect()}
    assert a == b
    sizes = Counter(s for s, _ in a.values())
    assert sizes == {"train": 800, "val": 100, "test": 100}
    for name, n in sizes.items():
        assert sorted(r for s, r in a.values() if s == name) == list(range(1, n + 1))


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "pair_id").withColumn("h", SP.hash_key(7, "pair_id"))
    got = {r.pair_id: r["rank"] for r in SP.global_rank(df, [F.col("h"), F.col("pair_id")],
                                                        SP.hash_bucket(F.col("h"))).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.h, r.pair_id))
    assert got == {r.pair_id: i + 1 for i, r in enumerate(rows)}


def test_batches_short_last(spark):
    df = spark.range(0, 17).withColumnRenamed("id", "pair_id")
    b = SP.eval_batches(df, 16)
    sizes = sorted(Counter(r.batch_id for r in b.collect()).items())
    assert sizes == [(0, 16), (1, 1)]
    # two-level mean: the short batch weighs as much as the full one
    vals = b.withColumn("v", F.when(F.col("batch_id") == 1, 1.0).otherwise(0.0))
    per = vals.groupBy("batch_id").agg(F.avg("v").alias("m"))
    assert per.agg(F.avg("m")).first()[0] == 0.5


def test_epoch_shuffle_changes_order(spark):
    df = spark.range(0, 200).withColumnRenamed("id", "pair_id")
    e = SP.epoch_shuffle(df, (0, 1)).collect()
    o0 = [r.pair_id for r in sorted((r for r in e if r.epoch == 0), key=lambda r: r.epoch_rank)]
    o1 = [r.pair_id for r in sorted((r for r in e if r.epoch == 1), key=lambda r: r.epoch_rank)]
    assert sorted(o0) == sorted(o1) == list(range(200)) and o0 != o1


def test_texts_go_along_when_they_are_ranked(spark):
    """one shuffle by bucket, of the given columns only; the order is made after it, and no join by id follows."""
    from hashlib import md5
    df = spark.range(5000).select(F.col("id").alias("pair_id"), F.concat(F.lit("text "), "id").alias("toxic"))
    b = SP.eval_batches(df, 16, task_rows=400)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan.split("RepartitionByExpression", 1)[1].split("\n")
    assert " AS _h" not in plan and "md5" in plan.split("RepartitionByExpression", 1)[0]
    tasks = max(13, spark.sparkContext.defaultParallelism)     # 5,000 rows, 400 to a task
    assert "_bucket" in dealt[0] and f", {tasks}" in dealt[0]
    assert plan.count("Join") == 1                            # the buckets' offsets
    order = sorted(range(5000), key=lambda i: md5(f"42:{i}".encode()).hexdigest())
    rows = b.withColumn("n_rows", SP.batch_rows("batch_id", 5000)).withColumn("task", F.spark_partition_id()).collect()
    assert {r.pair_id: r.batch_id for r in rows} == {k: i // 16 for i, k in enumerate(order)}
    assert all(r.toxic == f"text {r.pair_id}" and r.n_rows == (8 if r.batch_id == 312 else 16) for r in rows)
