"""Design rules checked on every registered query's physical plan."""

from parasol.plans import queries as Q
from parasol.plans.queries import queries

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
# these run their work while being built (stream, model fit) and return a plain parquet read
SKIP = {"stream_rewrite", "stream_running_loss", "toxicity_judge_ml", "stream_rewrite_text", "stream_newest_lexicon",
        "stream_batch_metrics", "resumed_judge"}


def test_no_cartesian_nested_loop_or_row_python(spark, sf):
    bad = {}
    Q._MEMO = {}      # all queries share their derived tables and models, which are built once
    try:
        for name, q in Q.REGISTRY.items():
            if name in SKIP:
                continue
            plan = Q.normalize_types(q(spark, sf))._jdf.queryExecution().executedPlan().toString()
            hits = [f for f in FORBIDDEN if f in plan]
            if hits:
                bad[name] = hits
    finally:
        Q._MEMO = None
    assert bad == {}


def test_metrics_plan_only_what_is_asked(spark, sf):
    def plan(name):
        return queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for name in ("style_accuracy", "fluency", "similarity_batch", "similarity_pair"):
        assert "MapInPandas" not in plan(name) and "MapInArrow" not in plan(name), name
    match = plan("bert_score")
    assert "Exchange" not in match and "ArrowEvalPython" in match
