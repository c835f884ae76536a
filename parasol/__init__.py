"""parasol: parallel-text preparation, rewriting and scoring as Spark jobs.

Everything is a DataFrame plan: pairs are loaded, encoded, split and batched
with relational operators; judges, lexicons and bigram models are fitted as
aggregations into small model tables; metrics are two-level group-bys.
"""

from parasol.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
