"""The corpus pipeline: documents in, a mixed and sharded corpus out.

``STAGES`` are applied in order; each gets what its predecessor kept, written
as Parquet and read again. All but the last return the columns of documents.

1. language ID: texts without letters and texts whose language the model does
   not tell with at least half of the odds go;
2. SimHash near-dedup: of each group of near copies the smallest doc_id stays;
3. benchmark decontamination: documents that contain a benchmark item go;
4. mixing: whole documents are repeated or left out until each source has
   about its target of words;
5. sharding: every row gets the shard of its key.

Edge cases: null and blank texts are rejected by the first stage; a document
that the mix takes twice is two rows, which share a shard; empty tables give
empty results; other columns than those of documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parasol.llm import decontamination, language_id, mixing, sharding, simhash
from parasol.llm.common import DOCUMENT_COLUMNS, read_table, stored

#: models, bit sampling and random permutations have no SQL form; tests compare with brute force
ORACLE_SQL = None
N_SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs.select(*DOCUMENT_COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, ["doc_id"], [1.0] * N_SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
