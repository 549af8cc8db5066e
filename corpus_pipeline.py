"""The corpus pipeline: five filtering and mixing stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame, which is written as Parquet in the shared folder and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardlore.llm import curriculum, langid, line_runs, minhash, positional
from shardlore.llm.common import read_table, staged

STAGES = [
    ("language_id", langid.language_stage),
    ("line_dedup", line_runs.dedup_stage),
    ("minhash_near_dedup", minhash.dedup_stage),
    ("benchmark_decontamination", positional.decontaminate_stage),
    ("source_mixing", curriculum.mixing_stage),
]
#: SQL can't express the language model of the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
