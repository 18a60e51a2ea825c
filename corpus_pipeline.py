"""From raw documents to a training mix, in stages that each read what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinline.llm import stages
from twinline.session import written
from twinline.shipping import ship


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _shipped(stages.drop_toxic)),
    ("line_dedup", _shipped(stages.drop_repeated_lines)),
    ("ngram_jaccard_join", _shipped(stages.one_of_each_group)),
    ("benchmark_decontamination", _shipped(stages.drop_contaminated)),
    ("mixing", _shipped(stages.mix_sources)),
]

# A trained score decides in the first stage, which SQL can't express; tests compare the rows and columns of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
