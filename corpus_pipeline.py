"""A training corpus in five stages: each stage's documents are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm import common, decontam, line_dedup, mixing, ngram_join, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontam.stage),
    ("source mixing", mixing.stage),
]

#: Regression and hashing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs)
    return docs
