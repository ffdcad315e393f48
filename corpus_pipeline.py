"""The corpus pipeline: five stages over ``documents``, each on all that the one
before it kept, each writing Parquet that the next one reads.

Every stage calls one operator of ``namespotter.llm``.  All but the last return
the columns of ``documents``; the last returns the pieces of the packed corpus.
Null and empty texts are documents like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from namespotter.llm import decontaminate, packing, quality, secrets, simhash
from namespotter.llm.common import table
from namespotter.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go."""
    return quality.trusted_only(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component stays, the one of the smallest id."""
    return simhash.first_of_each_group(docs, size=3, radius=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay; secrets in their texts are replaced by a mark."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all rows in sequences of 2048."""
    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]

#: No stage but decontamination can be said in SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus; every stage's result lies in the shared folder meanwhile."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
