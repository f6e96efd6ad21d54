"""A training-corpus pipeline over ``documents``: five stages of lumenframe.llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a runner writes it as Parquet and reads it again as
the docs of the next stage.

1. quality_rules: documents that the rules reject go; boilerplate lines are cut from the others.  Exact copies count as
   one document here and one text keeps a frequent line, so that the next stage still finds one document of each group.
2. near_duplicates: one document of each near-duplicate group stays (the smallest id).
3. secret_scans: secrets in the texts are replaced by their kind.
4. source_mix: documents are repeated or left out so that sources meet their target weights.
5. best_fit_packing: token pieces with their place in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm.circulant import deduplicated
from lumenframe.llm.linefreq import quality_filtered
from lumenframe.llm.mixing import mixed_documents
from lumenframe.llm.packing import pack_documents
from lumenframe.llm.queries import tokenizer_path
from lumenframe.llm.secrets import redact_secrets
from lumenframe.llm.tables import bound_batches


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filtered(docs, count_copies=False)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return redact_secrets(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secret_scans", secret_stage),
    ("source_mix", mix_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenisation, near-duplicate groups and the mix's permutations have no SQL form; tests/llm/test_pipeline.py holds the
#: stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
