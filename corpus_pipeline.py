"""From raw documents to packed training sequences, one operator per stage.

Every stage takes what its predecessor kept, as written Parquet, and all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyweave.llm.bestfit import packed_documents
from skyweave.llm.decontaminate import decontaminated
from skyweave.llm.quality import quality_filtered
from skyweave.llm.queries import vocabulary
from skyweave.llm.secret_scan import without_secrets
from skyweave.llm.simhash import one_of_each_group
from skyweave.llm.texts import prepare
from skyweave.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality rules or the classifier reject."""
    return quality_filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five words, similarity 0.8)."""
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; drop texts that are mostly such."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of the texts into sequences of at most 1024 tokens."""
    return packed_documents(docs, vocabulary(), capacity=1024)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

#: SQL cannot express the classifier, XXH64 or the tokenizer; tests/llm/test_pipeline.py replays the stages instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
