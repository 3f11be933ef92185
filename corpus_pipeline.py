"""A training corpus from raw documents: each stage applies one operator to all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talewind.llm.common import prepare
from talewind.llm.jaccard import near_duplicates, one_of_each
from talewind.llm.latent import clean_documents, leaks
from talewind.llm.packing import packed_pieces
from talewind.llm.pii import redacted
from talewind.llm.quality import judged, kept_documents
from talewind.llm.tokens import public_path
from talewind.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return kept_documents(docs, judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs, near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return clean_documents(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packed_pieces(docs, public_path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicate_join), ("benchmark decontamination", decontamination),
    ("PII", private_data), ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
