"""A corpus-cleaning pipeline of the operators in tessera.llm: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import neardup, packing, ranking, secrets, toxicity
from tessera.llm.common import read, written
from tessera.runtime import sweep, tables_made


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker rejects go. It learns from labels of documents outside the held-out fifth."""
    return ranking.keep_good(docs, ranking.trained(docs, read(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier finds toxic go."""
    return toxicity.keep_clean(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that fingerprints link, the one with the smallest doc_id stays."""
    return neardup.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the secrets found in it are masked."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, keep_ids=False)


STAGES = [("quality ranking", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", neardup_stage), ("secret scan", secret_stage), ("best-fit packing", packing_stage)]

#: The stages score with trained models, link by fingerprints and tokenize, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again as the next one's input; then the tables of the
    stages before it go."""
    docs, since = read(spark, sf_dir, "documents"), tables_made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
            sweep(spark, since)
    return docs
