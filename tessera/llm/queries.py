"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, media, neardup, packing, ranking, resync, secrets, toxicity
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op2_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return ranking.scored(docs, ranking.trained(docs, read(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync.count_tokens(read(spark, sf_dir, "documents"))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(neardup.near_duplicates(read(spark, sf_dir, "documents")))


def op6_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), keep_ids=False)


def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.conversations_with_probe(read(spark, sf_dir, "conversations"))
    return chat.digest(chat.format_conversations(turns))


def op10_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_pairwise_quality, op3_token_counts, op4_media_chunks, op5_simhash_neardup, op6_adaptive_ann, op7_byte_bpe, op8_packing, op9_chat_masks, op10_toxicity_cnn)
}

#: DuckDB SQL with the same rows, where SQL can express an operator.
ORACLES: dict[str, str] = {}
