"""Density simulation: clones of unmatched records, and features in which a clone and its original are one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import original_id

PAIR = ["s1_id", "cand_id"]


def clone_pool(records: DataFrame, truth: DataFrame, factor: int = 2) -> DataFrame:
    """records (entity_id as a string) and factor - 1 clones, id#dK, of each record of other sources without an owner."""
    own = records.withColumn("entity_id", F.col("entity_id").cast("string"))
    matched = truth.select(F.col("cand_id").cast("string").alias("entity_id")).distinct()
    free = own.filter("src <> 1").join(matched, "entity_id", "left_anti")
    numbers = F.explode(F.sequence(F.lit(1), F.lit(factor - 1))) if factor > 1 else F.explode(F.array().cast("array<int>"))
    clones = free.withColumn("_k", numbers).withColumn("entity_id", F.concat("entity_id", F.lit("#d"), "_k")).drop("_k")
    return own.unionByName(clones.select(own.columns))


def detwinned(scored: DataFrame, context: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Context features of scored edges with clones collapsed on their originals (largest prob), joined back to every edge."""
    own = scored.withColumn("_o", original_id(F.col("cand_id")))
    merged = own.groupBy("s1_id", F.col("_o").alias("cand_id")).agg(F.max("prob").alias("prob"))
    made = context(merged).drop("prob").withColumnRenamed("cand_id", "_o")
    return own.join(made, ["s1_id", "_o"], "left").drop("_o")


def reused_logits(wanted: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of wanted pairs those whose original's logit is known, with ce_logit, and those to score. known: s1_id, cand_id, ce_logit."""
    own = wanted.withColumn("_o", original_id(F.col("cand_id")))
    table = known.select("s1_id", F.col("cand_id").cast("string").alias("_o"), "ce_logit")
    return own.join(table, ["s1_id", "_o"]).select(*PAIR, "ce_logit"), own.join(table, ["s1_id", "_o"], "left_anti").select(*PAIR)
