"""Incremental linkage over streams of records: beyond what a batch pipeline offers, from the same operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import order_free


def linked_stream(records: DataFrame, entities: DataFrame) -> DataFrame:
    """A stream of records (entity_id, country, name_core) with the S1 of the same order-free name, s1_id the smallest of them and
    owners their number; records without one have null and 0. entities: static S1 records."""
    keys = entities.groupBy("country", order_free(F.col("name_core")).alias("nk")).agg(F.min("entity_id").alias("s1_id"), F.count("*").alias("owners"))
    own = records.withColumn("nk", order_free(F.col("name_core")))
    return own.join(keys, ["country", "nk"], "left").select("entity_id", "country", "s1_id", F.coalesce("owners", F.lit(0)).alias("owners"))


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums by kind over event time, final once the watermark has passed."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def first_seen(records: DataFrame, time: str = "ts", key: str = "user_id", late: str = "2 hours") -> DataFrame:
    """Each key's first record within the watermark: repeats are dropped with bounded state."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
