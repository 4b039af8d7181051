"""What the operators of this subpackage share: table access, Arrow batches, shared storage."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship, written

__all__ = ["held_out", "labelled_sample", "map_arrow", "process_memory", "read", "ship", "strings", "written"]

#: Rows and bytes that a function gets at once; a row that is larger by itself comes alone.
BATCH_ROWS, BATCH_BYTES = 256, 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small batches: of BATCH_ROWS rows, and of about BATCH_BYTES, to which the session's bound is lowered.

    While a partition is read, Python's cycle collector rests: these functions make many small lists and no cycles, and the
    collector would go through them again and again. What the last partition's functions held goes at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from fn(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(1, b.num_rows), BATCH_ROWS))
        finally:
            gc.collect(0)
            gc.enable()

    spark = df.sparkSession
    ship(spark)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES)) > BATCH_BYTES:
        spark.conf.set(_BYTES, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


_memory: dict[str, dict] = {}


def process_memory(owner: str) -> dict:
    """What an operator remembers in this process between partitions. One operator's memory is held at a time: a process that goes over to
    another stage of a pipeline drops what the stage before has remembered."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = {}
    return _memory[owner]


def strings(batch: pa.RecordBatch, i: int) -> list[str]:
    """Column i as strings, null as empty."""
    return [t or "" for t in batch.column(i).to_pylist()]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Up to 2 * per_class labelled documents as (doc_id, y, text): of each class the rows with the lowest hashes of doc_id.

    Rows of the held-out fifth and null ids or labels take no part; several labels of an id count as the largest, as do
    several texts. The ids that are sent to the join are bounded by the two limits, and so is the result.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id", F.lit(label)))
    one = [rows.filter(F.col("y") == y).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    ids = one[0].unionByName(one[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
