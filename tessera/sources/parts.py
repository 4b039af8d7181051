"""Feature tables that lie in several folders, one row a pair in each: columns of all of them side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAIR = ["s1_id", "cand_id"]


def read_parts(spark: SparkSession, folders: list[str], key: list[str] | None = None) -> DataFrame:
    """The rows of the first folder with the further columns of the others, joined by key (the pair by default). Of columns
    of one name, whatever its case, the first folder's counts. A pair that a later folder lacks has nulls there; a pair that
    is repeated in a later folder is an error of that folder and repeats the row."""
    key = key or PAIR
    out = spark.read.parquet(folders[0])
    for folder in folders[1:]:
        had = {c.lower() for c in out.columns}
        more = spark.read.parquet(folder)
        new = [c for c in more.columns if c.lower() not in had]
        out = out.join(more.select(*key, *new), key, "left") if new else out
    return out
