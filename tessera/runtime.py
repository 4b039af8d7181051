"""What operators need of the cluster: this package on the executors, and tables in the shared folder."""

from __future__ import annotations

import gc
import os
import shutil
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipping = threading.Lock()


def ship(spark: SparkSession | None = None) -> None:
    """Hands this package to the executors' Python, which may not have it installed, once for each application.

    Without an active session it does nothing."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc, package = spark.sparkContext, Path(__file__).resolve().parent
    with _shipping:  # steps that run side by side may both come first
        if not getattr(sc, "_tessera_shipped", False):
            sc.addPyFile(shutil.make_archive(os.path.join(sc._temp_dir, package.name), "zip", package.parent, package.name))
            sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Its own is set only where none is named and all runs on this machine, as in tests;
    a cluster that names none is an error, since its machines would not see each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(spark.sparkContext._temp_dir, "checkpoints")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _own(spark: SparkSession) -> str:
    """This application's tables in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


#: Places of the tables written so far that still stand, and the folders that go when their application ends.
_made: list[str] = []
_ending: set[str] = set()
#: Those that this thread wrote inside passing().
_inside = threading.local()


def _filesystem(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in this application's folder, which goes when the application ends."""
    own = _own(spark)
    if own not in _ending:
        path, files = _filesystem(spark, own)
        files.deleteOnExit(path)
        _ending.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is worked out once, cuts lineage and outlives lost executors.

    The table stays until sweep(), clear() or the application's end, since results that are read later may depend on it.
    """
    spark = df.sparkSession
    at = scratch(spark, name)
    _made.append(at)
    if getattr(_inside, "made", None) is not None:
        _inside.made.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Seconds that passing() leaves between two of its releases, so that many small tables don't wait for collectors; the time of the last release.
RELEASE_S, _released = 10, [0.0]


def release(spark: SparkSession) -> None:
    """Gives the disk of shuffles back that nothing refers to any more, as those behind a table that has been written.

    Spark removes them when the driver's collector finds them gone, which may else be long after the disk is full."""
    _released[0] = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What this thread has written() inside goes at the end, when the result of it must be stored, and the disk of shuffles with it."""
    outer, _inside.made = getattr(_inside, "made", None), []
    try:
        yield
    finally:
        own, _inside.made = _inside.made, outer
        for at in own:
            path, files = _filesystem(spark, at)
            files.delete(path, True)
            if at in _made:
                _made.remove(at)
        if time.monotonic() - _released[0] > RELEASE_S:
            release(spark)


def sweep(spark: SparkSession, since: int) -> None:
    """Removes what was written() after the first `since` tables but the last one, which holds the result of the others."""
    for at in _made[since:-1]:
        path, files = _filesystem(spark, at)
        files.delete(path, True)
    del _made[since:-1]


def tables_made() -> int:
    """The number of tables that stand: where sweep() may start later."""
    return len(_made)


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has written(), once its results are stored."""
    path, files = _filesystem(spark, _own(spark))
    files.delete(path, True)
    _made.clear()


def stored(spark: SparkSession, at: str) -> bool:
    """Whether a table was written there to its end."""
    path, files = _filesystem(spark, f"{at}/_SUCCESS")
    return files.exists(path)


def loose(df: DataFrame) -> DataFrame:
    """An aggregated table for joins on its own keys, without its partitioning.

    A join would otherwise take the aggregate's partitioning over, and adaptive execution could not split a key that holds
    very many rows of the other side. The table itself has a row for each key.
    """
    return df.hint("rebalance")
