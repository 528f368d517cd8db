"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Paths handed out by this process.
_OWN: list[str] = []


def build_session(app: str = "feltmill", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `master` is left to spark-submit when not given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local master may run without the setting; it then gets a fresh temporary folder, and the
    same folder is handed out for the life of the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="feltmill-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, never reused path below the shared folder."""
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    _OWN.append(path)
    return path


def drop_stored(spark: SparkSession) -> int:
    """Deletes what this session has stored so far, once results that read it are written; gives how many folders."""
    return _delete(spark, 0)


def _delete(spark: SparkSession, left: int) -> int:
    """Deletes paths handed out until only the first `left` remain; gives how many folders."""
    gone, jvm = 0, spark._jvm
    while len(_OWN) > left:
        path = jvm.org.apache.hadoop.fs.Path(_OWN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and a lost executor costs one re-read."""
    path = scratch_path(df.sparkSession, label)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end; for steps whose results have been collected by then."""
    before = len(_OWN)
    yield
    _delete(spark, before)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of `make()` as a table; whatever it stored on its way to them is deleted.

    For steps whose result is small beside their intermediate tables. No frame made inside may be used afterwards.
    """
    before = len(_OWN)
    done = stored(make(), label)
    last = _OWN.pop()
    _delete(spark, before)
    _OWN.append(last)
    return done
