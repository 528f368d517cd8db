"""Helpers that several operators share."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feltmill.session import stored

#: Stands for a missing doc_id where ids are compared: it comes after every id.
LAST_ID = 2**63 - 1

#: A side of at most so many rows may be broadcast; the rows are counted before the plan is made.
BROADCAST_ROWS = 2_000_000

#: Texts go to Python workers in Arrow batches of at most about so many bytes.
BATCH_BYTES = "4m"

#: White space of ASCII, as a set of characters to strip and as the inside of a pattern.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, unless the session names a bound itself.

    The default bounds are 10,000 rows or 64 MB; a batch of texts is held by the JVM and by the worker at the same
    time, several times over while buffers grow, for every core. Rows and results are the same under any bound.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def identity(row: str | None = None) -> list[Column]:
    """Columns that name a row: its id (missing: after all others) and a digest of its whole text.

    Rows that agree in both are repeats of each other and share every decision. `row`: a struct to take them from.
    """
    doc, text = (F.col(f"{row}.{c}" if row else c) for c in ("doc_id", "text"))
    return [F.coalesce(doc.cast("long"), F.lit(LAST_ID)).alias("__doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("__text_key")]


def wrapped(df: DataFrame) -> DataFrame:
    """(__row, __doc, __text_key): all columns in one struct, where no name can clash with those added beside it."""
    return df.select(F.struct("*").alias("__row")).select("__row", *identity("__row"))


def small_side(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows, stored and counted; marked for broadcast only if the count is within the bound."""
    kept = stored(df, label)
    return F.broadcast(kept) if kept.count() <= rows else kept


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A getter of `value` for use in tasks. The value is broadcast, and loaded once per worker process, so what it
    has learned in one task (caches) serves the next. For values of bounded size only."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def get() -> Any:
        if not hasattr(sent, "loaded"):
            sent.loaded = pickle.loads(sent.value)
        return sent.loaded

    return get
