"""Registered queries: name -> Spark callable, reference SQL, and the survey rows they show."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: QueryFn
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query registered twice: {name}")
        REGISTRY[name] = Registered(name, fn, tuple(covers.split()), sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A table of the data folder.

    `wide` is for work that is heavy per row: a table stored in fewer pieces than there are cores is
    spread over them first. A large table has more pieces than that and is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if wide and df.rdd.getNumPartitions() < cores else df
