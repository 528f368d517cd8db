"""The table of solved spots: identity, upsert, delete, listing, export and statistics."""

from __future__ import annotations

import gzip
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cards as C
from ..functions.keys import short_id

SCHEMA_VERSION = 1


def sorted_board(board: Column) -> Column:
    """Board cards by (rank, suit)."""
    keyed = F.transform(board, lambda c: F.struct(C.rank_value(c).alias("r"), C.suit_value(c).alias("s"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def canonical_hand_text(hand: Column) -> Column:
    """'KhAh' and 'AhKh' to one text: the two cards in text order."""
    text = F.trim(hand)
    pair = F.array_sort(F.array(F.substring(text, 1, 2), F.substring(text, 3, 2)))
    return F.when(F.length(text) == 4, F.array_join(pair, "")).otherwise(text)


def spot_identity(df: DataFrame, scalars: Sequence[str], board: str = "board", sizes: str = "bet_sizes", ranges: str | None = None) -> DataFrame:
    """Add `spot_id`, `board_signature` and `bet_menu_hash`.

    The id hashes JSON with sorted keys: sorted board, sorted bet sizes, the scalar fields, and sorted
    ranges of [hand, weight] pairs (an empty list counts as none). Names and labels do not take part.
    """
    parts = {board: sorted_board(F.col(board)), sizes: F.array_sort(F.col(sizes)), **{s: F.col(s) for s in scalars}}
    if ranges is not None:
        pairs = F.array_sort(F.transform(F.col(ranges), lambda p: F.array(canonical_hand_text(p[0]), p[1])))
        parts[ranges] = F.when(F.size(F.col(ranges)) > 0, pairs)
    ordered = [parts[name].alias(name) for name in sorted(parts)]
    spelled = F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
    return df.withColumns(
        {
            "spot_id": F.sha2(spelled, 256),
            "board_signature": F.array_join(sorted_board(F.col(board)), ""),
            "bet_menu_hash": short_id(F.sha2(F.to_json(F.struct(F.array_sort(F.col(sizes)).alias("bet_size_fractions"))), 256)),
        }
    )


def insert_only(existing: DataFrame, incoming: DataFrame, key: str = "spot_id", order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """(new table, rejected rows): a key that is present is refused, and so is every copy in the batch but the first.

    The first is the smallest by `order`, then by content; of equal rows one goes in and the others are refused, so
    that every incoming row is in exactly one of the two results. A missing key is a key like any other.
    """
    columns = incoming.columns
    content = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    kinds = incoming.groupBy(F.col(key).alias("_key"), F.col(order).alias("_order"), content.alias("_content"))
    kinds = kinds.agg(F.first(F.struct(*columns)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    first = kinds.groupBy("_key").agg(F.min(F.struct("_order", "_content")).alias("_first"))
    known = existing.select(F.col(key).alias("_known"))
    first = first.join(known, F.col("_key").eqNullSafe(F.col("_known")), "left_anti").withColumnRenamed("_key", "_fresh")
    marked = kinds.join(first, F.col("_key").eqNullSafe(F.col("_fresh")), "left")
    marked = marked.withColumn("_in", F.col("_first").isNotNull() & F.struct("_order", "_content").eqNullSafe(F.col("_first")))
    copies = F.array_repeat("_row", (F.col("_n") - F.when(F.col("_in"), 1).otherwise(0)).cast("int"))
    rejected = marked.select(F.explode(copies).alias("_row")).select("_row.*", F.lit("duplicate_spot_id").alias("error"))
    return existing.unionByName(marked.filter("_in").select("_row.*"), allowMissingColumns=True), rejected


def upsert(existing: DataFrame, incoming: DataFrame, key: str = "spot_id", order: str = "created_at") -> DataFrame:
    """Last write wins; of writes at the same `order` the one with the greatest content.

    The newest row per key is found by an aggregation that combines on the map side.
    """
    columns = existing.columns
    both = existing.select(*columns, F.lit(0).alias("_new")).unionByName(incoming.select(*columns, F.lit(1).alias("_new")))
    row = F.struct(*columns)
    newest = both.groupBy(key).agg(F.max_by(row, F.struct("_new", order, F.to_json(row))).alias("_row"))
    return newest.select("_row.*")


def delete(existing: DataFrame, ids: DataFrame, key: str = "spot_id") -> tuple[DataFrame, DataFrame]:
    """(remaining rows, ids that were not there)."""
    wanted = ids.select(key).distinct()
    return existing.join(wanted, key, "left_anti"), wanted.join(existing.select(key), key, "left_anti")


def pending(requests: DataFrame, solved: DataFrame, key: str = "spot_id") -> tuple[DataFrame, DataFrame]:
    """(requests still to run, requests already solved)."""
    keys = solved.select(key).distinct()
    return requests.join(keys, key, "left_anti"), requests.join(keys, key, "left_semi")


def outcome_counts(requests: DataFrame, solved: DataFrame, dry_run: bool = False, key: str = "spot_id") -> DataFrame:
    """Requests by outcome: error (bad row), skip (already solved), dry_run or pending."""
    keys = solved.select(key).distinct().withColumn("_solved", F.lit(True))
    marked = requests.join(keys, key, "left")
    outcome = F.when(F.size("errors") > 0, "error").when(F.col("_solved"), "skip").otherwise(F.lit("dry_run" if dry_run else "pending"))
    return marked.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def listing(
    df: DataFrame,
    *,
    limit: int | None = None,
    offset: int = 0,
    board_pattern: str | None = None,
    label_pattern: str | None = None,
    street: str | None = None,
    stack_min: int | None = None,
    stack_max: int | None = None,
    version: str | None = None,
    created_after: int | None = None,
) -> DataFrame:
    """Spots that meet every given filter, newest first. A pattern that is no regular expression meets nothing."""
    out = df
    for pattern, column in ((board_pattern, "board_signature"), (label_pattern, "label")):
        if pattern is not None:
            try:
                re.compile(pattern)
            except re.error:
                return df.limit(0)
            out = out.filter(F.col(column).rlike(pattern))
    for value, column, test in (
        (street, "street", lambda c, v: c == v),
        (stack_min, "stack_bb", lambda c, v: c >= v),
        (stack_max, "stack_bb", lambda c, v: c <= v),
        (version, "solver_version", lambda c, v: c == v),
        (created_after, "created_at", lambda c, v: c >= v),
    ):
        if value is not None:
            out = out.filter(test(F.col(column), value))
    rows = out.orderBy(F.desc("created_at"), "spot_id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def portable(df: DataFrame, spot: Sequence[str], result: Sequence[str], meta: Sequence[str]) -> DataFrame:
    """Each record as one portable JSON text with spot, result and metadata."""
    doc = F.struct(
        F.struct(*spot).alias("spot_description"), F.struct(*result).alias("solve_result"), F.struct("spot_id", F.lit(SCHEMA_VERSION).alias("schema_version"), *meta).alias("metadata")
    )
    return df.select("spot_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("record"))


def import_portable(df: DataFrame, spot_schema: str, result_schema: str, scalars: Sequence[str], record: str = "record") -> DataFrame:
    """Portable JSON back to rows: the id is computed again, `mismatch` marks records that claimed another."""
    schema = f"spot_description struct<{spot_schema}>, solve_result struct<{result_schema}>, metadata struct<spot_id:string>"
    parsed = df.withColumn("_r", F.from_json(record, schema))
    flat = parsed.select("_r.spot_description.*", "_r.solve_result.*", F.col("_r.metadata.spot_id").alias("claimed_id"))
    again = spot_identity(flat, scalars)
    return again.withColumn("mismatch", (F.length("claimed_id") > 0) & (F.col("claimed_id") != F.col("spot_id")))


@F.pandas_udf(T.BinaryType())
def _gzip(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else gzip.compress(t.encode(), 6, mtime=0))


@F.pandas_udf(T.StringType())
def _gunzip(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else gzip.decompress(b).decode())


def strategy_blob(strategy: Column) -> Column:
    """A strategy (map of probability lists) as gzip of its JSON; equal strategies give equal bytes."""
    return _gzip(F.to_json(strategy))


def strategy_of(blob: Column) -> Column:
    """The strategy of a blob; every number comes back as it was."""
    return F.from_json(_gunzip(blob), "map<string,array<double>>")


def statistics(df: DataFrame, size: Column) -> DataFrame:
    """Count, bytes and age overall, by street and by version in one pass."""
    out = df.groupingSets([[], ["street"], ["solver_version"]], "street", "solver_version").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.min("created_at").alias("oldest"), F.max("created_at").alias("newest")
    )
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "street").otherwise("version")
    return out.select(level.alias("level"), F.coalesce("street", "solver_version", F.lit("")).alias("key"), "n", "bytes", "oldest", "newest")


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Overlap of two keyed tables on one row: key counts, coverage of the left one, largest difference."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    joined = a.join(b, list(keys), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    out = joined.agg(
        F.count("_l").alias("left_keys"), F.count("_r").alias("right_keys"), F.count_if(both).alias("overlap"),
        F.max(F.when(both, F.abs(F.col("_a") - F.col("_b")))).alias("max_delta"), F.avg(F.when(both, F.col("_a") - F.col("_b"))).alias("mean_delta"),
    )
    return out.withColumn("coverage", F.when(F.col("left_keys") > 0, F.col("overlap") / F.col("left_keys")).otherwise(1.0))


def glue(model_input: DataFrame, features: DataFrame, key: str = "source_row_id") -> DataFrame:
    """Join two exports of the same rows one to one by their row id.

    File order means nothing here, so the id decides; a repeated id fails the job instead of
    multiplying rows.
    """

    def once(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*[F.col(f"`{c}`") for c in others])).alias("_row"))
        repeated = F.raise_error(F.concat(F.lit("duplicate_row_id:"), F.col(key).cast("string"))).cast("boolean")
        return one.filter(F.when(F.col("_n") > 1, repeated).otherwise(F.lit(True))).select(key, "_row.*")

    shared = [c for c in model_input.columns if c in features.columns and c != key]
    return once(features).join(once(model_input.drop(*shared)), key, "left")
