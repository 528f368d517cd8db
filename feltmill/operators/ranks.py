"""Exact ranks, running values and slots without putting one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", few: bool = False) -> DataFrame:
    """Join on equal keys, where a missing key equals a missing key; the keys appear once.

    `few`: the right side has few rows by construction and is broadcast.
    """
    renamed = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    renamed = F.broadcast(renamed) if few else renamed
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"`{k}`").eqNullSafe(F.col(f"`_on_{k}`"))
    return left.join(renamed, condition, how).drop(*[f"_on_{k}" for k in keys])


def exact_rank(df: DataFrame, by: Sequence[str], digest: str, ties: Sequence[str] = (), width: int = 3, few: bool = False) -> DataFrame:
    """Add `rank` (1-based) and `group_size` for the order of a hex digest inside each `by` group.

    A group is cut into 16**width ranges by the head of the digest. Ranges of a digest are equally
    full, so a group holding a third of the rows still spreads over the cluster. The rank is the
    position in the range plus the number of rows in the ranges before it; only the range sizes
    (at most 16**width rows per group) pass through the second window. `few`: there are few groups, so the
    range sizes are broadcast and the rows are shuffled once.
    """
    keys = [*by, "_range"]
    cut = df.withColumn("_range", F.substring(digest, 1, width))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    if not by:
        before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("group_size"),
    )
    inside = Window.partitionBy(*keys).orderBy(digest, *ties)
    return (
        join_on(cut.withColumn("_row", F.row_number().over(inside)), offsets, keys, few=few)
        .withColumn("rank", F.col("_row") + F.col("_before"))
        .drop("_range", "_row", "_before")
    )


def leading(df: DataFrame, by: Sequence[str], digest: str, ties: Sequence[str], share: Column, name: str, width: int = 3) -> DataFrame:
    """Add `name`: whether a row is among the first `share` rows of its group, for the order of `exact_rank`.

    `share` is a column of `group_size` and of what is the same in a whole group (listed in `by`). Ranges wholly before or
    behind the cut are settled by their sizes where the rows lie; only the one range a group is cut in is ranked, so
    next to nothing is shuffled. For few groups; rows come in no particular order.
    """
    keys = [*by, "_range"]
    ranged = df.withColumn("_range", F.substring(digest, 1, width))
    sizes = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "group_size": F.sum("_n").over(Window.partitionBy(*by))})
    left = sizes.select(*keys, (share - F.col("_before")).alias("_left"), "_n")
    known = join_on(ranged, left, keys, few=True)
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_n"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(digest, *ties))
    whole = known.filter(~cut).withColumn(name, F.col("_left") > 0)
    settled = known.filter(cut).withColumn(name, place <= F.col("_left"))
    return whole.unionByName(settled).drop("_range", "_left", "_n")


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    slice_of: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = False,
) -> DataFrame:
    """Running sum / max / count / last non-null value over an ordered group that may be huge.

    `slice_of` cuts a group into consecutive ranges of its order (a number that never decreases
    along the order). Each range is reduced first, the reduced ranges are scanned, and the rows
    of a range then only look at their own range. `values` maps an output name to (kind, column).
    """
    keys = [*by, "_slice"]
    cut = df.withColumn("_slice", slice_of)
    order_struct = F.struct(*[F.col(o) for o in order])
    reduced_cols, carry_cols, row_cols = [], [], []
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    prior = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for name, (kind, column) in values.items():
        total, carry = f"_t_{name}", f"_c_{name}"
        if kind == "sum":
            reduced_cols.append(F.sum(column).alias(total))
            carry_cols.append(F.coalesce(F.sum(total).over(prior), F.lit(0)).alias(carry))
            row_cols.append((name, F.col(carry) + F.coalesce(F.sum(column).over(upto), F.lit(0))))
        elif kind == "max":
            reduced_cols.append(F.max(column).alias(total))
            carry_cols.append(F.max(total).over(prior).alias(carry))
            row_cols.append((name, F.greatest(F.col(carry), F.max(column).over(upto))))
        elif kind == "last":
            reduced_cols.append(F.max_by(column, F.when(column.isNotNull(), order_struct)).alias(total))
            carry_cols.append(F.last(total, ignorenulls=True).over(prior).alias(carry))
            row_cols.append((name, F.coalesce(F.last(column, ignorenulls=True).over(upto), F.col(carry))))
        else:
            raise ValueError(f"unknown running kind: {kind}")
    carries = cut.groupBy(*keys).agg(*reduced_cols).select(*keys, *carry_cols)
    out = join_on(cut, carries, keys)
    out = out.select("*", *[expr.alias(name) for name, expr in row_cols])
    return out.drop("_slice", *[f"_c_{name}" for name in values])


def slots(df: DataFrame, need: str, block: int = 4096) -> DataFrame:
    """One row per slot 0 .. need-1 of every input row, produced in blocks that spread over tasks."""
    blocks = df.filter(F.col(need) > 0).withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(need) - 1) / block)))
    )
    spread = blocks.repartition(*[c for c in df.columns if c != need], "_block") if len(df.columns) > 1 else blocks.repartition("_block")
    first = F.col("_block") * block
    last = F.least(first + block, F.col(need).cast("bigint")) - 1
    return spread.withColumn("slot", F.explode(F.sequence(first, last))).drop("_block")
