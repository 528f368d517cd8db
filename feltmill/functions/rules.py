"""Ordered rules: the first reason that holds, or every reason that holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Column, "Column | str"]


def _reason(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def first_reason(rules: Sequence[Rule]) -> Column:
    """Reason of the first rule whose condition is true; null when none is (unknown counts as not true)."""
    out = None
    for condition, reason in rules:
        out = F.when(condition, _reason(reason)) if out is None else out.when(condition, _reason(reason))
    return out.otherwise(F.lit(None).cast("string"))


def all_reasons(rules: Sequence[Rule]) -> Column:
    """Reasons of every rule whose condition is true, in rule order."""
    return F.array_compact(F.array(*[F.when(condition, _reason(reason)) for condition, reason in rules]))


def is_true(c: Column) -> Column:
    """True only for true; null and false both give false."""
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))
