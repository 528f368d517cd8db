"""Hash keys: reproducible ordering, picks and identities that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int, *parts: Column) -> Column:
    """SHA-256 of 'seed:part:part' in hex; ordering by it is a reproducible shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def unit_interval(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from 13 hex digits of a digest."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def pick(digest: Column, n: Column, start: int = 1) -> Column:
    """An index in 0 .. n-1 from 13 hex digits of a digest."""
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("bigint") % n.cast("bigint")


def normal_draw(digest: Column) -> Column:
    """A standard normal value from one digest (Box-Muller on two disjoint slices)."""
    u = F.greatest(unit_interval(digest, 1), F.lit(2.0**-52))
    v = unit_interval(digest, 14)
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)


def content_id(*columns: Column) -> Column:
    """SHA-256 over the JSON text of the columns in the given order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def short_id(digest: Column) -> Column:
    return F.substring(digest, 1, 16)


def padded(number: Column, width: int) -> Column:
    """Digits with leading zeros up to `width`; a longer number stays whole."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)
