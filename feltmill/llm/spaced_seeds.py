"""Benchmark decontamination with spaced seeds, in DataFrame operations only.

A seed is a window of tokens under a fixed mask: the digest of the tokens where the mask has 1; tokens under 0 may
differ. The digests of all benchmark windows are joined with those of all training windows. Each hit fixes a
diagonal (training position less benchmark position); around it the tokens of both sides are compared one by one,
and the overlap counts when some stretch of `stretch` aligned tokens (the whole item, if that is shorter) agrees in at
least `likeness` of its places.

The benchmark side is stored and counted, and broadcast only within a bound; beyond it the same join shuffles. The
training windows are never stored: they are made from an array of token digests inside the scan's stage.

Defined cases: tokens are runs of letters and digits, lower-cased; null and empty texts have none; items or texts of
fewer tokens than a mask spans have no window under it, so items below five tokens are never found; items with equal
token rows are one class, named by its smallest item_id (missing ids come after others); rows that repeat doc_id and
text count once; other columns are not read; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feltmill.llm.common import LAST_ID, identity, small_side, wrapped

#: 1: the token counts, 0: it is ignored. Five tokens count in each.
MASKS = ("11111", "1101011", "1100100101")
STRETCH = 13
LIKENESS = 0.8


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_digests(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def seed_digests(row: str, place: Column) -> Column:
    """One digest per mask of the window that begins at `place` (from 0); null where the mask leaves the row."""
    found = []
    for i, mask in enumerate(MASKS):
        chosen = [F.get(F.col(row), place + k) for k, m in enumerate(mask) if m == "1"]
        found.append(F.when(place + len(mask) <= F.size(row), F.xxhash64(F.lit(i), *chosen)))
    return F.array(*found)


def windows(df: DataFrame, row: str, *keep: str) -> DataFrame:
    """A row (keep..., row, __place, __seed) for every window of every mask."""
    places = df.select(*keep, row, F.posexplode(row).alias("__place", "__token"))
    seeds = places.select(*keep, row, "__place", F.explode(seed_digests(row, F.col("__place"))).alias("__seed"))
    return seeds.filter("__seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, stretch: int = STRETCH, likeness: float = LIKENESS) -> DataFrame:
    """(__doc, __text_key, item_id, doc_start, n_aligned, n_matched, similarity): the best overlap of each pair."""
    items = (
        benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LAST_ID)).alias("item_id"), token_digests(F.col("text")).alias("__item"))
        .filter(F.size("__item") >= len(MASKS[0]))
        .groupBy("__item")
        .agg(F.min("item_id").alias("item_id"))
    )
    items = small_side(items, "items")
    seeds = windows(items, "__item", "item_id").select("__seed", "item_id", F.col("__place").alias("__at"), F.size("__item").alias("__len"))
    seeds = small_side(seeds, "seeds")
    texts = docs.select(*identity(), token_digests(F.col("text")).alias("__row"))
    start = F.col("__place") - F.col("__at")
    hits = (
        windows(texts, "__row", "__doc", "__text_key")
        .join(seeds, "__seed")
        .select(
            "__doc", "__text_key", "item_id", start.alias("__start"), "__len",
            F.slice("__row", F.greatest(start, F.lit(0)) + 1, F.least(start, F.lit(0)) + F.col("__len")).alias("__part"),
        )
    )
    sites = hits.groupBy("__doc", "__text_key", "item_id", "__start").agg(F.first("__part").alias("__part"))
    aligned = sites.join(items, "item_id").withColumn("__skip", F.greatest(-F.col("__start"), F.lit(0)))
    # agreement of each aligned place, in the item's order; places outside the text do not take part
    own = F.slice("__item", F.col("__skip") + 1, F.size("__part"))
    same = F.zip_with("__part", own, lambda a, b: F.when(a == b, 1).otherwise(0))
    scored = aligned.withColumn("__same", same).withColumn("__width", F.least(F.size("__item"), F.lit(stretch)))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.size("__same") - F.col("__width") + 1),
            lambda i: F.aggregate(F.slice("__same", i, F.col("__width")), F.lit(0), lambda acc, x: acc + x),
        )
    )
    found = (
        scored.filter(F.size("__same") >= F.col("__width"))
        .withColumn("__best", best)
        .filter(F.col("__best") >= likeness * F.col("__width"))
        .withColumn("__sum", F.aggregate("__same", F.lit(0), lambda acc, x: acc + x))
    )
    order = F.struct(F.col("__best") / F.col("__width"), "__sum", -F.col("__start"))
    row = F.struct((F.col("__start") + F.col("__skip")).alias("s"), F.size("__same").alias("n"), F.col("__sum").alias("m"))
    top = found.groupBy("__doc", "__text_key", "item_id").agg(F.max_by(row, order).alias("__top"))
    return top.select(
        "__doc", "__text_key", "item_id", F.col("__top.s").cast("long").alias("doc_start"), F.col("__top.n").cast("long").alias("n_aligned"),
        F.col("__top.m").cast("long").alias("n_matched"), (F.col("__top.m") / F.col("__top.n")).alias("similarity"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows without an overlap."""
    found = small_side(overlaps(docs, benchmark).select("__doc", "__text_key").distinct(), "contaminated")
    return wrapped(docs).join(found, ["__doc", "__text_key"], "left_anti").select("__row.*")
