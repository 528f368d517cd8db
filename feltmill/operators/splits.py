"""Hash-seeded splits, samples and resampling. Same rows in, same answer out, under any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import normal_draw, pick, seeded_digest
from ..functions.values import clamp, half_even
from .ranks import exact_rank, join_on, leading, slots

STAGES = ("PREFLOP", "POSTFLOP")
SPLITS = ("train", "validation", "test")


def _share(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n.cast("double") * fraction, 0).cast("bigint"))


def stage_split(df: DataFrame, stage: str = "stage_group", unit: str = "split_unit", seed: int = 17) -> DataFrame:
    """Add `split`: per stage 70/10/20 over hash-ordered units, one answer per unit.

    Fewer than three units in a stage all train. A unit seen in both stages follows the later
    stage, so a hand never sits in two splits. Units of no known stage get ''.
    """
    units = df.filter(F.col(stage).isin(*STAGES)).select(stage, unit).distinct()
    ranked = exact_rank(units.withColumn("_digest", seeded_digest(seed, F.col(unit))), [stage], "_digest", [unit])
    n, position = F.col("group_size"), F.col("rank")
    test_n, validation_n = _share(n, 0.2), _share(n, 0.1)
    train_n = F.greatest(F.lit(1), n - test_n - validation_n)
    chosen = (
        F.when((n < 3) | (position <= train_n), F.lit("train"))
        .when(position <= train_n + validation_n, F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    order = F.when(F.col(stage) == STAGES[1], 1).otherwise(0)
    answer = ranked.groupBy(unit).agg(F.max_by(chosen, order).alias("split"))
    return df.join(answer, unit, "left").withColumn("split", F.coalesce("split", F.lit("")))


def _largest_remainder(counts: DataFrame, label: str, n: str, total: Column, out: str) -> DataFrame:
    """Spread `total` draws over the labels in proportion to `n`; leftovers go to the largest fractions.

    `counts` has one row per label, so its single-partition windows stay as small as the label list.
    """
    everything = Window.partitionBy(F.lit(0))
    ideal = F.col(n).cast("double") / F.sum(n).over(everything).cast("double") * total.cast("double")
    by_fraction = Window.partitionBy(F.lit(0)).orderBy(F.desc("_fraction"), F.asc(label))
    return (
        counts.withColumn("_ideal", ideal)
        .withColumn("_floor", F.floor("_ideal").cast("bigint"))
        .withColumn("_fraction", F.col("_ideal") - F.col("_floor"))
        .withColumn("_left", total.cast("bigint") - F.sum("_floor").over(everything))
        .withColumn(out, F.col("_floor") + F.when(F.row_number().over(by_fraction) <= F.col("_left"), 1).otherwise(0))
        .drop("_ideal", "_floor", "_fraction", "_left")
    )


def stratified_three_way(
    df: DataFrame, label: str, key: str, seed: int = 17, validation: float = 0.10, test: float = 0.20
) -> DataFrame:
    """Add `split` with class shares kept: first the test rows are set aside, then validation from the rest."""
    everything = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_all", F.sum("_n").over(everything))
    counts = _largest_remainder(counts, label, "_n", F.col("_all") - F.ceil(F.col("_all") * test), "_kept")
    counts = counts.withColumn("_kept_all", F.sum("_kept").over(everything))
    relative = validation / (1.0 - test)
    counts = _largest_remainder(counts, label, "_kept", F.col("_kept_all") - F.ceil(F.col("_kept_all") * relative), "_train")
    cuts = counts.select(label, "_kept", "_train")
    ranked = exact_rank(df.withColumn("_digest", seeded_digest(seed, F.col(key))), [label], "_digest", [key])
    split = (
        F.when(F.col("rank") <= F.col("_train"), F.lit("train"))
        .when(F.col("rank") <= F.col("_kept"), F.lit("validation"))
        .otherwise(F.lit("test"))
    )
    return join_on(ranked, cuts, [label]).withColumn("split", split).drop("_digest", "rank", "group_size", "_kept", "_train")


def stratified_two_way(df: DataFrame, label: str, key: str, seed: int = 17, test: float = 0.25, in_place: bool = False) -> DataFrame:
    """Add `split` (train/test) and `split_warning`. A label with one row switches to a plain random split.

    `in_place` gives the same split where the rows lie, without moving them.
    """
    everything = Window.partitionBy(F.lit(0))
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_all", F.sum("_n").over(everything)).withColumn("_least", F.min("_n").over(everything))
    counts = _largest_remainder(counts, label, "_n", F.col("_all") - F.ceil(F.col("_all") * test), "_train")
    plain = F.col("_least") < 2
    cuts = counts.select(
        label,
        F.when(plain, F.lit("")).otherwise(F.col(label).cast("string")).alias("_group"),
        F.when(plain, F.col("_all") - F.ceil(F.col("_all") * test)).otherwise(F.col("_train")).alias("_train"),
        F.when(plain, F.lit("stratified_split_unavailable_used_random_split")).alias("split_warning"),
    )
    joined = join_on(df, cuts, [label], few=True).withColumn("_digest", seeded_digest(seed, F.col(key)))
    if in_place:
        taken = leading(joined, ["_group", "_train"], "_digest", [key], F.col("_train"), "_in_train")
        return taken.withColumn("split", F.when(F.col("_in_train"), F.lit("train")).otherwise(F.lit("test"))).drop("_digest", "_group", "_train", "_in_train")
    ranked = exact_rank(joined, ["_group"], "_digest", [key], few=True)
    return ranked.withColumn("split", F.when(F.col("rank") <= F.col("_train"), F.lit("train")).otherwise(F.lit("test"))).drop(
        "_digest", "_group", "_train", "rank", "group_size"
    )


def grouped_split(df: DataFrame, label: str, group: str, seed: int = 17, test: float = 0.25) -> DataFrame:
    """Add `split`: inside each label a quarter of the source groups is set aside whole."""
    groups = df.select(label, group).distinct().withColumn("_digest", seeded_digest(seed, F.col(label), F.col(group)))
    ranked = exact_rank(groups, [label], "_digest", [group])
    test_n = F.when(F.col("group_size") > 1, _share(F.col("group_size"), test)).otherwise(F.lit(0))
    answer = ranked.select(label, group, F.when(F.col("rank") <= test_n, F.lit("test")).otherwise(F.lit("train")).alias("split"))
    return join_on(df, answer, [label, group])


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 17) -> DataFrame:
    """Exactly min(n, rows) rows, always the same ones."""
    return df.withColumn("_digest", seeded_digest(seed, F.col(key))).orderBy("_digest", key).limit(n).drop("_digest")


def stratified_fraction(df: DataFrame, label: str, key: str, fraction: float, seed: int = 17, in_place: bool = False) -> DataFrame:
    """The same share of every class, at least one row each; `in_place` takes it where the rows lie, without moving them."""
    if fraction >= 1.0:
        return df
    if not in_place:
        ranked = exact_rank(df.withColumn("_digest", seeded_digest(seed, F.col(key))), [label], "_digest", [key], few=True)
        return ranked.filter(F.col("rank") <= _share(F.col("group_size"), fraction)).drop("_digest", "rank", "group_size")
    marked = leading(df.withColumn("_digest", seeded_digest(seed, F.col(key))), [label], "_digest", [key], _share(F.col("group_size"), fraction), "_taken")
    return marked.filter("_taken").drop("_digest", "_taken")


def price_ratios(pot: str, to_call: str, equity: str, ratio: str, required: str, gap: str) -> dict[str, Column]:
    """Price to pot, equity required and what equity exceeds it, for `derived`; a ratio without a base keeps its value."""
    price = F.coalesce(F.col(to_call), F.lit(0.0))
    whole = F.coalesce(F.col(pot), F.lit(0.0)) + price
    return {
        ratio: F.when((F.col(pot) > 0) & F.col(to_call).isNotNull(), half_even(F.col(to_call) / F.col(pot), 6)).otherwise(F.col(ratio)),
        required: F.when(whole > 0, half_even(price / whole, 6)).otherwise(F.col(required)),
        gap: half_even(F.coalesce(F.col(equity), F.lit(0.0)) - F.coalesce(F.col(required), F.lit(0.0)), 6),
    }


def balanced_resample(
    df: DataFrame,
    label: str,
    labels: Sequence[str],
    key: str,
    target_rows: int | float,
    jittered: Sequence[str] = (),
    seed: int = 17,
    derived: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Bring every label to its share of `target_rows`: keep up to the share, then draw with replacement.

    `target_rows` is a row count, or a float that multiplies the rows at hand. When there are enough
    rows already they are all kept and nothing is drawn.

    Drawn rows get the id 'key:aug:slot', `generation_method` 'resampled_jitter' and one factor per
    row (normal, sigma 0.025, cut to 0.92 .. 1.08) on the `jittered` columns, rounded to 6 digits; a missing
    value stays missing. Columns of `derived` are then computed again on the drawn rows, one after the other (see
    `price_ratios`).
    A label without rows fails the job when it runs.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(name, i) for i, name in enumerate(labels)], f"`{label}` string, _i int")
    everything = Window.partitionBy(F.lit(0))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    have = names.join(sizes, label, "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    total = F.sum("_n").over(everything)
    wanted = F.floor(total * target_rows) if isinstance(target_rows, float) else F.lit(target_rows).cast("bigint")
    have = have.withColumn("_total", total).withColumn("_wanted", wanted)
    share = F.floor(F.col("_wanted") / len(labels)) + F.when(F.col("_i") < F.col("_wanted") % len(labels), 1).otherwise(0)
    have = have.withColumn("_target", F.when(F.col("_wanted") <= F.col("_total"), F.col("_n")).otherwise(share))
    missing = (F.col("_n") == 0) & (F.col("_target") > 0)
    have = have.withColumn("_n", F.when(missing, F.raise_error(F.lit("cannot_augment_missing_class"))).otherwise(F.col("_n")))
    numbered = exact_rank(df.withColumn("_digest", seeded_digest(seed, F.col(label), F.col(key))), [label], "_digest", [key])
    numbered = numbered.join(have.select(label, "_target"), label).drop("_digest")
    kept = numbered.filter(F.col("rank") <= F.col("_target")).drop("rank", "group_size", "_target")
    need = have.select(label, "_n", (F.col("_target") - F.col("_n")).alias("_need"))
    drawn = slots(need, "_need").withColumn("_slot", F.col("slot") + F.col("_n"))
    drawn = drawn.withColumn("_digest", seeded_digest(seed, F.col(label), F.col("_slot")))
    drawn = drawn.withColumn("rank", pick(F.col("_digest"), F.col("_n")) + 1)
    factor = clamp(F.lit(1.0) + F.lit(0.025) * normal_draw(F.col("_digest")), 0.92, 1.08)
    source = numbered.drop("group_size", "_target")
    # Drawn rows come from a table of a few labels, so their size is far underrated: without the hint they are broadcast.
    rows = drawn.select(label, "rank", "_slot", factor.alias("_factor")).hint("merge").join(source, [label, "rank"])
    shaken = [
        F.when(F.col(c).isNotNull(), half_even(F.greatest(F.lit(0.0), F.col(c) * F.col("_factor")), 6)).alias(c) if c in jittered else F.col(c)
        for c in df.columns
        if c != key
    ]
    added = rows.select(
        F.concat_ws(":", F.col(key).cast("string"), F.lit("aug"), F.col("_slot").cast("string")).alias(key),
        *shaken,
        F.lit("resampled_jitter").alias("generation_method"),
        F.col(key).cast("string").alias("source_snapshot_id"),
    )
    for name, value in (derived or {}).items():
        added = added.withColumn(name, value)
    originals = kept.select(
        F.col(key).cast("string").alias(key),
        *[F.col(c) for c in df.columns if c != key],
        F.lit("real_imported").alias("generation_method"),
        F.col(key).cast("string").alias("source_snapshot_id"),
    )
    return originals.unionByName(added)
