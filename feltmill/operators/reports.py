"""Counts, rates, confusion matrices, metrics and comparisons as small result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_even, is_null_like, ratio, strip
from .normalize import col


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null counts as ''."""
    return df.groupBy(F.coalesce(col(column).cast("string"), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    return df.groupBy(
        F.coalesce(col(outer).cast("string"), F.lit("")).alias("outer"), F.coalesce(col(inner).cast("string"), F.lit("")).alias("inner")
    ).agg(F.count(F.lit(1)).alias("n"))


def as_map(counts: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """Collapse small count rows to one map per key."""
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("counts"))


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of null or blank cells per column from one pass; 1.0 on an empty input."""
    names = list(columns or df.columns)
    rates = df.agg(
        *[
            F.coalesce(half_even(F.avg(F.when(col(c).isNull() | (strip(col(c).cast("string")) == ""), 1.0).otherwise(0.0)), 6), F.lit(1.0)).alias(f"r{i}")
            for i, c in enumerate(names)
        ]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"r{i}").alias("missing_rate")) for i, c in enumerate(names)]))
    return rates.select(pairs.alias("p")).select("p.field", "p.missing_rate")


# Fields whose absence an export reports.
EXPORT_FIELDS = ("hero_cards", "villain_hand", "board_cards", "exploitability_last", "iterations", "candidate_confidence")


def missing_counts(df: DataFrame, columns: Sequence[str] = EXPORT_FIELDS) -> DataFrame:
    """Cells per column that hold nothing: null, a null word, or an empty list."""

    def empty(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        if kind == "array":
            return F.coalesce(F.size(col(name)) <= 0, F.lit(True))
        return is_null_like(col(name), "training")

    counts = df.agg(*[F.count_if(empty(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns]))
    return counts.select(pairs.alias("p")).select("p.field", "p.n")


def export_summary(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Distributions over several dimensions in one pass: (dimension, value, rows, excluded)."""
    keyed = df.select("excluded", *[F.coalesce(col(d).cast("string"), F.lit("")).alias(f"d{i}") for i, d in enumerate(dimensions)])
    names = [f"d{i}" for i in range(len(dimensions))]
    grouped = keyed.groupingSets([[], *[[n] for n in names]], *names).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("excluded")).alias("excluded_rows")
    )
    full = (1 << len(names)) - 1
    which, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dimensions):
        only = full - (1 << (len(names) - 1 - i))
        which = F.when(F.col("_g") == only, F.lit(d)).otherwise(which)
        value = F.when(F.col("_g") == only, F.col(f"d{i}")).otherwise(value)
    return grouped.select(which.alias("dimension"), value.alias("value"), "rows", "excluded_rows")


def export_warnings(df: DataFrame) -> DataFrame:
    """One row with the warnings of an export and its rates."""
    usable = ~F.col("excluded")
    weak = usable & (F.col("label_source") == "weak_rule_bootstrap")
    solver = usable & (F.col("label_source") == "solver_candidate")
    card_gap = F.coalesce(F.size("hero_cards") <= 0, F.lit(True)) | F.coalesce(F.size("board_cards") <= 0, F.lit(True))
    out = df.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(usable).alias("exported"), F.count_if(weak).alias("_weak"), F.count_if(solver).alias("_solver"),
        F.count_if(F.col("exclusion_reason") == "all_in_excluded").alias("_all_in"), F.count_if(usable & (F.col("bootstrap_label") == "CALL")).alias("_call"),
        F.count_if(usable & card_gap).alias("_cards"),
    )
    warnings = F.array_compact(
        F.array(
            F.lit("not_gto"), F.lit("not_for_production"),
            F.when(F.col("_weak") > 0, F.lit("dataset_contains_weak_rule_labels")), F.when(F.col("_weak") > 0, F.lit("synthetic_distribution_bias")),
            F.when(F.col("_solver") > 0, F.lit("bootstrap_solver_untrusted")), F.when(F.col("_all_in") > 0, F.lit("all_in_excluded")),
            F.when(F.col("exported") < 500, F.lit("small_dataset")), F.when(F.col("_call") == 0, F.lit("call_class_absent")),
            F.when(F.col("_cards") > 0, F.lit("card_fields_missing_or_partial")),
        )
    )
    return out.select(
        "rows_total", "exported", (F.col("rows_total") - F.col("exported")).alias("excluded_count"),
        ratio(F.col("_weak"), F.col("exported"), 6, 0.0).alias("weak_rule_row_rate"), ratio(F.col("_solver"), F.col("exported"), 6, 0.0).alias("solver_candidate_row_rate"),
        F.array_sort(warnings).alias("warnings"),
    )


# ---- confusion and metrics -------------------------------------------------------------------


def confusion_counts(df: DataFrame, truth: str, prediction: str, group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, F.col(truth).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str, labels: Sequence[str]) -> DataFrame:
    """One row per label of the list with one count column per predicted label, zeros included."""
    wide = df.filter(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("label")).pivot(prediction, list(labels)).count()
    full = df.sparkSession.createDataFrame([(name,) for name in labels], "label string")
    return full.join(wide, "label", "left").select("label", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def class_metrics(counts: DataFrame, group: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion counts; undefined values are 0.

    Without a label list the classes are those seen in truth or prediction.
    """
    g = list(group)
    truth = counts.groupBy(*g, F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))).alias("hit"))
    said = counts.groupBy(*g, F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    both = truth.join(said, [*g, "class"], "full_outer")
    if labels is not None:
        groups = counts.select(*g).distinct() if g else counts.sparkSession.createDataFrame([(1,)], "_one int")
        grid = groups.withColumn("class", F.explode(F.array(*[F.lit(x) for x in labels]))).drop("_one")
        both = grid.join(both, [*g, "class"], "left")
    hit, support, predicted = (F.coalesce(F.col(c), F.lit(0)) for c in ("hit", "support", "predicted"))
    precision, recall = ratio(hit, predicted, otherwise=0.0), ratio(hit, support, otherwise=0.0)
    f1 = F.when(precision + recall > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select(*g, "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), support.cast("bigint").alias("support"))


def overall_metrics(counts: DataFrame, group: Sequence[str] = (), labels: Sequence[str] | None = None) -> DataFrame:
    """Accuracy, macro F1 and weighted F1 per group, six digits."""
    g = list(group)
    classes = class_metrics(counts, group, labels).groupBy(*g).agg(
        half_even(F.avg("f1"), 6).alias("macro_f1"), half_even(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 6).alias("weighted_f1")
    )
    accuracy = counts.groupBy(*g).agg(
        F.sum("n").alias("rows"), half_even(F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy")
    )
    return accuracy.join(classes, g) if g else accuracy.join(classes)


def normalized_confusion(counts: DataFrame) -> DataFrame:
    """Share of every prediction within its true label."""
    row = Window.partitionBy("label")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(row))


def confusion_reading(counts: DataFrame) -> DataFrame:
    """Main confusion (largest off-diagonal cell) and classes predicted over ten points too often."""
    off = counts.filter(F.col("label") != F.col("prediction"))
    main = off.agg(
        F.max_by("label", F.struct("n", F.col("label"), F.col("prediction"))).alias("actual"),
        F.max_by("prediction", F.struct("n", F.col("label"), F.col("prediction"))).alias("predicted"),
        F.max("n").alias("n"),
    )
    everything = Window.partitionBy(F.lit(0))
    said = counts.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("p"))
    true = counts.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("t"))
    shares = said.join(true, "class", "full_outer").select("class", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("t", F.lit(0)).alias("t"))
    shares = shares.withColumn("total", F.sum("t").over(everything))
    over = shares.agg(F.array_sort(F.collect_list(F.when(F.col("p") / F.col("total") > F.col("t") / F.col("total") + 0.10, F.col("class")))).alias("over_predicted"))
    return main.join(over)


def label_shares(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Share per label with a warning above 60 % or under 10 %."""
    counts = df.groupBy(*group, col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col("n") / F.sum("n").over(whole)
    return counts.withColumn("share", share).withColumn(
        "warning", F.when(F.col("share") > 0.60, "above_60_percent").when(F.col("share") < 0.10, "below_10_percent")
    )


def majority_baseline(df: DataFrame, label: str, group: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*group, col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*group).agg(F.max_by("label", F.struct("n", "label")).alias("majority"), (F.max("n") / F.sum("n")).alias("baseline"))


def performance_grid(perf: DataFrame, rows: str, models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Every (row, model) pair with its metrics, 'not available' where nothing was measured.

    The models are a short literal list, so the grid is an explode of it and not a cross join.
    """
    grid = perf.select(rows).distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    joined = grid.join(perf, [rows, "model"], "left")
    return joined.select(rows, "model", *[F.coalesce(F.col(m).cast("string"), F.lit("not available")).alias(m) for m in metrics])


def compare_metrics(left: DataFrame, right: DataFrame, names: tuple[str, str], margin: float = 0.10) -> DataFrame:
    """Two (metric, value) tables side by side: delta and winner, 'similar' within the margin."""
    a, b = names
    joined = left.select("metric", F.col("value").alias(a)).join(right.select("metric", F.col("value").alias(b)), "metric", "full_outer")
    delta = F.col(a) - F.col(b)
    winner = (
        F.when(delta.isNull(), "not available").when(delta > margin, a).when(delta < -margin, b).otherwise("similar")
    )
    return joined.select("metric", a, b, half_even(delta, 6).alias("delta"), winner.alias("winner"))


def ablation_reading(variants: DataFrame, reference: str = "without_constant_features", metric: str = "macro_f1") -> DataFrame:
    """Every variant against the reference variant."""
    base = variants.filter(F.col("name") == reference).agg(F.max(metric).alias("_base"))
    return variants.join(base).select("name", metric, half_even(F.col(metric) - F.col("_base"), 6).alias("delta"))


def best_model(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Best by macro F1, then weighted F1, accuracy and name; the dummy only when alone."""
    order = F.struct((F.col("model") != "dummy").alias("real"), "macro_f1", "weighted_f1", "accuracy", "model")
    return df.groupBy(*group).agg(F.max_by("model", order).alias("selected_model"))


def metric_rows(df: DataFrame, report: str, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """JSON reports to long (keys, metric, value) rows; an absent path gives no value."""
    doc = F.try_parse_json(report)
    items = [F.struct(F.lit(p).alias("metric"), F.try_variant_get(doc, f"$.{p}", "double").alias("value")) for p in paths]
    return df.select(*keys, F.explode(F.array(*items)).alias("m")).select(*keys, "m.metric", "m.value")


def pivot_sum(df: DataFrame, rows: str, columns: str, values: Sequence[str], measure: str) -> DataFrame:
    """Sum of a measure with one column per listed value, zeros where nothing was seen."""
    wide = df.groupBy(rows).pivot(columns, list(values)).agg(F.sum(measure))
    return wide.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(v) for v in values])


STREET_ORDER = ("PREFLOP", "FLOP", "TURN", "RIVER")


def category_position(c: Column, order: Sequence[str] = STREET_ORDER) -> Column:
    """1-based place of a category for sorting; 0 for one that is not listed."""
    return F.array_position(F.array(*[F.lit(o) for o in order]), c)


def augmentation_accounting(df: DataFrame, source: str = "source_snapshot_id", imported: int | None = None) -> DataFrame:
    """Rows by generation method, distinct sources, inflation, mode and warnings on one row."""
    method = F.col("generation_method")
    out = df.agg(
        F.count(F.lit(1)).alias("final_rows"), F.count_if(method == "real_imported").alias("real_rows"), F.count_if(method == "solver_generated").alias("solver_rows"),
        F.count_if(method == "resampled_jitter").alias("resampled_rows"), F.count_distinct(F.nullif(F.col(source), F.lit(""))).alias("source_ids"),
    )
    inflation = ratio(F.col("final_rows"), F.col("source_ids"), 6, 0.0)
    out = out.withColumn("inflation_ratio", inflation)
    mode = (
        F.when((F.col("solver_rows") > 0) & (F.col("resampled_rows") > 0), "imported_plus_solver_plus_resampling")
        .when(F.col("solver_rows") > 0, "imported_plus_solver")
        .when(F.col("resampled_rows") > 0, "imported_plus_resampling")
        .otherwise("imported_only")
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.col("resampled_rows") / F.col("final_rows") > 0.80, F.lit("resampled_rows_share_above_80_percent")),
            F.when(F.col("inflation_ratio") > 20.0, F.lit("inflation_ratio_above_20")),
            F.when(F.col("final_rows") > 7000, F.lit("target_rows_above_learning_curve_overfit_threshold")),
        )
    )
    return out.withColumns({"generation_mode": mode, "warnings": warnings})


def reliability(df: DataFrame) -> DataFrame:
    """One row of reliability warnings about training rows (label, source, quality, cards)."""
    label, source, quality = F.col("bootstrap_label"), F.col("label_source"), F.col("label_quality")
    out = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("classes"), F.count_if(label == "CALL").alias("_call"), F.count_if(label == "ALL_IN").alias("_all_in"),
        F.count_if(source == "weak_rule_bootstrap").alias("_weak"), F.count_if(quality == "bootstrap_weak_rule_untrusted").alias("_weakq"),
        F.count_if(quality == "bootstrap_solver_untrusted").alias("_solverq"), F.count_if(is_null_like(F.col("hero_cards"), "training")).alias("_hero"),
        F.count_if(is_null_like(F.col("board_cards"), "training")).alias("_board"),
    )
    when = F.when
    warnings = F.array_compact(
        F.array(
            F.lit("dataset_used_for_pipeline_smoke_test_only"), F.lit("not_for_production"), F.lit("not_gto"),
            when(F.col("rows") < 50, F.lit("dataset_has_less_than_50_training_rows")), when(F.col("rows") < 500, F.lit("small_dataset")),
            when(F.col("classes") < 3, F.lit("dataset_has_less_than_3_classes")), when(F.col("_call") == 0, F.lit("call_class_absent")),
            *[when(F.col("_weak") > 0, F.lit(w)) for w in ("contains_weak_rule_labels", "model_may_learn_synthetic_rules", "metrics_may_be_artificial_due_to_weak_rules")],
            when(F.col("_weakq") > 0, F.lit("label_quality_bootstrap_weak_rule_untrusted")), when(F.col("_solverq") > 0, F.lit("label_quality_bootstrap_solver_untrusted")),
            when(F.col("_hero") > 0, F.lit("hero_cards_missing_or_null")), when(F.col("_board") > 0, F.lit("board_cards_missing_or_null")),
            when(F.col("_all_in") == 0, F.lit("all_in_absent_because_excluded")),
        )
    )
    guard = when(F.col("_all_in") > 0, F.lit("all_in_label_present")).when(F.col("classes") < 2, F.lit("single_class_dataset"))
    return out.select("rows", "classes", warnings.alias("warnings"), guard.alias("guard_error"))


def require_trainable(df: DataFrame, min_rows: int) -> None:
    """Raise when rows may not train: too few, a forbidden label, or a single class. Reads one row."""
    row = reliability(df).first()
    if row["rows"] < min_rows:
        raise ValueError(f"not_enough_rows:{row['rows']}<min_rows:{min_rows}")
    if row["guard_error"]:
        raise ValueError(row["guard_error"])


def merge_warnings(df: DataFrame, stages: Sequence[str] = ("PREFLOP", "POSTFLOP"), splits: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """One row of merge warnings: small stages and stages with a missing split."""
    parts = []
    aggs = []
    for s in stages:
        low, here = s.lower(), F.col("stage_group") == s
        aggs.append(F.count_if(here).alias(f"n_{low}"))
        aggs += [F.count_if(here & (F.col("split") == x)).alias(f"n_{low}_{x}") for x in splits]
        missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"n_{low}_{x}") == 0, F.lit(x)) for x in splits])))
        parts.append(F.when(F.col(f"n_{low}") < 50, F.concat(F.lit(f"small_{low}_dataset:"), F.col(f"n_{low}").cast("string"))))
        parts.append(F.when(F.size(missing) > 0, F.concat(F.lit(f"missing_split_for_{low}:"), F.array_join(missing, ","))))
    out = df.agg(*aggs)
    return out.select(*[f"n_{s.lower()}" for s in stages], F.array_sort(F.array_compact(F.array(*parts))).alias("warnings"))
