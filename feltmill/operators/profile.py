"""Feature statistics, leakage suspects, correlations, schemas of JSON rows and feature contracts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import half_even, is_null_like, to_double
from ..schemas import is_leakage
from ..session import stored
from .normalize import col

# When a feature is constant or suspiciously tied to the label.
NEAR_ZERO, ZERO_SHARE, SPREAD_SHARE, BINARY_SPREAD = 1e-12, 0.995, 0.8, 0.75


def feature_values(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, label, value, number, n): the value counts that every statistic below is derived from.

    One aggregation over the unpivoted rows; equal values meet on the map side, so a value held by a
    third of the rows travels as one row per task.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), col(f).cast("string").alias("value")) for f in features]))
    long = df.select(col(label).cast("string").alias("label"), pairs.alias("p")).select("label", "p.feature", "p.value")
    counted = long.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("number", to_double(F.col("value")))


def _moments(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted mean and population deviation per key, in two exact steps."""
    known = values.filter("number IS NOT NULL").groupBy(*keys, "number").agg(F.sum("n").alias("n"))
    means = known.groupBy(*keys).agg(
        F.sum("n").alias("numbers"), (F.sum(F.col("number") * F.col("n")) / F.sum("n")).alias("mean"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.sum(F.when(F.abs("number") <= NEAR_ZERO, F.col("n")).otherwise(0)).alias("zeros"),
    )
    spread = known.join(means.select(*keys, "mean"), list(keys)).groupBy(*keys).agg(
        F.sqrt(F.sum(F.col("n") * F.pow(F.col("number") - F.col("mean"), 2)) / F.sum("n")).alias("std")
    )
    return means.join(spread, list(keys))


def feature_statistics(values: DataFrame, digits: int = 6) -> DataFrame:
    """Per feature: rows, nulls, distinct values, min, max, mean, deviation and share of zeros."""
    base = values.groupBy("feature", "value").agg(F.sum("n").alias("n")).groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.when(is_null_like(F.col("value"), "audit"), F.col("n")).otherwise(0)).alias("null_count"), F.count(F.lit(1)).alias("nunique")
    )
    stats = base.join(_moments(values, ["feature"]), "feature", "left")
    return stats.select(
        "feature", "rows", "null_count", "nunique", *[half_even(F.col(c), digits).alias(c) for c in ("min", "max", "mean", "std")],
        half_even(F.coalesce("zeros", F.lit(0)) / F.col("rows"), digits).alias("zero_proportion"),
    )


def label_statistics(values: DataFrame, digits: int = 6) -> DataFrame:
    """Count, mean and deviation per feature and label."""
    counts = values.groupBy("feature", "label").agg(F.sum("n").alias("count"))
    out = counts.join(_moments(values, ["feature", "label"]), ["feature", "label"], "left")
    return out.select("feature", "label", "count", half_even(F.col("mean"), digits).alias("mean"), half_even(F.col("std"), digits).alias("std"))


def top_values(values: DataFrame, k: int, by: Sequence[str] = ("feature",)) -> DataFrame:
    """The k most frequent values per feature; ties go to the smaller value."""
    counts = values.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def constant_features(stats: DataFrame) -> DataFrame:
    """Features with one value, no spread, or almost only zeros."""
    return stats.filter((F.col("nunique") <= 1) | (F.abs("std") <= NEAR_ZERO) | (F.col("zero_proportion") >= ZERO_SHARE))


def suspect_features(stats: DataFrame, by_label: DataFrame) -> DataFrame:
    """Features whose label means are spread over most of their range."""
    means = by_label.filter("mean IS NOT NULL").groupBy("feature").agg(
        F.count(F.lit(1)).alias("labels"), (F.max("mean") - F.min("mean")).alias("spread"), F.max_by("label", F.struct("mean", F.col("label"))).alias("suspected_label"),
        F.min(F.col("mean").isin(0.0, 1.0)).alias("binary"),
    )
    joined = means.join(stats.select("feature", "min", "max"), "feature")
    width = F.col("max") - F.col("min")
    share = F.try_divide(F.col("spread"), width)
    hit = (share >= SPREAD_SHARE) | (F.col("binary") & (F.col("spread") >= BINARY_SPREAD))
    return joined.filter((F.col("labels") >= 2) & (width > NEAR_ZERO) & hit).select(
        "feature", "suspected_label", half_even(F.col("spread"), 6).alias("spread"), half_even(width, 6).alias("global_range"), half_even(share, 6).alias("spread_to_range_ratio")
    )


def label_heatmap(values: DataFrame, digits: int = 6) -> DataFrame:
    """Mean per label scaled to 0 .. 1 across the labels of a feature."""
    means = label_statistics(values, digits).select("feature", "label", "mean")
    row = Window.partitionBy("feature")
    low, high = F.min("mean").over(row), F.max("mean").over(row)
    scaled = F.when(F.col("mean").isNull(), F.lit(None)).when(high == low, 0.0).otherwise(half_even((F.col("mean") - low) / (high - low), digits))
    return means.withColumn("scaled", scaled)


def category_shares(values: DataFrame, k: int) -> DataFrame:
    """Share of the k most frequent values within every label."""
    chosen = top_values(values, k).select("feature", "value", "position")
    totals = values.groupBy("feature", "label").agg(F.sum("n").alias("total"))
    cells = values.groupBy("feature", "label", "value").agg(F.sum("n").alias("n"))
    grid = chosen.join(totals, "feature")
    return grid.join(cells, ["feature", "label", "value"], "left").select(
        "feature", "value", "label", half_even(F.coalesce("n", F.lit(0)) / F.col("total"), 6).alias("share")
    )


def cardinality(df: DataFrame, columns: Sequence[str], list_up_to: int) -> DataFrame:
    """Distinct values per column, with the sorted values while there are few of them.

    Only the first `list_up_to` + 1 values of a column are ever collected.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in columns]))
    values = df.select(pairs.alias("p")).select("p.feature", "p.value").distinct()
    order = Window.partitionBy("feature").orderBy("value")
    few = values.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= list_up_to + 1).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("_values"))
    counts = values.groupBy("feature").agg(F.count(F.lit(1)).alias("cardinality"))
    return counts.join(few, "feature").select("feature", "cardinality", F.when(F.size("_values") <= list_up_to, F.col("_values")).alias("values"))


def label_ids(df: DataFrame, label: str) -> DataFrame:
    """Label to id in sorted order."""
    return df.select(col(label).alias("label")).distinct().withColumn("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("label")) - 1)


# ---- correlations ----------------------------------------------------------------------------

# Feature pairs that are redundant by construction.
REDUNDANT_PAIRS = (
    ("features.equity_1v1", "features.equity_table"),
    ("features.effective_stack", "features.hero_stack"),
    ("features.equity_required", "features.to_call"),
)
LIVE_PAIRS = (
    ("features.has_call", "features.has_check"),
    ("features.equity_gap", "features.equity_table"),
    ("features.equity_required", "features.to_call_bb"),
    ("features.effective_stack_bb", "features.hero_stack_bb"),
)


def encoded(df: DataFrame, numeric: Sequence[str], categorical: dict[str, Sequence[str]]) -> tuple[DataFrame, list[str]]:
    """Numbers as they are (null 0), categories as one 0/1 column per listed value."""
    columns = [F.coalesce(col(n).cast("double"), F.lit(0.0)).alias(n) for n in numeric]
    for name, values in categorical.items():
        up = F.coalesce(col(name).cast("string"), F.lit("UNKNOWN"))
        columns += [F.when(up == v, 1.0).otherwise(0.0).alias(f"{name}={v}") for v in values]
    out = df.select(*columns)
    return out, out.columns


def correlation_matrix(df: DataFrame, constant_diagonal: float = 0.0) -> np.ndarray:
    """Pearson matrix of all columns; only d x d numbers reach the driver.

    A constant column correlates with nothing; its own cell is 0 or 1 by `constant_diagonal`.
    """
    safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    vectors = VectorAssembler(inputCols=safe.columns, outputCol="v", handleInvalid="keep").transform(safe).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    flat = np.isnan(matrix).sum(axis=0) >= len(matrix) - 1 if len(matrix) > 1 else np.isnan(matrix).any(axis=0)
    out = np.nan_to_num(matrix, nan=0.0, posinf=0.0, neginf=0.0)
    for i, constant in enumerate(flat):
        if constant:
            out[i, i] = constant_diagonal
    return out


def correlation_rows(df: DataFrame, matrix: np.ndarray, names: Sequence[str]) -> DataFrame:
    rows = [(names[i], names[j], float(matrix[i, j])) for i in range(len(names)) for j in range(i + 1, len(names))]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def pair_comment(a: Column, b: Column, strength: Column, live: bool = False) -> Column:
    """Reading of a correlated pair; the live export knows other pairs and one band less."""
    low, high = F.least(F.substring_index(a, "=", 1), F.substring_index(b, "=", 1)), F.greatest(F.substring_index(a, "=", 1), F.substring_index(b, "=", 1))
    listed = F.lit(False)
    for x, y in LIVE_PAIRS if live else REDUNDANT_PAIRS:
        listed = listed | ((low == x) & (high == y))
    if live:
        return F.when(strength > 0.95, "suspect_redundant").when(listed, "redondant").otherwise("acceptable_monitor")
    return F.when((strength > 0.95) | listed, "suspect_redundant").when(strength > 0.90, "redondant").otherwise("acceptable_monitor")


def high_pairs(rows: DataFrame, threshold: float = 0.80, live: bool = False) -> DataFrame:
    """Pairs above the threshold, strongest first, then by name."""
    strength = F.abs("correlation")
    out = rows.filter(strength > threshold).select(
        "feature_a", "feature_b", half_even(F.col("correlation"), 6).alias("correlation"), half_even(strength, 6).alias("abs_correlation"),
        pair_comment(F.col("feature_a"), F.col("feature_b"), strength, live).alias("comment"),
    )
    return out.orderBy(F.desc("abs_correlation"), "feature_a", "feature_b")


def variance_inflation(matrix: np.ndarray) -> list[float]:
    """Diagonal of the inverse correlation: at least 1, infinite for a duplicate column. d x d on the driver."""
    try:
        inverse = np.linalg.inv(matrix)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(matrix)
    off = np.abs(matrix - np.diag(np.diag(matrix)))
    return [float("inf") if (off[i] >= 0.999999).any() else max(1.0, float(inverse[i, i])) for i in range(len(matrix))]


def feature_advice(vif: Column, suspect_pair: Column, feature: Column) -> Column:
    return (
        F.when(feature.endswith("=IP") | feature.endswith("=OOP"), "fusionner").when(vif >= 10, "supprimer").when(suspect_pair, "fusionner").otherwise("garder")
    )


def curve_diagnostic(train: Column, validation: Column) -> Column:
    return (
        F.when((train > 0.95) & (train - validation > 0.08), "overfit_probable").when((train < 0.65) & (validation < 0.65), "underfit_probable").otherwise("acceptable")
    )


# ---- schemas of JSON rows --------------------------------------------------------------------


def variant_kind(value: Column) -> Column:
    """empty / bool / int / float / string / array / object of a VARIANT."""
    text = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (text == "VOID"), "empty").when(text == "BOOLEAN", "bool").when(text == "BIGINT", "int")
        .when(text.startswith("DECIMAL") | text.isin("DOUBLE", "FLOAT"), "float").when(text.startswith("ARRAY"), "array").when(text.startswith("OBJECT"), "object").otherwise("string")
    )


def json_schema(df: DataFrame, raw: str, categories: int) -> DataFrame:
    """Schema of JSON object rows: (path, present_count, required, types, empty_count, categorical_values).

    Objects are opened level by level until none holds another. A path is required when every object that
    could hold it does. Types of empty values do not count.
    """
    spark = df.sparkSession
    level = df.select(F.try_parse_json(raw).alias("value"), F.lit("").alias("parent")).filter("value IS NOT NULL")
    level = stored(level.filter(variant_kind(F.col("value")) == "object"), "objects")
    parents = level.groupBy("parent").agg(F.count(F.lit(1)).alias("parents"))
    parts, totals = [], [parents]
    while not parts or not level.isEmpty():
        opened = spark.sql("SELECT parent, e.key AS key, e.value AS value FROM {level}, LATERAL variant_explode(value) AS e", level=level)
        path = F.when(F.col("parent") == "", F.col("key")).otherwise(F.concat_ws(".", "parent", "key"))
        rows = opened.select("parent", path.alias("path"), "value", variant_kind(F.col("value")).alias("kind"))
        # Stored, or every later level and count parses the whole input again. Texts of numbers are never looked at.
        rows = stored(rows.select("parent", "path", "kind", F.when(F.col("kind") == "object", F.col("value")).alias("value"), F.when(F.col("kind").isin("string", "bool"), F.try_variant_get("value", "$", "string")).alias("text")), "level")
        parts.append(rows.select("parent", "path", "kind", "text"))
        level = rows.filter("kind = 'object'").select("value", F.col("path").alias("parent"))
        totals.append(level.groupBy("parent").agg(F.count(F.lit(1)).alias("parents")))
    rows, counts = parts[0], totals[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    for total in totals[1:]:
        counts = counts.unionByName(total)
    blank = (F.col("kind") == "empty") | ((F.col("kind") == "string") & is_null_like(F.col("text"), "schema"))
    rows = rows.withColumn("kind", F.when(blank, "empty").otherwise(F.col("kind")))
    values = rows.groupBy("parent", "path", "kind", "text").agg(F.count(F.lit(1)).alias("n"))
    simple = F.col("kind").isin("string", "bool")
    order = Window.partitionBy("parent", "path").orderBy("text")
    few = (
        values.filter(simple).select("parent", "path", "text").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= categories + 1)
        .groupBy("parent", "path").agg(F.array_sort(F.collect_list("text")).alias("_values"))
    )
    base = values.groupBy("parent", "path").agg(
        F.sum("n").alias("present_count"), F.sum(F.when(F.col("kind") == "empty", F.col("n")).otherwise(0)).alias("empty_count"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "empty", F.col("kind")))).alias("types"), F.min(simple | (F.col("kind") == "empty")).alias("_simple"),
    )
    out = base.join(few, ["parent", "path"], "left").join(counts, "parent")
    return out.select(
        "path", "present_count", (F.col("present_count") == F.col("parents")).alias("required"),
        F.when(F.size("types") == 0, F.array(F.lit("empty"))).otherwise(F.col("types")).alias("types"), "empty_count",
        F.when(F.col("_simple") & (F.size("_values") <= categories), F.col("_values")).alias("categorical_values"),
    )


def cell_kind(c: Column) -> Column:
    """Type of a CSV cell: empty / bool / json_array / json_object / int / float / string."""
    text = F.trim(c)
    low = F.lower(text)
    doc = F.try_parse_json(text)
    kind = variant_kind(doc)
    return (
        F.when(is_null_like(c, "schema"), "empty").when(low.isin("true", "false"), "bool")
        .when(text.startswith("[") & (kind == "array"), "json_array").when(text.startswith("{") & (kind == "object"), "json_object")
        .when(text.rlike(r"^[+-]?[0-9]+$"), "int").when(to_double(c).isNotNull() | low.isin("nan", "inf", "-inf", "infinity"), "float").otherwise("string")
    )


def csv_schema(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Types and empty counts per text column: (path, types, present_count, empty_count)."""
    names = list(columns or df.columns)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("path"), cell_kind(col(c).cast("string")).alias("kind")) for c in names]))
    kinds = df.select(pairs.alias("p")).select("p.path", "p.kind").groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    out = kinds.groupBy("path").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") != "empty", F.col("kind")))).alias("types"), F.sum("n").alias("present_count"),
        F.sum(F.when(F.col("kind") == "empty", F.col("n")).otherwise(0)).alias("empty_count"),
    )
    return out.withColumn("types", F.when(F.size("types") == 0, F.array(F.lit("empty"))).otherwise(F.col("types")))


def schema_diff(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Reference against current (path, types): missing, extra, incompatible, empty or ok.

    Whole and decimal numbers agree, and so do JSON text cells with arrays and objects.
    """

    def families(types: Column) -> Column:
        named = F.transform(
            types,
            lambda t: F.when(t.isin("int", "float"), "number").when(t == "json_array", "array").when(t == "json_object", "object").otherwise(t),
        )
        return F.array_distinct(named)

    joined = reference.select("path", F.col("types").alias("reference_types")).join(current.select("path", F.col("types").alias("current_types")), "path", "full_outer")
    only_empty = F.col("current_types") == F.array(F.lit("empty"))
    status = (
        F.when(F.col("current_types").isNull(), "missing").when(F.col("reference_types").isNull(), "extra").when(only_empty, "empty")
        .when(F.arrays_overlap(families(F.col("reference_types")), families(F.col("current_types"))), "ok").otherwise("incompatible")
    )
    return joined.withColumn("status", status)


def alignment_status(diff: DataFrame, model_columns: Sequence[str]) -> DataFrame:
    """One row: counts per status, leakage columns used by the model, and the verdict."""
    leaking = [c for c in model_columns if is_leakage(c)]
    out = diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "extra", "incompatible", "empty", "ok")])
    verdict = F.when((F.col("missing") == 0) & F.lit(not leaking), "aligned").otherwise("needs_review")
    return out.withColumns({"leakage_used": F.lit(len(leaking)), "alignment_status": verdict})


def feature_contract(df: DataFrame, stats: DataFrame, candidates: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per column of a table: used, constant, leakage, audit only, target or not available yet."""
    names = df.sparkSession.createDataFrame([(c, c in candidates, is_leakage(c), c in targets) for c in df.columns], "feature string, candidate boolean, leaking boolean, target boolean")
    flagged = stats.select(
        "feature", ((F.col("nunique") <= 1) | (F.abs("std") <= NEAR_ZERO) | (F.col("zero_proportion") >= ZERO_SHARE)).alias("constant"), (F.col("null_count") >= F.col("rows")).alias("absent")
    )
    joined = names.join(flagged, "feature", "left")
    status = (
        F.when(F.col("target"), "target").when(F.col("leaking"), "leakage_excluded").when(~F.col("candidate"), "audit_only").when(F.col("absent"), "not_available_yet")
        .when(F.col("constant"), "constant_excluded").otherwise("model_used")
    )
    return joined.select("feature", status.alias("status"))
