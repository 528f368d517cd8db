"""Sinks: JSONL, flat CSV, split and stage fan-outs, export bundles and run records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import json_text
from ..operators import normalize as N
from ..operators import reports as P
from ..operators.runs import forced_quality
from ..schemas import AUDIT_RAW_COLUMNS, FORBIDDEN_LABELS, MODEL_COLUMNS, NORMALIZED_COLUMNS, check_matrix, check_normalized

# Label fields that no run record may carry.
RUN_FORBIDDEN = ("training_label", "gto_label", "label_action")


def _mode(force: bool) -> str:
    return "overwrite" if force else "errorifexists"


def write_jsonl(df: DataFrame, path: str, force: bool = False, forbidden: Sequence[str] = FORBIDDEN_LABELS) -> None:
    """JSON lines with sorted keys; forbidden label fields are left out and nulls are kept."""
    names = sorted(c for c in df.columns if c not in forbidden)
    df.select(*[N.col(c) for c in names]).write.mode(_mode(force)).option("ignoreNullFields", False).json(path)


def flat(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The columns in order; lists, maps and structs as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[(json_text(N.col(c)) if c in nested else N.col(c)).alias(c) for c in order])


def write_csv(df: DataFrame, path: str, order: Sequence[str] | None = None, force: bool = False, by: Sequence[str] = ()) -> None:
    order = list(order or df.columns)
    writer = flat(df, [*order, *[c for c in by if c not in order]]).write.mode(_mode(force)).option("header", True).option("escape", '"')
    (writer.partitionBy(*by) if by else writer).csv(path)


def write_splits(df: DataFrame, path: str, features: Sequence[str] = MODEL_COLUMNS, key: str = "snapshot_id", label: str = "bootstrap_label", audit: Sequence[str] = (), force: bool = False) -> dict[str, str]:
    """Model input, features, labels, audit rows and JSON lines of a split dataset; the split is a folder."""
    check_matrix(list(features))
    paths = {name: f"{path}/{name}" for name in ("model_input", "X", "y", "audit_candidates", "dataset_jsonl")}
    write_csv(df, paths["model_input"], [key, *features, label], force, ["split"])
    write_csv(df, paths["X"], features, force, ["split"])
    write_csv(df, paths["y"], [key, label], force, ["split"])
    write_csv(df, paths["audit_candidates"], [key, "split", *features, *audit, label], force)
    write_jsonl(df, paths["dataset_jsonl"], force)
    return paths


def write_stages(df: DataFrame, path: str, audit: DataFrame | None = None, force: bool = False) -> dict[str, str]:
    """Merged rows by stage and split: model input, features, labels; the audit rows carry a note."""
    keys = ["source_dataset", "source_row_id", "hand_id"]
    staged = df.filter(F.col("stage_group").isin("PREFLOP", "POSTFLOP"))
    paths = {name: f"{path}/{name}" for name in ("model_input", "model_input_by_stage", "X", "y", "audit_candidates")}
    write_csv(df, paths["model_input"], [*keys, "stage_group", "split", *MODEL_COLUMNS, "label_3intent"], force)
    write_csv(staged, paths["model_input_by_stage"], [*keys, "split", *MODEL_COLUMNS, "label_3intent"], force, ["stage_group"])
    check_matrix(list(MODEL_COLUMNS))
    write_csv(staged, paths["X"], MODEL_COLUMNS, force, ["stage_group", "split"])
    write_csv(staged, paths["y"], ["source_dataset", "source_row_id", "label_3intent"], force, ["stage_group", "split"])
    rows = audit if audit is not None else df
    note = F.lit("source audit row; not model input")
    write_csv(rows.withColumn("audit_note", F.coalesce(F.col("audit_note"), note) if "audit_note" in rows.columns else note), paths["audit_candidates"], force=force)
    return paths


def write_export(rows: DataFrame, audit: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Export bundle of one external source; returns its report rows (section, key, value)."""
    check_normalized(rows.columns)
    usable = N.usable_rows(rows)
    write_csv(usable, f"{path}/model_input", NORMALIZED_COLUMNS, force)
    write_csv(N.feature_frame(usable), f"{path}/model_features_20", force=force)
    write_csv(audit, f"{path}/audit_candidates", [*NORMALIZED_COLUMNS, *[c for c in AUDIT_RAW_COLUMNS if c in audit.columns]], force)
    report = export_report(rows)
    report.write.mode(_mode(force)).json(f"{path}/dataset_report")
    return report


def export_report(rows: DataFrame) -> DataFrame:
    """Rows loaded, usable and dropped, label and action counts, and missing rates as (section, key, value)."""
    usable = F.length("label_3intent") > 0

    def section(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    totals = rows.agg(F.count(F.lit(1)).alias("rows_loaded"), F.count_if(usable).alias("rows_usable")).withColumn("rows_dropped", F.col("rows_loaded") - F.col("rows_usable"))
    long = totals.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).alias("v")) for c in totals.columns])).alias("p"))
    out = section(long, "totals", F.col("p.k"), F.col("p.v"))
    for name, column in (("label_distribution_3intent", "label_3intent"), ("raw_action_distribution", "raw_action")):
        source = rows.filter(usable) if column == "label_3intent" else rows.filter(F.col(column).isNotNull())
        out = out.unionByName(section(P.value_counts(source, column), name, F.col("value"), F.col("n")))
    return out.unionByName(section(P.missing_rates(rows, NORMALIZED_COLUMNS), "missing_field_rates", F.col("field"), F.col("missing_rate")))


def run_record_rows(df: DataFrame) -> DataFrame:
    """Run rows in their envelope: never a label candidate, quality always present, status from result or error."""
    have = set(df.columns)
    status = F.coalesce(
        F.nullif("solver_status", F.lit("")),
        F.when(F.col("solver_result").isNull(), F.when(F.col("error").isNotNull(), "failed").otherwise("skipped")).when(F.col("solver_result.status") == "ok", "ok").otherwise("failed"),
    )
    stamp = F.coalesce("recorded_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")) if "recorded_at" in have else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    changed = {"record_type": F.lit("solver_run_result"), "solver_status": status, "recorded_at": stamp, "quality": forced_quality(F.col("quality"))}
    return df.withColumns(changed).drop(*RUN_FORBIDDEN)


def write_run_records(df: DataFrame, path: str, force: bool = False) -> None:
    write_jsonl(run_record_rows(df), path, force, RUN_FORBIDDEN)


def write_strict(df: DataFrame, path: str, order: str = "snapshot_id", force: bool = False) -> DataFrame:
    """Write rows without rejection reasons; returns the rejected ones."""
    good = df.filter(F.size("reasons") == 0)
    write_jsonl(good.drop("reasons"), path, force)
    return df.filter(F.size("reasons") > 0).select(order, "reasons")


def combine_jsonl(spark: SparkSession, inputs: Sequence[str], path: str, force: bool = False) -> int:
    """Lines of several files in one place; blank lines and missing inputs are skipped. Returns the inputs used."""
    frames = []
    for name in inputs:
        try:
            frames.append(spark.read.text(name).filter(F.length(F.trim("value")) > 0))
        except AnalysisException:
            continue
    if frames:
        both = frames[0]
        for frame in frames[1:]:
            both = both.unionByName(frame)
        both.write.mode(_mode(force)).text(path)
    return len(frames)
