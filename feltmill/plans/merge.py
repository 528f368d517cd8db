"""Merge labelled sources into one staged, split dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import reports as P
from ..operators.library import glue
from ..operators.splits import STAGES, stage_split
from ..schemas import MODEL_COLUMNS
from ..sources.sinks import write_stages

KEYS = ("source_dataset", "source_row_id", "hand_id")


@dataclass(frozen=True)
class Merged:
    rows: DataFrame
    reports: dict[str, DataFrame]


def scenario_source(df: DataFrame, name: str = "scenarios") -> DataFrame:
    """Labelled scenario export to merge columns."""
    have = set(df.columns)
    return N.coerce_features(
        df.select(
            *[N.col(c) for c in MODEL_COLUMNS if c in have], F.coalesce(F.upper("bootstrap_label"), F.lit("")).alias("label_3intent"), F.lit(name).alias("source_dataset"),
            F.col("snapshot_id").alias("source_row_id"), (F.col("hand_id") if "hand_id" in have else F.lit(None)).cast("string").alias("hand_id"), F.lit("solver_oracle").alias("source_type"),
        )
    )


def external_source(model_input: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """External export to merge columns; without a feature file the shorter feature frame is derived."""
    if features is None:
        features = N.feature_frame(model_input, with_history=False)
    wide = glue(model_input, features)
    label = F.coalesce(F.upper("label_3intent"), F.lit(""))
    return N.coerce_features(
        wide.select(*[N.col(c) for c in MODEL_COLUMNS if c in wide.columns], label.alias("label_3intent"), "source_dataset", "source_row_id", F.col("hand_id").cast("string").alias("hand_id"), F.lit("external_solver_like").alias("source_type"))
    )


def merge(sources: list[DataFrame], seed: int = 17) -> Merged:
    """Union, stage, unit and split; reports are small tables. Behavioral sources do not belong here."""
    if not sources:
        raise FileNotFoundError("no_merge_sources_available")
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows = rows.withColumns(
        {
            "stage_group": N.stage_group(N.col("metadata.street"), N.col("features.board_card_count")),
            "split_unit": N.split_unit(F.col("source_dataset"), F.col("hand_id"), F.col("source_row_id")),
        }
    )
    split = stage_split(rows, seed=seed)
    staged = split.filter(F.col("stage_group").isin(*STAGES))
    return Merged(
        split,
        {
            "source_rows": P.value_counts(split, "source_dataset"),
            "stage_group_distribution": P.value_counts(split, "stage_group"),
            "label_distribution_by_stage": P.nested_counts(staged, "stage_group", "label_3intent"),
            "label_distribution_by_source": P.nested_counts(staged, "source_dataset", "label_3intent"),
            "split_distribution_by_stage": P.nested_counts(staged, "stage_group", "split"),
            "missing_feature_rates": P.missing_rates(staged, list(MODEL_COLUMNS)),
            "warnings": P.merge_warnings(split),
        },
    )


def write(merged: Merged, path: str, force: bool = False) -> dict[str, str]:
    paths = write_stages(merged.rows, path, force=force)
    for name, report in merged.reports.items():
        report.write.mode("overwrite" if force else "errorifexists").json(f"{path}/report/{name}")
    return paths
