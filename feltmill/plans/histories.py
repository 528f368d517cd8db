"""Hand-history text to snapshots, jobs and a stage ledger. Run results come in as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import replay as R
from ..sources.files import history_sections


@dataclass(frozen=True)
class Histories:
    hands: DataFrame
    snapshots: DataFrame
    jobs: DataFrame
    ledger: DataFrame


def job_rows(snapshots: DataFrame, iterations: int = 25, timeout_s: float = 5.0) -> DataFrame:
    """Accepted snapshots as job columns, ready for validation."""
    return snapshots.filter("status = 'ok'").select(
        F.concat(F.lit("solver_job_from_"), F.col("snapshot_id")).alias("solver_job_id"), F.col("snapshot_id").alias("source_snapshot_id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        F.lit(J.SCHEMA_VERSION).alias("schema_version"), F.lit("text_history").alias("source_type"), F.lit("chips").alias("units"), "street", F.col("hero_cards").alias("hero_hand"), "villain_hand",
        F.lit(None).cast("string").alias("villain_range"), F.col("board_cards").alias("board"), F.col("pot").cast("string").alias("pot"), F.col("to_call").cast("string").alias("to_call"), F.lit("1000.0").alias("stack"),
        F.array(F.lit("0.33")).alias("bet_sizes"), F.lit(str(iterations)).alias("iterations"), F.lit(str(timeout_s)).alias("timeout_s"), F.lit("rust").alias("backend"), F.lit("solver_smoke").alias("label_intent"),
    )


def run(sections: DataFrame, keys: list[str], hero: str, street: str = "RIVER", to_call: float | None = 0.0, runs: DataFrame | None = None) -> Histories:
    """Sections (one hand per row) through parse, snapshot and job validation."""
    hands = R.parse_text_hands(sections, keys, hero=hero)
    shots = R.hand_snapshots(hands.filter("status = 'ok'"), street, F.lit(to_call).cast("double"))
    jobs = J.validate_jobs(job_rows(shots))
    return Histories(hands, shots, jobs, R.stage_ledger(hands, shots, runs))


def run_files(spark: SparkSession, path: str, hero: str, **options) -> Histories:
    return run(history_sections(spark, path), ["path", "section_id"], hero, **options)
