"""Run records to candidates, aligned rows, feature audit and model comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import normalize as N
from ..operators import profile as Q
from ..operators import reports as P
from ..operators import runs as R
from ..operators import snapshots as S
from ..operators import training as M
from ..schemas import BOOTSTRAP_CATEGORICAL, BOOTSTRAP_NUMERIC, FEATURE_ALIASES
from ..sources.generated import weak_rule_rows

DIMENSIONS = ["exclusion_reason", "bootstrap_label", "label_source", "decision_context_type", "street"]


def _named(rows: DataFrame) -> DataFrame:
    """Add `row_index`, the name of a row without an id: a digest of all its columns, and its place among equal rows."""
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    named = rows.filter(F.nullif(F.trim("source_id"), F.lit("")).isNull()).withColumn("_digest", digest)
    same = Window.partitionBy("_digest").orderBy("_digest")
    index = F.concat_ws("_", F.col("_digest"), F.row_number().over(same).cast("string"))
    others = rows.filter(F.nullif(F.trim("source_id"), F.lit("")).isNotNull()).withColumn("row_index", F.lit(""))
    return others.unionByName(named.withColumn("row_index", index).drop("_digest"))


@dataclass(frozen=True)
class Candidates:
    rows: DataFrame
    aligned: DataFrame
    summary: DataFrame
    warnings: DataFrame


def export(runs: DataFrame, top_up: bool = False, min_usable: int = 100, class_floor: int = 10) -> Candidates:
    """Shared run shape to export rows, optionally lifted by weak rules, and their aligned form."""
    rows = R.candidate_rows(runs)
    if top_up:
        rows = rows.unionByName(weak_rule_rows(rows, min_usable, class_floor), allowMissingColumns=True)
    indexed = _named(rows)
    texts = indexed.withColumns({c: F.to_json(c) for c in ("hero_cards", "villain_hand", "board_cards")})
    return Candidates(rows, S.aligned_rows(texts), P.export_summary(rows, DIMENSIONS), P.export_warnings(rows))


def audit(aligned: DataFrame, digits: int = 6) -> dict[str, DataFrame]:
    """Feature statistics, constants, suspects and the contract of the usable rows."""
    usable = aligned.filter(N.col("quality_flags.usable_for_training") & (F.length("bootstrap_label") > 0))
    views = S.feature_views(usable, FEATURE_ALIASES)
    columns = [*BOOTSTRAP_NUMERIC, *BOOTSTRAP_CATEGORICAL]
    values = Q.feature_values(views, columns, "bootstrap_label")
    stats, by_label = Q.feature_statistics(values, digits), Q.label_statistics(values, digits)
    return {
        "statistics": stats, "by_label": by_label, "constant": Q.constant_features(stats), "suspect": Q.suspect_features(stats, by_label),
        "contract": Q.feature_contract(aligned, stats, columns, ["bootstrap_label", "excluded", "exclusion_reason"]),
    }


def train(aligned: DataFrame, settings: M.Settings = M.Settings(), min_rows: int = 100) -> DataFrame:
    """Compare the models on the usable rows with the columns that are not constant."""
    usable = aligned.filter(N.col("quality_flags.usable_for_training") & (F.length("bootstrap_label") > 0))
    n = usable.count()
    if n < min_rows:
        raise ValueError(f"not_enough_rows:{n}<min_rows:{min_rows}")
    constant = {r["feature"] for r in audit(aligned)["constant"].select("feature").collect()}
    matrix = M.Matrix([c for c in BOOTSTRAP_NUMERIC if c not in constant], [c for c in BOOTSTRAP_CATEGORICAL if c not in constant])
    return M.compare_models(S.feature_views(usable, FEATURE_ALIASES), matrix, settings)
