"""Column lists and struct types of the tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of a normalized external row, in order.
NORMALIZED_COLUMNS = (
    "source_dataset", "source_row_id", "source_split", "hand_id", "street", "hero_position",
    "villain_position", "hero_cards", "board_cards", "pot_size", "effective_stack", "action_history",
    "legal_actions", "raw_action", "normalized_action_4class", "label_3intent", "bet_size", "ev",
    "equity", "source_license", "source_url", "leakage_risk_notes",
)
NORMALIZED_DOUBLES = ("pot_size", "effective_stack", "bet_size", "ev", "equity")
# Raw columns that only the audit table may hold.
AUDIT_RAW_COLUMNS = (
    "raw_prompt", "raw_instruction", "raw_response", "raw_output",
    "raw_chosen", "raw_rejected", "raw_metadata_json", "raw_record_json",
)
# The model matrix of the scenario data.
MODEL_NUMERIC = (
    "features.pot_bb", "features.to_call_bb", "features.hero_stack_bb", "features.effective_stack_bb",
    "features.stack_to_pot_ratio", "features.to_call_pot_ratio", "features.has_check", "features.has_fold",
    "features.has_call", "features.has_raise", "features.num_players", "features.num_bets",
    "features.board_card_count", "features.action_count", "features.prior_check_count",
    "features.prior_call_count", "features.prior_bet_raise_count", "features.prior_fold_count",
)
MODEL_CATEGORICAL = ("metadata.street", "features.hero_position")
MODEL_COLUMNS = MODEL_NUMERIC + MODEL_CATEGORICAL
# The live matrix in big blinds.
LIVE_NUMERIC = (
    "features.pot_bb", "features.to_call_bb", "features.ev_bb", "features.call_max_bb", "features.equity_table",
    "features.equity_1v1", "features.equity_required", "features.equity_gap", "features.hero_stack_bb",
    "features.effective_stack_bb", "features.stack_to_pot_ratio", "features.to_call_pot_ratio",
    "features.has_check", "features.has_call", "features.has_raise", "features.active_opponents",
)
# The bootstrap matrix and the older names its columns are read from.
BOOTSTRAP_NUMERIC = (
    "features.pot", "features.to_call", "features.to_call_pot_ratio", "features.equity_table",
    "features.equity_1v1", "features.equity_known", "features.equity_required", "features.equity_gap",
    "features.ev", "features.call_max", "features.player_start", "features.player_active",
    "features.active_opponents", "features.board_card_count", "features.hero_cards_known",
    "features.opponent_looseness_avg", "features.opponent_aggression_avg", "features.opponent_confidence_avg",
    "features.hero_stack", "features.effective_stack", "features.stack_to_pot_ratio",
    "features.has_check", "features.has_call", "features.has_raise",
)
BOOTSTRAP_CATEGORICAL = ("metadata.street", "features.hero_position")
FEATURE_ALIASES = {
    "metadata.street": ("street",),
    "features.hero_position": ("hero_position", "position_model"),
    "features.pot": ("pot",),
    "features.to_call": ("to_call",),
    "features.to_call_pot_ratio": ("to_call_pot_ratio", "to_call_ratio"),
    "features.equity_table": ("equity_table",),
    "features.equity_1v1": ("equity_1v1",),
    "features.equity_known": ("equity_known",),
    "features.ev": ("ev",),
    "features.call_max": ("call_max",),
    "features.board_card_count": ("board_card_count",),
    "features.player_start": ("player_start",),
    "features.player_active": ("player_active",),
    "features.hero_stack": ("stack",),
    "features.effective_stack": ("stack",),
    "features.has_check": ("has_check", "is_check_or_bet_context"),
    "features.has_call": ("has_call",),
    "features.has_raise": ("has_raise",),
}
# Column prefixes and names that must never enter a model matrix.
LEAKAGE_PREFIXES = ("labels.", "debug.", "audit.", "quality_flags.")
LEAKAGE_NAMES = ("metadata.label_source", "label_source", "bootstrap_label", "normalized_label")
FORBIDDEN_LABELS = ("gto_label", "training_label")
# Fields a job row must have, in the order they are reported.
JOB_FIELDS = (
    "solver_job_id", "source_snapshot_id", "created_at", "schema_version", "source_type", "units", "street",
    "hero_hand", "villain_hand", "villain_range", "board", "pot", "to_call", "stack", "bet_sizes",
    "iterations", "timeout_s", "backend", "label_intent",
)

NORMALIZED = T.StructType(
    [T.StructField(c, T.DoubleType() if c in NORMALIZED_DOUBLES else T.StringType()) for c in NORMALIZED_COLUMNS]
)

PROMPT_RECORD = T.StructType(
    [
        T.StructField("_source_row_idx", T.LongType()),
        T.StructField("_source_split", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in ("prompt", "instruction", "response", "output", "chosen", "rejected", "action", "hand_id", "street", "position", "hole_cards", "board")],
        T.StructField("pot", T.DoubleType()),
        T.StructField("bet_amount", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

BUTTON = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("state", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
PLAYER = T.StructType(
    [
        T.StructField("seat", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("active", T.BooleanType()),
        T.StructField("active_at_start", T.BooleanType()),
        T.StructField("changed_this_round", T.BooleanType()),
        T.StructField("stack", T.DoubleType()),
        T.StructField("stack_start", T.DoubleType()),
        T.StructField("stack_bb", T.DoubleType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
SNAPSHOT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("recorded_at", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType([T.StructField(c, T.StringType()) for c in ("game", "hand_id", "street", "status", "label_source", "source_type", "units")]),
        ),
        T.StructField(
            "features",
            T.StructType(
                [
                    T.StructField("hero_cards", T.ArrayType(T.StringType())),
                    T.StructField("board_cards", T.ArrayType(T.StringType())),
                    T.StructField("villain_hand", T.ArrayType(T.StringType())),
                    T.StructField("villain_range", T.StringType()),
                    T.StructField("street", T.StringType()),
                    T.StructField("hero_position", T.StringType()),
                    *[T.StructField(c, T.DoubleType()) for c in (
                        "player_start", "player_active", "active_opponents", "pot", "pot_bb", "to_call", "to_call_bb", "stack",
                        "effective_stack", "hero_stack", "to_call_pot_ratio", "equity_table", "equity_1v1", "equity_required",
                        "ev", "ev_bb", "call_max", "call_max_bb", "amount_unit_value", "big_blind", "solver_iterations", "solver_timeout_s",
                    )],
                    T.StructField("decision_context_known", T.BooleanType()),
                    *[T.StructField(c, T.BooleanType()) for c in ("has_check", "has_call", "has_raise")],
                    T.StructField("buttons", T.ArrayType(BUTTON)),
                    T.StructField("buttons_active", T.ArrayType(T.StringType())),
                    T.StructField("players", T.ArrayType(PLAYER)),
                    T.StructField("units", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "labels",
            T.StructType(
                [
                    T.StructField("legacy_action", T.StringType()),
                    T.StructField("final_action", T.StringType()),
                    T.StructField("label_valid", T.BooleanType()),
                    T.StructField("known_bug_risk", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("confidence", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField(
            "quality_flags",
            T.StructType([T.StructField(c, T.BooleanType()) for c in ("usable_for_training", "usable_for_solver", "amount_unit_missing")]),
        ),
        T.StructField("debug", T.MapType(T.StringType(), T.StringType())),
    ]
)

RUN_RESULT = T.StructType(
    [
        T.StructField("record_type", T.StringType()),
        T.StructField("solver_job_id", T.StringType()),
        T.StructField("source_snapshot_id", T.StringType()),
        T.StructField("recorded_at", T.StringType()),
        T.StructField("solver_status", T.StringType()),
        T.StructField(
            "solver_job",
            T.StructType(
                [T.StructField(c, T.StringType()) for c in ("solver_job_id", "generation_profile", "street", "hero_position_model", "decision_context_type")]
                + [T.StructField(c, T.DoubleType()) for c in ("pot", "to_call", "stack")]
                + [T.StructField("iterations", T.LongType())]
                + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("hero_hand", "villain_hand", "board")]
            ),
        ),
        T.StructField(
            "solver_result",
            T.StructType(
                [
                    T.StructField("status", T.StringType()),
                    T.StructField("solver_job_id", T.StringType()),
                    T.StructField("duration_ms", T.DoubleType()),
                    T.StructField(
                        "output",
                        T.StructType(
                            [
                                T.StructField("iterations", T.LongType()),
                                T.StructField("exploitability_last", T.DoubleType()),
                                T.StructField("exploitability_history", T.ArrayType(T.DoubleType())),
                                T.StructField("root_matches_hero", T.BooleanType()),
                                T.StructField("root_player_role", T.StringType()),
                                T.StructField(
                                    "root_strategy_raw",
                                    T.StructType(
                                        [
                                            T.StructField("action_labels", T.ArrayType(T.StringType())),
                                            T.StructField("frequencies", T.ArrayType(T.DoubleType())),
                                            T.StructField("hero_solver_player", T.LongType()),
                                            T.StructField("root_player", T.LongType()),
                                            T.StructField("root_player_role", T.StringType()),
                                            T.StructField("root_matches_hero", T.BooleanType()),
                                        ]
                                    ),
                                ),
                            ]
                        ),
                    ),
                ]
            ),
        ),
        T.StructField(
            "quality",
            T.StructType(
                [
                    T.StructField("iterations", T.LongType()),
                    T.StructField("exploitability_last", T.DoubleType()),
                    T.StructField("is_label_candidate", T.BooleanType()),
                    T.StructField("exclusion_reason", T.StringType()),
                ]
            ),
        ),
        T.StructField("duration_ms", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)


def is_leakage(column: str, prefixes: tuple[str, ...] = LEAKAGE_PREFIXES, names: tuple[str, ...] = LEAKAGE_NAMES) -> bool:
    return column.startswith(prefixes) or column in names or column in AUDIT_RAW_COLUMNS


def check_matrix(columns: list[str]) -> None:
    """Raise before any write when a forbidden column is in a model matrix. Looks at names only."""
    bad = sorted(c for c in columns if is_leakage(c) or c in FORBIDDEN_LABELS)
    if bad:
        raise ValueError(f"leakage_column_in_features:{bad[0]}")


def check_training_columns(columns: list[str]) -> None:
    forbidden = sorted(set(columns) & set(FORBIDDEN_LABELS))
    if forbidden:
        raise ValueError(f"forbidden_column_present:{forbidden[0]}")
    if "bootstrap_label" not in columns:
        raise ValueError("bootstrap_label_missing")


def check_normalized(columns: list[str]) -> None:
    for column in NORMALIZED_COLUMNS:
        if column not in columns:
            raise ValueError(f"missing_normalized_column:{column}")
