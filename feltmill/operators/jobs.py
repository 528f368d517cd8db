"""Job rows: validation, eligibility, gates, construction and mapping from snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cards as C
from ..functions.rules import first_reason, is_true
from ..functions.values import NUMBER_PATTERN, short_number, strip, to_double, to_int
from ..schemas import JOB_FIELDS

# Bounds and allowed words of a job row.
SCHEMA_VERSION = "solver_job_v1"
SNAPSHOT_VERSION = "ml_dataset_v1"
MAX_ITERATIONS, MAX_TIMEOUT_S, MAX_BET_SIZES = 100, 10.0, 5
JOB_STREETS = {"FLOP": 3, "TURN": 4, "RIVER": 5}
BACKENDS = ("rust", "python")
LABEL_INTENTS = ("solver_smoke", "solver_candidate")
SOURCE_TYPES = ("manual_fixture", "ml_snapshot", "synthetic")
HISTORY_SOURCE = "^[a-z]+_history$"
UNITS = ("chips", "bb")
ACTORS = ("hero", "villain", "unknown")
POSITION_MODELS = ("IP", "OOP", "unknown")
CONTEXT_TYPES = ("hero_check_or_bet", "hero_facing_bet", "unknown")
# Limits for jobs that may run.
SAFE_PROFILES = ("random_turn_spot", "random_river_spot")
HERO_PROFILES = ("hero_oop_check_or_bet", "hero_ip_facing_bet", "hero_oop_facing_bet")
SAFE_STREETS = ("TURN", "RIVER")
ELIGIBLE_ITERATIONS, HERO_ITERATIONS, ELIGIBLE_TIMEOUT_S, ELIGIBLE_BET_SIZES = 5, 25, 5.0, 2

OPTIONAL = {
    "hero_solver_player": ("string", "0"),
    "villain_solver_player": ("string", None),
    "decision_actor": ("string", "hero"),
    "root_must_be_hero": ("string", "true"),
    "hero_position_model": ("string", "unknown"),
    "decision_context_type": ("string", "unknown"),
    "generation_profile": ("string", None),
    "root_player": ("string", None),
    "initial_hole_cards": ("array<array<string>>", None),
    "initial_contributions": ("array<string>", None),
}
LISTS = ("hero_hand", "villain_hand", "board", "bet_sizes")


def read_job_text(df: DataFrame, raw: str = "raw") -> DataFrame:
    """JSON text of a job to text columns, with the list of keys that were present."""
    fields = {f: "array<string>" if f in LISTS else "string" for f in JOB_FIELDS}
    fields.update({name: kind for name, (kind, _) in OPTIONAL.items()})
    schema = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    parsed = df.withColumns({"_job": F.from_json(raw, schema), "present": F.json_object_keys(raw)})
    return parsed.select(*df.columns, "present", *[F.col(f"_job.{name}").alias(name) for name in fields])


def with_optional(df: DataFrame) -> DataFrame:
    """Add absent optional columns and fill their defaults where the key is absent."""
    have = set(df.columns)
    added = {}
    for name, (kind, default) in OPTIONAL.items():
        if name not in have:
            added[name] = F.lit(default).cast(kind)
        elif default is not None and "present" in have:
            added[name] = F.when(~F.array_contains("present", name), F.lit(default)).otherwise(F.col(name))
    if "present" not in have:
        added["present"] = F.array(*[F.lit(f) for f in JOB_FIELDS])
    return df.withColumns(added) if added else df


def _card_rules(name: str, count: Column) -> list:
    """Invalid card first, then the number of cards."""
    strict = F.col(f"_{name}")
    first_bad = F.get(F.filter(F.zip_with(F.col(name), strict, lambda raw, ok: F.struct(raw.alias("r"), ok.alias("k"))), lambda p: p["k"].isNull()), F.lit(0))["r"]
    return [
        (F.exists(strict, lambda c: c.isNull()), F.concat(F.lit(f"ValueError:invalid_card:{name}:"), F.coalesce(first_bad, F.lit("None")))),
        (
            F.size(strict) != count,
            F.concat(F.lit(f"ValueError:{name}_card_count:"), F.size(strict).cast("string"), F.lit("_expected:"), count.cast("string")),
        ),
    ]


def _positive(name: str, number: Column, limit: float | None = None, zero_ok: bool = False) -> list:
    text = F.col(name)
    word = "must_be_nonnegative" if zero_ok else "must_be_positive"
    rules = [
        (number.isNull(), F.concat(F.lit(f"ValueError:{name}_not_a_number:"), F.coalesce(text, F.lit("None")))),
        ((number < 0) if zero_ok else (number <= 0), f"ValueError:{name}_{word}"),
    ]
    if limit is not None:
        rules.append((number > limit, f"ValueError:{name}_exceeds_limit:{limit:g}"))
    return rules


def validate_jobs(df: DataFrame) -> DataFrame:
    """Add `status` and `error` (the first rule broken, in fixed order) and the normalized values.

    Text columns are replaced by typed ones; a failed row keeps its text in none of them but still
    has its ids.
    """
    rows = with_optional(df)
    street = F.upper(F.coalesce(F.col("street"), F.lit("None")))
    expected = F.when(street == "FLOP", 3).when(street == "TURN", 4).when(street == "RIVER", 5)
    staged = rows.withColumns(
        {
            **{f"_{n}": F.transform(F.col(n), C.strict_card) for n in ("hero_hand", "villain_hand", "board")},
            **{f"_{n}": to_double(F.col(n)) for n in ("pot", "to_call", "stack", "timeout_s")},
            "_iterations": to_int(F.col("iterations")),
            "_sizes": F.transform(F.filter("bet_sizes", lambda s: F.length(strip(s)) > 0), lambda s: F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))),
            "_street": street,
            "_expected": expected,
            "_hero_player": to_int(F.col("hero_solver_player")),
            "_villain_player": F.coalesce(to_int(F.col("villain_solver_player")), F.lit(1) - to_int(F.col("hero_solver_player"))),
            "_contributions": F.transform("initial_contributions", lambda x: to_double(x)),
            "_holes": F.transform("initial_hole_cards", lambda h: F.transform(h, C.strict_card)),
        }
    )
    staged = staged.withColumn("_all", F.concat("_hero_hand", "_villain_hand", "_board"))
    duplicates = F.array_sort(F.array_distinct(F.filter("_all", lambda c: F.size(F.filter("_all", lambda d: d == c)) > 1)))
    missing = F.array_except(F.array(*[F.lit(f) for f in JOB_FIELDS]), F.col("present"))
    staged = staged.withColumns({"_missing": missing, "_duplicates": duplicates})

    def word(name: str, allowed: Sequence[str]) -> tuple:
        text = F.coalesce(F.col(name), F.lit("None"))
        return (~text.isin(*allowed), F.concat(F.lit(f"ValueError:unsupported_{name}:"), text))

    context, price, pot = F.col("decision_context_type"), F.col("_to_call"), F.col("_pot")
    derived = F.col("initial_contributions").isNull()
    gives = F.col("_contributions")
    hero_slot = F.get("_holes", F.col("_hero_player").cast("int"))
    other_slot = F.get("_holes", (F.lit(1) - F.col("_hero_player")).cast("int"))
    rules = [
        (F.size("_missing") > 0, F.concat(F.lit("ValueError:missing_job_fields:"), F.array_join("_missing", ","))),
        *[(F.length(strip(F.coalesce(F.col(n), F.lit("")))) == 0, f"ValueError:{n}_required") for n in ("solver_job_id", "source_snapshot_id", "created_at")],
        word("schema_version", (SCHEMA_VERSION,)),
        (
            ~F.coalesce("source_type", F.lit("None")).isin(*SOURCE_TYPES) & ~F.coalesce("source_type", F.lit("None")).rlike(HISTORY_SOURCE),
            F.concat(F.lit("ValueError:unsupported_source_type:"), F.coalesce("source_type", F.lit("None"))),
        ),
        word("units", UNITS),
        (F.col("_expected").isNull(), F.concat(F.lit("ValueError:unsupported_street:"), F.coalesce(F.col("street"), F.lit("None")))),
        (F.col("hero_hand").isNull(), "TypeError:hero_hand_must_be_list"),
        *_card_rules("hero_hand", F.lit(2)),
        (F.col("board").isNull(), "TypeError:board_must_be_list"),
        *_card_rules("board", F.col("_expected")),
        (F.length(F.col("villain_range")) > 0, "ValueError:villain_range_not_supported"),
        (F.col("villain_hand").isNull(), "ValueError:villain_hand_required"),
        *_card_rules("villain_hand", F.lit(2)),
        (F.size("_duplicates") > 0, F.concat(F.lit("ValueError:duplicate_cards:"), F.array_join("_duplicates", ","))),
        *_positive("pot", pot),
        *_positive("to_call", price, zero_ok=True),
        *_positive("stack", F.col("_stack")),
        *_positive("iterations", F.col("_iterations"), MAX_ITERATIONS),
        (F.col("timeout_s").isNull(), "ValueError:timeout_s_required"),
        *_positive("timeout_s", F.col("_timeout_s"), MAX_TIMEOUT_S),
        (F.coalesce(F.size("_sizes"), F.lit(0)) <= 0, "ValueError:bet_sizes_required"),
        (F.size("_sizes") > MAX_BET_SIZES, f"ValueError:bet_sizes_exceeds_limit:{MAX_BET_SIZES}"),
        (F.exists("_sizes", lambda s: s.isNull() | (s <= 0)), "ValueError:bet_sizes_must_be_positive"),
        (~F.lower(F.coalesce("backend", F.lit("None"))).isin(*BACKENDS), F.concat(F.lit("ValueError:unsupported_backend:"), F.coalesce("backend", F.lit("None")))),
        word("label_intent", LABEL_INTENTS),
        (F.col("hero_solver_player").isNull(), "ValueError:hero_solver_player_required"),
        (F.coalesce(~F.col("_hero_player").isin(0, 1), F.lit(True)), F.concat(F.lit("ValueError:hero_solver_player_must_be_0_or_1_or_null:"), F.col("hero_solver_player"))),
        word("decision_actor", ACTORS),
        (~F.lower(strip(F.coalesce("root_must_be_hero", F.lit("true")))).isin("true", "1", "yes", "false", "0", "no"), "ValueError:root_must_be_hero_must_be_bool"),
        (~F.col("_villain_player").isin(0, 1), F.concat(F.lit("ValueError:solver_player_must_be_0_or_1:"), F.coalesce("villain_solver_player", F.lit("None")))),
        (F.col("_villain_player") == F.col("_hero_player"), "ValueError:villain_solver_player_must_differ_from_hero_solver_player"),
        word("hero_position_model", POSITION_MODELS),
        word("decision_context_type", CONTEXT_TYPES),
        (F.col("initial_hole_cards").isNotNull() & (F.size("initial_hole_cards") != 2), "ValueError:initial_hole_cards_must_have_two_players"),
        (hero_slot != F.col("_hero_hand"), "ValueError:initial_hole_cards_hero_slot_mismatch"),
        (other_slot != F.col("_villain_hand"), "ValueError:initial_hole_cards_villain_slot_mismatch"),
        (~derived & (F.size(gives) != 2), "ValueError:initial_contributions_must_have_two_players"),
        (F.exists(gives, lambda x: x < 0), "ValueError:initial_contributions_must_be_nonnegative"),
        (F.abs(F.aggregate(gives, F.lit(0.0), lambda a, x: a + x) - pot) > 1e-6, "ValueError:initial_contributions_must_sum_to_pot"),
        (derived & (context == "hero_check_or_bet") & (price != 0), "ValueError:hero_check_or_bet_requires_zero_to_call"),
        (derived & (context == "hero_facing_bet") & (price <= 0), "ValueError:hero_facing_bet_requires_positive_to_call"),
        (derived & (context == "hero_facing_bet") & (pot < price), "ValueError:pot_must_cover_to_call"),
    ]
    lower = (pot - price) / 2
    even = F.array(pot / 2, pot - pot / 2)
    split = (
        F.when(context == "hero_check_or_bet", even)
        .when((context == "hero_facing_bet") & (F.col("_hero_player") == 1), F.array(lower + price, lower))
        .when((context != "hero_facing_bet") & (price <= 0), even)
        .otherwise(F.array(lower, lower + price))
    )
    holes = F.when(F.col("_hero_player") == 0, F.array("_hero_hand", "_villain_hand")).otherwise(F.array("_villain_hand", "_hero_hand"))
    out = staged.withColumn("error", first_reason(rules))
    typed = {
        "street": F.col("_street"), "hero_hand": F.col("_hero_hand"), "villain_hand": F.col("_villain_hand"), "board": F.col("_board"),
        "pot": pot, "to_call": price, "stack": F.col("_stack"), "bet_sizes": F.col("_sizes"), "iterations": F.col("_iterations"),
        "timeout_s": F.col("_timeout_s"), "backend": F.lower("backend"), "hero_solver_player": F.col("_hero_player"),
        "villain_solver_player": F.col("_villain_player"),
        "root_must_be_hero": F.lower(strip(F.coalesce("root_must_be_hero", F.lit("true")))).isin("true", "1", "yes"),
        "initial_hole_cards": F.coalesce("_holes", holes), "initial_contributions": F.coalesce(gives, split),
    }
    kept = [c for c in rows.columns if c not in typed and c != "present"]
    ok = F.col("error").isNull()
    return out.select(
        *kept,
        *[F.when(ok, value).alias(name) for name, value in typed.items()],
        F.when(ok, "ok").otherwise("failed").alias("status"),
        "error",
    )


def eligibility(df: DataFrame) -> DataFrame:
    """Add `eligible`, `ineligible_reason` and `eligibility_warnings` to validated jobs.

    The player at the root is read from the recorded `root_player` column.
    """
    profile, street = F.col("generation_profile"), F.col("street")
    hero = F.coalesce(profile.isin(*HERO_PROFILES), F.lit(False))
    limits = [
        (F.col("timeout_s") > ELIGIBLE_TIMEOUT_S, "timeout_too_high_for_calibration"),
        (F.size("bet_sizes") > ELIGIBLE_BET_SIZES, "profile_not_solver_safe"),
    ]
    safe_street = F.coalesce(street.isin(*SAFE_STREETS), F.lit(False))
    oriented = first_reason(
        [
            (~is_true(F.col("root_must_be_hero")), "root_must_be_hero_required"),
            (F.col("decision_actor") != "hero", "decision_actor_must_be_hero"),
            (~safe_street, "street_not_solver_safe"),
            (F.col("iterations") > HERO_ITERATIONS, "iterations_too_high_for_calibration"),
            *limits,
            (F.coalesce(to_int(F.col("root_player")) != F.col("hero_solver_player"), F.lit(True)), "root_player_not_hero"),
        ]
    )
    plain = first_reason(
        [
            (street == "FLOP", "flop_solver_timeout_risk"),
            (F.coalesce(~profile.isin(*SAFE_PROFILES), F.lit(True)), "profile_not_solver_safe"),
            (~safe_street, "street_not_solver_safe"),
            (F.col("iterations") > ELIGIBLE_ITERATIONS, "iterations_too_high_for_calibration"),
            *limits,
        ]
    )
    reason = (
        F.when(F.col("status") != "ok", "invalid_solver_job")
        .when(F.col("source_type") != "synthetic", "profile_not_solver_safe")
        .otherwise(F.when(hero, oriented).otherwise(plain))
    )
    out = df.withColumn("ineligible_reason", reason)
    wide = (F.col("ineligible_reason") == "profile_not_solver_safe") & (F.size("bet_sizes") > ELIGIBLE_BET_SIZES)
    mismatch = ((profile == "random_turn_spot") & (street != "TURN")) | ((profile == "random_river_spot") & (street != "RIVER"))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("status") != "ok", F.col("error")),
            F.when((F.col("status") == "ok") & (F.col("source_type") != "synthetic"), F.lit("source_type_not_synthetic")),
            F.when((F.col("source_type") == "synthetic") & wide & (hero | profile.isin(*SAFE_PROFILES)), F.lit("bet_sizes_too_wide_for_calibration")),
            F.when(F.col("ineligible_reason").isNull() & mismatch, F.lit("profile_street_mismatch")),
        )
    )
    return out.withColumns({"eligible": F.col("ineligible_reason").isNull(), "eligibility_warnings": warnings})


def gate(df: DataFrame, dry_run: bool = False) -> DataFrame:
    """Decide what happens to each job row: invalid, unsupported source, dry run, skipped, or to run."""
    judged = eligibility(df)
    ok, synthetic = F.col("status") == "ok", F.col("source_type") == "synthetic"
    decision = (
        F.when(~ok, F.struct(F.lit("failed").alias("s"), F.col("error").alias("e"), F.lit("job_validation_failed").alias("q")))
        .when(
            ~synthetic,
            F.struct(
                F.lit("failed").alias("s"),
                F.concat(F.lit("unsupported_source_type_for_file_runner:"), F.col("source_type")).alias("e"),
                F.lit("unsupported_source_type").alias("q"),
            ),
        )
        .when(F.lit(dry_run), F.struct(F.lit("skipped").alias("s"), F.lit(None).cast("string").alias("e"), F.lit("dry_run").alias("q")))
        .when(~F.col("eligible"), F.struct(F.lit("skipped").alias("s"), F.col("ineligible_reason").alias("e"), F.col("ineligible_reason").alias("q")))
        .otherwise(F.struct(F.lit("to_run").alias("s"), F.lit(None).cast("string").alias("e"), F.lit(None).cast("string").alias("q")))
    )
    out = judged.withColumn("_d", decision)
    return out.select(
        *judged.columns,
        F.col("_d.s").alias("gate_status"),
        F.col("_d.e").alias("gate_error"),
        F.struct(
            F.when(ok, F.col("iterations")).alias("iterations"), F.lit(None).cast("double").alias("exploitability_last"),
            F.lit(False).alias("is_label_candidate"), F.col("_d.q").alias("exclusion_reason"),
        ).alias("quality"),
    )


def build_hero_jobs(df: DataFrame) -> DataFrame:
    """Fill ids, seats, hole-card order and contributions of hero-oriented jobs from their context.

    Needs position, context, cards and amounts. The seat of the hero follows from position and
    context; an impossible pair is an error text.
    """
    position, context = F.col("hero_position_model"), F.col("decision_context_type")
    seat = (
        F.when((context == "hero_check_or_bet") & (position == "OOP"), 1)
        .when((context == "hero_facing_bet") & (position == "IP"), 0)
        .when((context == "hero_facing_bet") & (position == "OOP"), 1)
    )
    pot, price = F.col("pot"), F.col("to_call")
    lower = (pot - price) / 2
    error = first_reason(
        [
            (~context.isin("hero_check_or_bet", "hero_facing_bet"), F.concat(F.lit("unsupported_decision_context_type:"), context)),
            ((context == "hero_check_or_bet") & (position != "OOP"), "hero_check_or_bet_requires_hero_oop"),
            ((context == "hero_facing_bet") & ~position.isin("IP", "OOP"), "hero_facing_bet_requires_known_position"),
            ((context == "hero_check_or_bet") & (price != 0), "hero_check_or_bet_requires_zero_to_call"),
            ((context == "hero_facing_bet") & (price <= 0), "hero_facing_bet_requires_positive_to_call"),
            ((context == "hero_facing_bet") & (pot < price), "pot_must_cover_to_call"),
        ]
    )
    staged = df.withColumns({"hero_solver_player": seat, "build_error": error})
    hero_first = F.col("hero_solver_player") == 0
    give = (
        F.when(context == "hero_check_or_bet", F.array(pot / 2, pot - pot / 2))
        .when(hero_first, F.array(lower, lower + price))
        .otherwise(F.array(lower + price, lower))
    )
    have = set(df.columns)
    ids = F.col("solver_job_id") if "solver_job_id" in have else F.lit(None).cast("string")
    return staged.withColumns(
        {
            "solver_job_id": F.coalesce(ids, F.concat(F.lit("solver_job_"), F.substring(F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256), 1, 32))),
            "villain_solver_player": F.lit(1) - F.col("hero_solver_player"),
            "initial_hole_cards": F.when(hero_first, F.array("hero_hand", "villain_hand")).otherwise(F.array("villain_hand", "hero_hand")),
            "initial_contributions": F.when(F.col("build_error").isNull(), give),
            "decision_actor": F.lit("hero"),
            "root_must_be_hero": F.lit(True),
        }
    )


def first_low_confidence(confidence: Column, limit: float = 0.5) -> Column:
    """Key of the first entry of a confidence map below the limit."""
    low = F.filter(F.map_entries(confidence), lambda e: e["value"] < limit)
    return F.get(low, F.lit(0))["key"]


def jobs_from_snapshots(
    df: DataFrame,
    stack_fallback: float = 1000.0,
    iterations: int = 25,
    timeout_s: float = 5.0,
    bet_size: float = 0.33,
    backend: str = "rust",
    label_intent: str = "solver_smoke",
    min_confidence: float = 0.5,
) -> DataFrame:
    """Snapshots to job columns with `mapping_status`, `mapping_error` and `mapping_warnings`.

    The rules run in order; the job columns then go through `validate_jobs` like any other job.
    """
    f, m, q = (lambda n: F.col(f"features.{n}")), (lambda n: F.col(f"metadata.{n}")), (lambda n: F.col(f"quality_flags.{n}"))
    street = F.upper(F.coalesce(m("street"), f("street")))
    low = first_low_confidence(F.col("confidence"), min_confidence)
    reason = first_reason(
        [
            (F.coalesce(F.length("snapshot_id"), F.lit(0)) == 0, "snapshot_id_missing"),
            (~F.col("schema_version").eqNullSafe(F.lit(SNAPSHOT_VERSION)), "unsupported_snapshot_schema_version"),
            (~is_true(q("usable_for_training")) & ~is_true(q("usable_for_solver")), "snapshot_not_usable_for_training"),
            (low.isNotNull(), F.concat(F.lit("confidence_too_low:"), low)),
            (street.isNull(), "street_missing"),
            (~street.isin(*JOB_STREETS), F.concat(F.lit("unsupported_street:"), street)),
            (~f("active_opponents").eqNullSafe(F.lit(1.0)), "non_heads_up_snapshot"),
            (f("hero_cards").isNull(), "hero_cards_missing"),
            (f("board_cards").isNull(), "board_cards_missing"),
            (F.length(f("villain_range")) > 0, "villain_range_not_supported"),
            (f("villain_hand").isNull(), "villain_hand_missing"),
            (f("pot").isNull(), "pot_missing"),
            (~is_true(f("decision_context_known")), "decision_context_unknown"),
            (f("to_call").isNull(), "to_call_unknown"),
        ]
    )
    stack = F.coalesce(f("stack"), f("effective_stack"))
    units = F.coalesce(F.nullif(f("units"), F.lit("")), F.nullif(m("units"), F.lit("")))
    jobs = df.select(
        F.concat(F.lit("solver_job_from_"), F.col("snapshot_id")).alias("solver_job_id"),
        F.col("snapshot_id").alias("source_snapshot_id"),
        F.coalesce(F.nullif("recorded_at", F.lit("")), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).alias("created_at"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce(F.nullif(m("source_type"), F.lit("")), F.lit("ml_snapshot")).alias("source_type"),
        F.coalesce(units, F.lit("chips")).alias("units"),
        street.alias("street"),
        f("hero_cards").alias("hero_hand"),
        f("villain_hand").alias("villain_hand"),
        F.lit(None).cast("string").alias("villain_range"),
        f("board_cards").alias("board"),
        f("pot").cast("string").alias("pot"),
        f("to_call").cast("string").alias("to_call"),
        F.coalesce(stack, F.lit(stack_fallback)).cast("string").alias("stack"),
        F.array(F.lit(str(bet_size))).alias("bet_sizes"),
        F.coalesce(f("solver_iterations").cast("bigint"), F.lit(iterations)).cast("string").alias("iterations"),
        F.coalesce(f("solver_timeout_s"), F.lit(timeout_s)).cast("string").alias("timeout_s"),
        F.lit(backend).alias("backend"),
        F.lit(label_intent).alias("label_intent"),
        reason.alias("_reason"),
        F.array_compact(
            F.array(
                F.when(stack.isNull(), F.concat(F.lit("stack_missing_defaulted_to_"), short_number(F.lit(stack_fallback)))),
                F.when(units.isNull(), F.lit("units_missing_defaulted_to_chips")),
            )
        ).alias("_warnings"),
    )
    checked = validate_jobs(jobs)
    error = F.coalesce("_reason", "error")
    return checked.select(
        *[c for c in checked.columns if c not in ("_reason", "_warnings", "status", "error")],
        F.when(error.isNull(), "ok").otherwise("failed").alias("mapping_status"),
        error.alias("mapping_error"),
        F.when(F.col("_reason").isNull(), F.col("_warnings")).otherwise(F.array().cast("array<string>")).alias("mapping_warnings"),
    )
