"""Run records: strategies, candidates, stability, states and their rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import first_reason, is_false, is_true
from ..functions.text import solver_action
from ..functions.values import confidence_band, half_even, ratio

# Spellings of run-log actions.
ACTION_ALIASES = {"CHECK_CALL": "CALL", "ALLIN": "ALL_IN"}
SQUEEZED = r"^(BET|RAISE)(33|75|100|150|200)$"
# Thresholds of a candidate.
SUM_LOW, SUM_HIGH = 0.98, 1.02
MIN_FREQUENCY, MIN_ITERATIONS, MIN_RUNS = 0.60, 25, 2
EXPORT_FREQUENCY = 0.70
BLOCKING_FLAGS = (
    "extreme_action_all_in", "dominant_action_unstable", "frequency_too_low", "iterations_too_low",
    "exploitability_missing", "timeout", "root_not_hero", "strategy_source_not_average_strategy",
)
LABEL_SOURCE, LABEL_QUALITY = "solver_candidate", "bootstrap_solver_untrusted"


def run_action(c: Column) -> Column:
    """Upper-cased action with '_' joins and the known short forms spelled out."""
    up = F.translate(F.upper(F.trim(c)), "- ", "__")
    spelled = F.regexp_replace(up, SQUEEZED, "$1_$2")
    for short, full in ACTION_ALIASES.items():
        spelled = F.when(spelled == short, F.lit(full)).otherwise(spelled)
    return spelled


def root_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """Read a root strategy struct: frequencies per action, dominant action, confidence, or an error.

    Adds `strategy_status`, `strategy_error`, `action_frequencies` (sorted entries summing to 1, six
    digits), `dominant_action`, `dominant_frequency` and `strategy_confidence`. When two labels
    become the same action the later one counts; equal frequencies go to the first name.
    """
    s = F.col(strategy)
    labels, freqs = s["action_labels"], s["frequencies"]
    staged = df.withColumn("_named", F.transform(labels, run_action))
    staged = staged.withColumn(
        "_pairs",
        F.filter(
            F.zip_with(F.col("_named"), freqs, lambda a, f: F.struct(a.alias("a"), f.alias("f"))), lambda p: p["a"].isNotNull() & p["f"].isNotNull()
        ),
    )
    staged = staged.withColumn(
        "_last",
        F.array_sort(
            F.filter(
                F.transform("_pairs", lambda p, i: F.when(~F.exists(F.slice("_pairs", i + 2, F.greatest(F.size("_pairs") - i - 1, F.lit(0))), lambda q: q["a"] == p["a"]), p)),
                lambda p: p.isNotNull(),
            )
        ),
    )
    staged = staged.withColumn("_total", F.aggregate("_last", F.lit(0.0), lambda acc, p: acc + p["f"]))
    error = first_reason(
        [
            (s.isNull(), "strategy_not_available"),
            (s["hero_solver_player"].isNull(), "hero_solver_player_unknown"),
            (F.coalesce(s["root_player_role"], F.lit("")) == "unknown", "hero_solver_player_unknown"),
            (~is_true(s["root_matches_hero"]), "root_player_not_hero"),
            (~s["root_player_role"].eqNullSafe(F.lit("hero")), "root_player_not_hero"),
            (labels.isNull() | freqs.isNull(), "strategy_not_available"),
            (F.size(labels) != F.size(freqs), "invalid_frequency_shape"),
            (F.exists(freqs, lambda f: f.isNull() | (f < 0) | (f > 1)), "invalid_frequency_value"),
            (F.size("_last") == 0, "strategy_not_available"),
            (~F.col("_total").between(SUM_LOW, SUM_HIGH), "invalid_frequency_sum"),
        ]
    )
    staged = staged.withColumn("strategy_error", error)
    ok = F.col("strategy_error").isNull()
    staged = staged.withColumn(
        "_entries",
        F.when(ok, F.transform("_last", lambda p: F.struct(p["a"].alias("key"), half_even(p["f"] / F.col("_total"), 6).alias("value")))),
    )
    best = F.get(F.array_sort(F.transform("_entries", lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k")))), F.lit(0))
    return staged.select(
        *df.columns,
        F.when(ok, "ok").otherwise("failed").alias("strategy_status"),
        "strategy_error",
        F.map_from_entries(F.coalesce("_entries", F.array().cast("array<struct<key:string,value:double>>"))).alias("action_frequencies"),
        best["k"].alias("dominant_action"),
        (-best["n"]).alias("dominant_frequency"),
        F.coalesce(confidence_band(-best["n"], high_inclusive=False, missing=None), F.lit("low")).alias("strategy_confidence"),
    )


def action_candidate(df: DataFrame, status: str = "solver_status", iterations: str = "iterations") -> DataFrame:
    """Guard a strategy: add `candidate_status`, `candidate_action`, `candidate_frequency`, `candidate_reason`."""
    e = F.col("strategy_error")
    total = F.aggregate(F.map_values("action_frequencies"), F.lit(0.0), lambda a, x: a + x)
    bad = F.exists(F.map_values("action_frequencies"), lambda x: (x < 0) | (x > 1)) | (F.size("action_frequencies") == 0) | ~total.between(SUM_LOW, SUM_HIGH)
    reason = first_reason(
        [
            (F.coalesce(F.col(status), F.lit("ok")) != "ok", "solver_not_ok"),
            (e.isin("root_player_not_hero", "hero_solver_player_unknown"), "root_not_hero"),
            (e.contains("frequency"), "invalid_frequencies"),
            (e.isNotNull(), "strategy_not_available"),
            (bad, "invalid_frequencies"),
            (F.col("dominant_action").isNull() | F.col("dominant_frequency").isNull(), "strategy_not_available"),
            (F.col("dominant_frequency") < MIN_FREQUENCY, "dominant_action_too_weak"),
            (F.coalesce(F.col(iterations) < MIN_ITERATIONS, F.lit(True)), "iterations_too_low"),
        ]
    )
    out = df.withColumn("candidate_reason", reason)
    ok = F.col("candidate_reason").isNull()
    return out.withColumns(
        {
            "candidate_status": F.when(ok, "ok").otherwise("failed"),
            "candidate_action": F.when(ok, F.col("dominant_action")),
            "candidate_frequency": F.when(ok, half_even(F.col("dominant_frequency"), 6)).otherwise(0.0),
            "candidate_confidence": F.when(ok, F.col("strategy_confidence")).otherwise("low"),
        }
    )


def run_state(status: Column, quality_reason: Column, error: Column, warnings: Column, invalid: Column) -> Column:
    """solved / skipped / timeout / error of a run record."""
    low = F.lower(F.coalesce(status, F.lit("")))
    late = (
        (F.coalesce(quality_reason, F.lit("")) == "timeout")
        | F.lower(F.coalesce(error, F.lit(""))).contains("timeout")
        | F.coalesce(F.exists(warnings, lambda w: F.lower(w).contains("timeout")), F.lit(False))
    )
    return (
        F.when(is_true(invalid), "error")
        .when(low == "ok", "solved")
        .when(low == "skipped", "skipped")
        .when((low == "timeout") | late, "timeout")
        .otherwise("error")
    )


def run_quality_reason(iterations: Column, has_output: Column, has_history: Column, entries: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull(), "solver_failed")
        .when(~has_output, "result_incomplete")
        .when(iterations < 100, "iterations_too_low")
        .when(~has_history, "exploitability_missing")
        .when(F.coalesce(entries, F.lit(0)) <= 0, "strategy_entry_count_too_low")
        .otherwise("labeling_disabled")
    )


def _state_counts() -> list[Column]:
    state = F.col("state")
    return [
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(state == s).alias(n) for s, n in (("solved", "solved"), ("skipped", "skipped"), ("timeout", "timeouts"), ("error", "errors"))],
        half_even(F.avg("duration_ms"), 3).alias("avg_duration_ms"),
    ]


def run_analytics(df: DataFrame, profile: str = "profile", iterations: str = "iterations") -> DataFrame:
    """Counts by state overall, by profile and by iterations in one pass, with the recommendation on the total row."""
    grouped = df.groupingSets([[], [profile], [iterations]], profile, iterations).agg(
        F.grouping_id().alias("_g"), *_state_counts()
    )
    level = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "profile").otherwise("iterations")
    key = F.when(F.col("_g") == 3, F.lit("")).when(F.col("_g") == 1, F.col(profile)).otherwise(F.col(iterations).cast("string"))
    timeout, success = F.col("timeouts") / F.col("total"), F.col("solved") / F.col("total")
    advice = (
        F.when(F.col("total") == 0, "no_solver_run_results")
        .when(timeout > 0.30, "reduce_profiles_or_iterations")
        .when(success > 0.80, "stable_for_smoke_runs")
        .otherwise("keep_controlled_smoke_scope")
    )
    return grouped.select(
        level.alias("level"), key.alias("key"), "total", "solved", "skipped", "timeouts", "errors", "avg_duration_ms",
        F.when(F.col("_g") == 3, advice).alias("recommendation"),
    )


def group_verdict(total: Column, solved: Column, timeouts: Column, average: Column) -> Column:
    """Stability verdict of one calibration cell."""
    return (
        F.when(F.coalesce(total, F.lit(0)) == 0, "no_rows")
        .when(solved / total < 0.80, "not_recommended_success_rate_below_80_percent")
        .when(timeouts / total > 0.10, "not_recommended_timeout_rate_above_10_percent")
        .when(average > 3000.0, "avoid_large_batches_avg_duration_above_3000_ms")
        .when(solved / total > 0.90, "stable_for_solver_batch")
        .otherwise("usable_with_caution")
    )


def calibration_rollup(df: DataFrame, plan: DataFrame, profile: str = "profile", iterations: str = "iterations") -> DataFrame:
    """Rollup by profile, iterations and both, over the planned cells, empty ones included.

    `df` holds status (ok / timeout / failed) and duration; `plan` the cells that were meant to run.
    """
    cube = df.cube(profile, iterations).agg(
        F.grouping_id().alias("_g"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("solved"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(F.col("status") == "failed").alias("errors"),
        half_even(F.avg(F.when(F.col("status") == "ok", F.col("duration_ms"))), 3).alias("avg_success_duration_ms"),
        F.avg("duration_ms").alias("_avg"),
    )
    cells = plan.select(profile, iterations).distinct()
    wanted = cells.cube(profile, iterations).agg(F.grouping_id().alias("_g"))

    def keyed(frame: DataFrame) -> DataFrame:
        return frame.withColumns({"_p": F.coalesce(F.col(profile).cast("string"), F.lit("*")), "_i": F.coalesce(F.col(iterations).cast("string"), F.lit("*"))})

    measures = ["total", "solved", "timeouts", "errors", "avg_success_duration_ms", "_avg"]
    out = keyed(wanted).select("_p", "_i", "_g").join(keyed(cube).select("_p", "_i", "_g", *measures), ["_p", "_i", "_g"], "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("total", "solved", "timeouts", "errors")}
    out = out.withColumns(counts).withColumn("avg_duration_ms", half_even(F.col("_avg"), 3))
    return out.select(
        F.col("_p").alias(profile), F.col("_i").alias(iterations), "total", "solved", "timeouts", "errors",
        ratio(F.col("solved"), F.col("total"), 4).alias("success_rate"), ratio(F.col("timeouts"), F.col("total"), 4).alias("timeout_rate"),
        "avg_success_duration_ms", "avg_duration_ms",
        group_verdict(F.col("total"), F.col("solved"), F.col("timeouts"), F.col("avg_duration_ms")).alias("recommendation"),
    )


def group_stability(df: DataFrame, keys: Sequence[str], action: str = "dominant_action") -> DataFrame:
    """Verdict per group: one run is no evidence, several actions (or none) are unstable."""
    verdict = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), F.min(action).alias("_low"), F.max(action).alias("_high"))
    return verdict.select(
        *keys,
        "runs",
        first_reason(
            [(F.col("runs") < MIN_RUNS, "single_run_only"), (F.col("_low").isNull() | (F.col("_low") != F.col("_high")), "action_unstable")]
        ).alias("stability_error"),
    )


def join_verdict(df: DataFrame, verdict: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the group verdict back to every row of its group.

    The verdict was pre-aggregated on the map side; a hot group is split by the adaptive skew join.
    """
    return df.join(verdict, list(keys), "left")


def exclusion_reason(min_frequency: float = EXPORT_FREQUENCY) -> Column:
    """First reason that keeps a normalized run record from being exported; null when none does."""
    blocked = F.array_min(F.array_intersect(F.coalesce("danger_flags", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in BLOCKING_FLAGS])))
    error = F.nullif("raw_error", F.lit(""))
    return first_reason(
        [
            (F.lower(error).contains("timeout"), "timeout"),
            (error.isNotNull(), "solver_failed"),
            (F.coalesce(~F.col("solver_status").isin("ok", "OK"), F.lit(True)), "solver_failed"),
            (~is_true(F.col("root_matches_hero")) | ~F.col("root_player_role").eqNullSafe(F.lit("hero")), "root_not_hero"),
            (F.coalesce(F.length("dominant_action"), F.lit(0)) == 0, "strategy_not_available"),
            (F.col("dominant_action") == "ALL_IN", "all_in_excluded"),
            (solver_action(F.col("dominant_action")).isNull(), "unsupported_action"),
            (F.col("dominant_frequency").isNull(), "strategy_not_available"),
            (F.col("dominant_frequency") < min_frequency, "dominant_action_too_weak"),
            (F.coalesce(F.col("iterations") < MIN_ITERATIONS, F.lit(True)), "iterations_too_low"),
            (blocked.isNotNull(), F.concat(F.lit("danger_flag:"), blocked)),
            (F.col("stability_error").isNotNull(), F.col("stability_error")),
        ]
    )


def normalize_sensitivity(df: DataFrame) -> DataFrame:
    """Sensitivity records to the shared run shape; position and decision come from the context text."""
    context = F.coalesce("context", F.lit(""))
    return df.select(
        F.col("solver_job_id").alias("source_id"),
        F.concat_ws("::", F.coalesce("context", F.lit("None")), F.coalesce("scenario", F.lit("None"))).alias("group_id"),
        "street", "hero_cards", "villain_hand", "board_cards", "pot", "to_call", "stack", "spr",
        F.when(context.contains("_ip_"), "IP").when(context.contains("_oop_"), "OOP").alias("position_model"),
        F.when(context.contains("check_or_bet"), "hero_check_or_bet").when(context.contains("facing_bet"), "hero_facing_bet").alias("decision_context_type"),
        "action_frequencies", "dominant_action", F.col("dominant_frequency"), "iterations", "exploitability_last",
        confidence_band(F.col("dominant_frequency")).alias("candidate_confidence"),
        "root_matches_hero", "root_player_role", "solver_status", "danger_flags", F.col("error").alias("raw_error"),
    )


def normalize_runs(df: DataFrame) -> DataFrame:
    """Run-result records (nested) to the shared run shape; the group is the job id without its run suffix."""
    job, out = F.col("solver_job"), F.col("solver_result.output")
    staged = df.withColumns(
        {
            "_strategy": out["root_strategy_raw"],
            "_status": F.coalesce("solver_status", F.col("solver_result.status")),
            "_iterations": F.coalesce(F.col("quality.iterations"), out["iterations"]),
            "_id": F.coalesce("solver_job_id", job["solver_job_id"]),
        }
    )
    judged = action_candidate(root_strategy(staged, "_strategy"), "_status", "_iterations")
    return judged.select(
        F.col("_id").alias("source_id"),
        F.regexp_replace(F.coalesce("_id", F.lit("unknown")), r"_it[0-9]+$", "").alias("group_id"),
        job["street"].alias("street"), job["hero_hand"].alias("hero_cards"), job["villain_hand"].alias("villain_hand"), job["board"].alias("board_cards"),
        job["pot"].alias("pot"), job["to_call"].alias("to_call"), job["stack"].alias("stack"), ratio(job["stack"], job["pot"], 6).alias("spr"),
        job["hero_position_model"].alias("position_model"), job["decision_context_type"].alias("decision_context_type"),
        "action_frequencies",
        F.coalesce("candidate_action", "dominant_action").alias("dominant_action"),
        F.when(F.col("candidate_frequency") != 0, F.col("candidate_frequency")).otherwise(F.col("dominant_frequency")).alias("dominant_frequency"),
        F.col("_iterations").alias("iterations"), out["exploitability_last"].alias("exploitability_last"), "candidate_confidence",
        F.coalesce(out["root_matches_hero"], F.col("_strategy.root_player_role") == "hero").alias("root_matches_hero"),
        F.coalesce(out["root_player_role"], F.col("_strategy.root_player_role")).alias("root_player_role"),
        F.col("_status").alias("solver_status"), F.array().cast("array<string>").alias("danger_flags"), F.col("error").alias("raw_error"),
    )


def candidate_rows(runs: DataFrame, min_frequency: float = EXPORT_FREQUENCY) -> DataFrame:
    """Shared run shape to flat export rows: every row has either a label or a reason."""
    verdict = group_stability(runs.withColumn("group_id", F.coalesce("group_id", "source_id", F.lit("unknown"))), ["group_id"])
    rows = join_verdict(runs.withColumn("group_id", F.coalesce("group_id", "source_id", F.lit("unknown"))), verdict, ["group_id"])
    rows = rows.withColumn("exclusion_reason", exclusion_reason(min_frequency))
    excluded = F.col("exclusion_reason").isNotNull()
    action = solver_action(F.col("dominant_action"))
    street, context = F.upper(F.coalesce("street", F.lit(""))), F.coalesce("decision_context_type", F.lit(""))
    return rows.select(
        "source_id", "group_id", "street", "hero_cards", "villain_hand", "board_cards", "pot", "to_call", "stack", "spr", "position_model",
        "decision_context_type", "action_frequencies", "dominant_action", F.col("dominant_frequency").alias("dominant_action_frequency"), "iterations",
        "exploitability_last", F.coalesce("candidate_confidence", confidence_band(F.col("dominant_frequency"))).alias("candidate_confidence"),
        F.col("dominant_action").alias("raw_action"), action.alias("normalized_action"),
        F.when(~excluded, action).alias("bootstrap_label"),
        F.when(~excluded, F.lit(LABEL_SOURCE)).alias("label_source"), F.lit(LABEL_QUALITY).alias("label_quality"),
        F.lit(None).cast("string").alias("weak_rule_reason"), excluded.alias("excluded"), "exclusion_reason",
        F.coalesce(F.array_size("board_cards"), F.lit(0)).alias("board_card_count"),
        (street == "RIVER").alias("is_river"), (street == "TURN").alias("is_turn"),
        (context == "hero_check_or_bet").alias("is_check_or_bet_context"), (context == "hero_facing_bet").alias("is_facing_bet_context"),
        ratio(F.col("to_call"), F.col("pot"), 6).alias("to_call_ratio"), ratio(F.col("stack"), F.col("pot"), 6).alias("stack_to_pot_ratio"),
    )


def run_quality(df: DataFrame, keys: Sequence[str], order: str, short_stack: bool = False) -> DataFrame:
    """Stability of the runs of a group. The first failing run, in `order`, decides the reason.

    Rows need solver_status, error, candidate_status, candidate_reason, candidate_action,
    candidate_frequency, iterations, exploitability_last, root_matches_hero and root_player_role.
    Only small aggregates are shuffled; the flags come from a fixed list of words.
    """
    mapped = (
        F.when(F.col("candidate_reason").isin("root_not_hero", "solver_not_ok", "iterations_too_low"), F.col("candidate_reason"))
        .when(F.col("candidate_reason").isin("dominant_action_too_weak", "frequency_too_low"), "frequency_too_low")
        .otherwise("candidate_not_available")
    )
    status = F.coalesce("solver_status", F.lit("ok"))
    reason = first_reason(
        [
            (status == "timeout", "timeout"),
            (status != "ok", "solver_not_ok"),
            (F.length("error") > 0, "solver_not_ok"),
            (~F.col("candidate_status").eqNullSafe(F.lit("ok")), mapped),
            (is_false(F.col("root_matches_hero")) | F.col("root_player_role").eqNullSafe(F.lit("villain")), "root_not_hero"),
            (F.coalesce(F.col("iterations") < MIN_ITERATIONS, F.lit(True)), "iterations_too_low"),
            (F.col("exploitability_last").isNull(), "exploitability_missing"),
            (F.coalesce(F.length("candidate_action"), F.lit(0)) == 0, "candidate_not_available"),
            (F.col("candidate_frequency").isNull(), "candidate_not_available"),
            (F.col("candidate_frequency") < MIN_FREQUENCY, "frequency_too_low"),
        ]
    )
    runs = df.withColumn("_reason", reason).withColumn("_bad_at", F.when(F.col("_reason").isNotNull(), F.col(order)))
    all_in_at = F.when((F.col("candidate_action") == "ALL_IN") & F.lit(not short_stack) & F.col("_reason").isNull(), F.col(order))
    grouped = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.min_by("_reason", F.col("_bad_at")).alias("_first_reason"),
        F.min("_bad_at").alias("_first_bad"),
        F.min(all_in_at).alias("_all_in_at"),
        F.min("candidate_action").alias("_low"),
        F.max("candidate_action").alias("_high"),
        F.avg("candidate_frequency").alias("_avg"),
        F.min("candidate_frequency").alias("_min"),
    )
    single = F.col("runs") < MIN_RUNS
    unstable = F.col("_low") != F.col("_high")
    out = grouped.withColumn(
        "exclusion_reason",
        first_reason([(single, "single_run_only"), (F.col("_first_reason").isNotNull(), F.col("_first_reason")), (unstable, "dominant_action_unstable")]),
    )
    observed = ~single & F.col("_first_reason").isNull()
    all_in = ~single & F.col("_all_in_at").isNotNull() & F.coalesce(F.col("_all_in_at") < F.col("_first_bad"), F.lit(True))
    # Two reasons leave no flag of their own: a candidate without action or frequency adds nothing.
    own = F.when(F.col("exclusion_reason").isNotNull(), F.col("exclusion_reason"))
    ok = F.col("exclusion_reason").isNull()
    return out.select(
        *keys,
        "runs",
        F.when(ok, "ok").otherwise("failed").alias("quality_status"),
        F.when(ok, F.col("_low")).alias("candidate_action"),
        ok.alias("stable_action"),
        F.when(observed, half_even(F.col("_avg"), 6)).otherwise(0.0).alias("dominant_frequency_avg"),
        F.when(observed, half_even(F.col("_min"), 6)).otherwise(0.0).alias("dominant_frequency_min"),
        F.when(observed, 1.0).otherwise(0.0).alias("dominant_action_consistency"),
        F.array_distinct(F.array_compact(F.array(F.when(all_in, F.lit("extreme_action_all_in")), own))).alias("danger_flags"),
        "exclusion_reason",
        F.when(ok, "usable_for_candidate_analysis").otherwise("not_usable_for_candidate_analysis").alias("recommendation"),
    )


def sensitivity_by_context(df: DataFrame, quality: DataFrame, context: str = "context") -> DataFrame:
    """Per context: runs, all-in rate and unstable groups."""
    runs = df.groupBy(context).agg(
        F.count(F.lit(1)).alias("solve_count"), F.count_if(F.col("dominant_action") == "ALL_IN").alias("all_in_count")
    )
    unstable = quality.groupBy(context).agg(F.count_if(~F.col("stable_action")).alias("unstable_group_count"))
    joined = runs.join(unstable, context, "left")
    return joined.select(
        context, "solve_count", "all_in_count", half_even(F.col("all_in_count") / F.col("solve_count"), 6).alias("all_in_rate"),
        F.coalesce("unstable_group_count", F.lit(0)).alias("unstable_group_count"),
    )


def batch_summary(df: DataFrame, mapping: str = "mapping_status", solver: str = "solver_status") -> DataFrame:
    """Counts of a batch with ok / partial / failed."""
    mapped, solved = F.col(mapping) == "ok", F.col(solver) == "ok"
    out = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(mapped).alias("mapped"), F.count_if(solved).alias("solved"),
        F.count_if(F.col(mapping) == "failed").alias("mapping_failed"), F.count_if(mapped & ~solved).alias("solver_failed"),
    )
    out = out.withColumn("failed_total", F.col("mapping_failed") + F.col("solver_failed"))
    return out.withColumn("status", F.when(F.col("solved") == 0, "failed").when(F.col("failed_total") == 0, "ok").otherwise("partial"))


def candidate_report(df: DataFrame, labels: Sequence[str] = ("CHECK", "FOLD", "RAISE"), ratio_floor: float = 0.75) -> DataFrame:
    """One report row over export rows that kept their run columns: class counts, root errors, critical warnings."""
    root_error = (
        is_false(F.col("root_matches_hero"))
        | F.col("root_player_role").eqNullSafe(F.lit("villain"))
        | F.lower(F.coalesce("raw_error", F.lit(""))).contains("root_player_not_hero")
        | F.coalesce(F.exists("danger_flags", lambda f: F.lower(f).contains("root_player_not_hero")), F.lit(False))
    )
    usable = ~F.col("excluded")
    counts = [F.count_if(usable & (F.col("bootstrap_label") == label)).alias(f"n_{label.lower()}") for label in labels]
    out = df.agg(
        F.count(F.lit(1)).alias("total_spots"), F.count_if(usable).alias("usable_rows"), F.count_if(~usable).alias("rejected_spots"),
        F.count_if(root_error).alias("root_player_not_hero_errors"), *counts,
    )
    n = [F.col(f"n_{label.lower()}") for label in labels]
    present = sum((F.when(c > 0, 1).otherwise(0) for c in n), F.lit(0))
    out = out.withColumn("class_ratio", ratio(F.least(*n), F.greatest(*n), 6))
    warnings = F.array_compact(
        F.array(
            F.when(F.col("root_player_not_hero_errors") > 0, F.lit("root_player_not_hero")),
            F.when(F.col("usable_rows") <= 0, F.lit("no_usable_rows")),
            F.when(present < len(labels), F.lit("missing_check_fold_raise_class")).when(F.col("class_ratio") < ratio_floor, F.lit("class_distribution_imbalanced")),
        )
    )
    out = out.withColumn("critical_warnings", warnings)
    return out.withColumn("status", F.when(F.size("critical_warnings") == 0, "ok").otherwise("failed"))


def forced_quality(quality: Column) -> Column:
    """Quality struct with `is_label_candidate` false; a missing one says so."""
    return F.struct(
        quality["iterations"].alias("iterations"),
        quality["exploitability_last"].alias("exploitability_last"),
        F.lit(False).alias("is_label_candidate"),
        F.when(quality.isNull(), F.lit("quality_missing")).otherwise(F.coalesce(quality["exclusion_reason"], F.lit("labeling_disabled"))).alias("exclusion_reason"),
    )
