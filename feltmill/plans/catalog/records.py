"""Jobs, run records and stability: orders become jobs, line items the runs of an order, events a run log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import jobs as J
from ...operators import runs as R
from ...registry import query, table


# ---- jobs ------------------------------------------------------------------------------------


def job_texts(spark, sf):
    """Orders as JSON job rows with broken ones among them."""
    k = F.col("o_orderkey")

    def t(c):
        return F.lit(c).cast("string") if isinstance(c, str) else c.cast("string")

    street = F.when(k % 7 == 0, "PREFLOP").when(k % 3 == 0, "flop").when(k % 3 == 1, "TURN").otherwise("RIVER")
    boards = F.when(k % 3 == 0, F.array(F.lit("2c"), F.lit("7D"), F.lit("10h"))).when(k % 3 == 1, F.array(*[F.lit(c) for c in ("2c", "7d", "Th", "Ks")])).otherwise(
        F.array(*[F.lit(c) for c in ("2c", "7d", "Th", "Ks", "4h")]))
    hero = F.when(k % 13 == 0, F.array(F.lit("Zx"), F.lit("Ad"))).otherwise(F.array(F.lit("Ah"), F.lit("ad")))
    villain = F.when(k % 31 == 0, F.lit(None)).when(k % 17 == 0, F.array(F.lit("Qs"), F.lit("Ah"))).otherwise(F.array(F.lit("Qs"), F.lit("Qd")))
    sizes = F.when(k % 19 == 0, F.array(*[F.lit(x) for x in (0.33, 0.5, 1.0)])).otherwise(F.array(F.lit(0.33)))
    profile = F.when(k % 4 == 0, "random_turn_spot").when(k % 4 == 1, "random_river_spot").when(k % 4 == 2, "hero_ip_facing_bet").otherwise("drawy_board_spot")
    job = F.struct(
        F.concat(F.lit("job_"), t(k)).alias("solver_job_id"), F.concat(F.lit("snap_"), t(k)).alias("source_snapshot_id"), F.lit("2026-01-01T00:00:00Z").alias("created_at"),
        F.lit("solver_job_v1").alias("schema_version"), F.when(k % 29 == 0, "weird").when(k % 23 == 0, "ml_snapshot").otherwise("synthetic").alias("source_type"),
        F.lit("bb").alias("units"), street.alias("street"), hero.alias("hero_hand"), villain.alias("villain_hand"), F.lit("").alias("villain_range"), boards.alias("board"),
        F.lit(100).alias("pot"), F.when(k % 3 == 0, 0).otherwise(20).alias("to_call"), (k % 900 + 100).alias("stack"), sizes.alias("bet_sizes"),
        F.when(k % 5 == 0, 150).otherwise(k % 30 + 1).alias("iterations"), F.lit(5.0).alias("timeout_s"), F.when(k % 11 != 0, "Rust").alias("backend"),
        F.lit("solver_smoke").alias("label_intent"), profile.alias("generation_profile"), F.when(k % 4 == 2, "hero_facing_bet").alias("decision_context_type"),
        (k % 2).alias("root_player"),
    )
    return table(spark, sf, "orders", wide=True).select("o_orderkey", F.to_json(job).alias("raw"))


JOB_CTE = """
WITH j AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'PREFLOP' WHEN o_orderkey % 3 = 0 THEN 'FLOP' WHEN o_orderkey % 3 = 1 THEN 'TURN' ELSE 'RIVER' END AS street FROM orders),
v AS (SELECT *, CASE WHEN k % 31 = 0 OR k % 11 = 0 THEN 'ValueError:missing_job_fields:' || array_to_string(list_filter([CASE WHEN k % 31 = 0 THEN 'villain_hand' END, CASE WHEN k % 11 = 0 THEN 'backend' END], lambda x: x IS NOT NULL), ',')
   WHEN k % 29 = 0 THEN 'ValueError:unsupported_source_type:weird' WHEN street = 'PREFLOP' THEN 'ValueError:unsupported_street:PREFLOP' WHEN k % 13 = 0 THEN 'ValueError:invalid_card:hero_hand:Zx'
   WHEN k % 17 = 0 THEN 'ValueError:duplicate_cards:Ah' WHEN k % 5 = 0 THEN 'ValueError:iterations_exceeds_limit:100' 
   WHEN k % 4 = 2 AND k % 3 = 0 THEN 'ValueError:hero_facing_bet_requires_positive_to_call' END AS error FROM j)
"""


@query("job_validation", "P22 F12", JOB_CTE + """
SELECT k AS o_orderkey, CASE WHEN error IS NULL THEN 'ok' ELSE 'failed' END AS status, error,
  CASE WHEN error IS NULL THEN street END AS street, CASE WHEN error IS NULL THEN k % 30 + 1 END AS iterations, CASE WHEN error IS NULL THEN 'Ah Ad' END AS hero,
  CASE WHEN error IS NULL THEN CASE WHEN k % 3 = 0 THEN '50.0,50.0' ELSE '40.0,60.0' END END AS contributions FROM v
""")
def job_validation(spark, sf):
    checked = J.validate_jobs(J.read_job_text(job_texts(spark, sf)))
    return checked.select(
        "o_orderkey", "status", "error", "street", "iterations", F.array_join("hero_hand", " ").alias("hero"),
        F.array_join(F.transform("initial_contributions", lambda x: x.cast("string")), ",").alias("contributions"),
    )


GATE_CTE = JOB_CTE + """
, g AS (SELECT *, CASE WHEN k % 23 = 0 THEN 'profile_not_solver_safe' WHEN k % 4 = 2 THEN CASE WHEN street = 'FLOP' THEN 'street_not_solver_safe' WHEN k % 30 + 1 > 25 THEN 'iterations_too_high_for_calibration'
      WHEN k % 19 = 0 THEN 'profile_not_solver_safe' WHEN k % 2 <> 0 THEN 'root_player_not_hero' END
    WHEN street = 'FLOP' THEN 'flop_solver_timeout_risk' WHEN k % 4 = 3 THEN 'profile_not_solver_safe' WHEN k % 30 + 1 > 5 THEN 'iterations_too_high_for_calibration'
    WHEN k % 19 = 0 THEN 'profile_not_solver_safe' END AS why FROM v)
"""


@query("job_eligibility", "P23", GATE_CTE + """
SELECT k AS o_orderkey, error IS NULL AND why IS NULL AS eligible, CASE WHEN error IS NOT NULL THEN 'invalid_solver_job' ELSE why END AS reason FROM g
""")
def job_eligibility(spark, sf):
    judged = J.eligibility(J.validate_jobs(J.read_job_text(job_texts(spark, sf))))
    return judged.select("o_orderkey", "eligible", F.col("ineligible_reason").alias("reason"))


@query("job_gate_counts", "P44 K6 A10", GATE_CTE + """
SELECT CASE WHEN error IS NOT NULL THEN 'failed' WHEN k % 23 = 0 THEN 'failed' WHEN why IS NOT NULL THEN 'skipped' ELSE 'to_run' END AS gate_status,
  CASE WHEN error IS NOT NULL THEN 'job_validation_failed' WHEN k % 23 = 0 THEN 'unsupported_source_type' ELSE why END AS exclusion_reason, count(*) AS jobs FROM g GROUP BY 1, 2
""")
def job_gate_counts(spark, sf):
    gated = J.gate(J.validate_jobs(J.read_job_text(job_texts(spark, sf))))
    return gated.groupBy("gate_status", F.col("quality.exclusion_reason").alias("exclusion_reason")).agg(F.count(F.lit(1)).alias("jobs"))


@query("hero_job_building", "P26 S16", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END END AS seat,
  CASE WHEN o_orderkey % 3 = 2 THEN 'unsupported_decision_context_type:limp' WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 = 0 THEN 'hero_check_or_bet_requires_zero_to_call'
       WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 <> 0 THEN 'hero_facing_bet_requires_positive_to_call' END AS error,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 10 <> 0 THEN 6.0 WHEN o_orderkey % 3 = 1 AND o_orderkey % 10 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 4.0 ELSE 8.0 END END::DOUBLE AS first_in,
  CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 2 = 0 THEN 'h' ELSE 'v' END AS first_hand FROM orders
""")
def hero_job_building(spark, sf):
    k = F.col("o_orderkey")
    context = F.when(k % 3 == 0, "hero_check_or_bet").when(k % 3 == 1, "hero_facing_bet").otherwise("limp")
    position = F.when((k % 3 == 1) & (k % 2 == 0), "IP").otherwise("OOP")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.concat(F.lit("j"), k.cast("string")).alias("solver_job_id"), position.alias("hero_position_model"), context.alias("decision_context_type"),
        F.lit(12.0).alias("pot"), F.when(k % 10 == 0, 4.0).otherwise(0.0).alias("to_call"), F.array(F.lit("h"), F.lit("h2")).alias("hero_hand"), F.array(F.lit("v"), F.lit("v2")).alias("villain_hand"),
    )
    built = J.build_hero_jobs(rows)
    return built.select(
        "o_orderkey", F.col("hero_solver_player").alias("seat"), F.col("build_error").alias("error"), F.get("initial_contributions", F.lit(0)).alias("first_in"),
        F.get(F.get("initial_hole_cards", F.lit(0)), F.lit(0)).alias("first_hand"),
    )


# ---- strategies and candidates ---------------------------------------------------------------


def item_runs(spark, sf):
    """Line items as run records: discount and tax are the action frequencies, the line is the run."""
    n, d, x = F.col("l_linenumber"), F.col("l_discount"), F.col("l_tax")
    freqs = F.when(n == 6, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.1))).when(n == 7, F.array(d, x)).otherwise(F.array(d * 5, F.lit(1.0) - d * 5 - x, x))
    strategy = F.when(
        n != 5,
        F.struct(
            F.array(F.lit("check-call"), F.lit("bet33"), F.lit("allin")).alias("action_labels"), freqs.alias("frequencies"), F.lit(0).cast("bigint").alias("hero_solver_player"),
            F.lit(0).cast("bigint").alias("root_player"), F.when(F.col("l_linestatus") == "O", "hero").otherwise("villain").alias("root_player_role"),
            (F.col("l_linestatus") == "O").alias("root_matches_hero"),
        ),
    )
    return table(spark, sf, "lineitem", wide=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", strategy.alias("strategy"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("solver_status"), (F.col("l_quantity") * 2).cast("bigint").alias("iterations"),
    )


ITEM_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
STRATEGY_CTE = f"""
WITH r AS (SELECT {ITEM_KEYS}, l_linenumber AS n, l_returnflag, l_linestatus, CAST(l_quantity * 2 AS BIGINT) AS iterations, l_discount * 5 AS fc, 1.0::DOUBLE - l_discount * 5 - l_tax AS fb, l_tax AS fa,
   l_discount * 5 + (1.0::DOUBLE - l_discount * 5 - l_tax) + l_tax AS tot_unsorted, 0.0::DOUBLE + l_tax + (1.0::DOUBLE - l_discount * 5 - l_tax) + l_discount * 5 AS tot FROM lineitem),
s AS (SELECT *, CASE WHEN n = 5 THEN 'strategy_not_available' WHEN l_linestatus <> 'O' THEN 'root_player_not_hero' WHEN n = 7 THEN 'invalid_frequency_shape' WHEN n = 6 THEN 'invalid_frequency_sum' END AS err FROM r),
p AS (SELECT *, round(fa / tot, 6) AS ra, round(fb / tot, 6) AS rb, round(fc / tot, 6) AS rc FROM s),
d AS (SELECT *, CASE WHEN err IS NULL THEN CASE WHEN ra >= rb AND ra >= rc THEN 'ALL_IN' WHEN rb >= rc THEN 'BET_33' ELSE 'CALL' END END AS act, CASE WHEN err IS NULL THEN greatest(ra, rb, rc) END AS f FROM p),
c AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 'solver_not_ok' WHEN err = 'root_player_not_hero' THEN 'root_not_hero' WHEN err LIKE '%frequency%' THEN 'invalid_frequencies' WHEN err IS NOT NULL THEN 'strategy_not_available'
   WHEN f < 0.6 THEN 'dominant_action_too_weak' WHEN iterations < 25 THEN 'iterations_too_low' END AS why FROM d)
"""


@query("root_strategy_reading", "P27 F19 F5", STRATEGY_CTE + f"""
SELECT {ITEM_KEYS}, CASE WHEN err IS NULL THEN 'ok' ELSE 'failed' END AS status, err AS error, act AS action, f AS frequency,
  CASE WHEN err IS NOT NULL THEN 'low' WHEN f > 0.75 THEN 'high' WHEN f >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM d
""")
def root_strategy_reading(spark, sf):
    out = R.root_strategy(item_runs(spark, sf), "strategy")
    return out.select(
        *ITEM_KEYS.split(", "), F.col("strategy_status").alias("status"), F.col("strategy_error").alias("error"), F.col("dominant_action").alias("action"),
        F.col("dominant_frequency").alias("frequency"), F.col("strategy_confidence").alias("confidence"),
    )


@query("action_candidate_guard", "P28", STRATEGY_CTE + f"""
SELECT {ITEM_KEYS}, CASE WHEN why IS NULL THEN 'ok' ELSE 'failed' END AS status, why AS reason, CASE WHEN why IS NULL THEN act END AS action, CASE WHEN why IS NULL THEN f ELSE 0.0 END AS frequency FROM c
""")
def action_candidate_guard(spark, sf):
    out = R.action_candidate(R.root_strategy(item_runs(spark, sf), "strategy"))
    return out.select(
        *ITEM_KEYS.split(", "), F.col("candidate_status").alias("status"), F.col("candidate_reason").alias("reason"), F.col("candidate_action").alias("action"),
        F.col("candidate_frequency").alias("frequency"),
    )


def item_sensitivity(spark, sf):
    """Line items as sensitivity records of their order: flag is the action, price the frequency."""
    flag = F.col("l_returnflag")
    action = F.when(flag == "A", "BET_33").when(flag == "N", "CHECK").otherwise(F.when(F.col("l_discount") > 0.05, "ALL_IN").otherwise("FOLD"))
    context = F.when(F.col("l_orderkey") % 3 == 0, "hero_oop_check_or_bet").when(F.col("l_orderkey") % 3 == 1, "hero_ip_facing_bet").otherwise("elsewhere")
    flags = F.array_compact(F.array(F.when(F.col("l_tax") > 0.07, F.lit("timeout")), F.when(F.col("l_tax") > 0.06, F.lit("frequency_too_low")), F.when(F.col("l_tax") > 0.05, F.lit("harmless"))))
    none = F.lit(None).cast("string")
    return table(spark, sf, "lineitem", wide=True).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.concat_ws("_", F.lit("job"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("solver_job_id"), context.alias("context"),
        F.col("l_orderkey").cast("string").alias("scenario"), F.lit("RIVER").alias("street"), F.array(F.lit("Ah"), F.lit("Kd")).alias("hero_cards"), F.array(F.lit("2c"), F.lit("2d")).alias("villain_hand"),
        F.array(*[F.lit(c) for c in ("3c", "4c", "5c", "6c", "8d")]).alias("board_cards"), F.col("l_extendedprice").alias("pot"), F.col("l_quantity").alias("to_call"), F.lit(1000.0).alias("stack"),
        F.lit(None).cast("double").alias("spr"), F.create_map(action, F.lit(1.0)).alias("action_frequencies"), action.alias("dominant_action"),
        (F.lit(0.65) + F.col("l_discount") * 3).alias("dominant_frequency"), (F.col("l_quantity") + 20).cast("bigint").alias("iterations"), F.lit(0.1).alias("exploitability_last"),
        (F.col("l_tax") > 0.0).alias("root_matches_hero"), F.lit("hero").alias("root_player_role"), F.when(F.col("l_linestatus") == "F", "ok").otherwise("OK").alias("solver_status"), flags.alias("danger_flags"),
        F.when((F.col("l_linenumber") == 7) & (flag == "A"), "Timeout after 5s").when(F.col("l_linenumber") == 7, "crash").otherwise(none).alias("error"),
    )


SENS_CTE = """
WITH r AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'BET_33' WHEN 'N' THEN 'CHECK' ELSE CASE WHEN l_discount > 0.05 THEN 'ALL_IN' ELSE 'FOLD' END END AS act,
  CASE l_orderkey % 3 WHEN 0 THEN 'hero_oop_check_or_bet' WHEN 1 THEN 'hero_ip_facing_bet' ELSE 'elsewhere' END AS context, 0.65::DOUBLE + l_discount * 3 AS freq, CAST(l_quantity + 20 AS BIGINT) AS iterations,
  CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'timeout' WHEN l_linenumber = 7 THEN 'solver_failed' END AS err FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS runs, min(act) AS lo, max(act) AS hi FROM r GROUP BY 1),
x AS (SELECT r.*, runs, CASE WHEN err IS NOT NULL THEN err WHEN l_tax <= 0 THEN 'root_not_hero' WHEN act = 'ALL_IN' THEN 'all_in_excluded' WHEN freq < 0.7 THEN 'dominant_action_too_weak'
  WHEN iterations < 25 THEN 'iterations_too_low' WHEN l_tax > 0.06 THEN 'danger_flag:frequency_too_low' WHEN runs < 2 THEN 'single_run_only' WHEN lo <> hi THEN 'action_unstable' END AS why FROM r JOIN g USING (l_orderkey))
"""


@query("candidate_export_rows", "P11 P12 P13 A9 J3 F19", SENS_CTE + f"""
SELECT {ITEM_KEYS}, why AS exclusion_reason, CASE WHEN why IS NULL THEN CASE act WHEN 'BET_33' THEN 'RAISE' ELSE act END END AS label, CASE WHEN why IS NULL THEN 'solver_candidate' END AS label_source,
  CASE WHEN context LIKE '%_ip_%' THEN 'IP' WHEN context LIKE '%_oop_%' THEN 'OOP' END AS position, CASE WHEN context LIKE '%check_or_bet' THEN 'hero_check_or_bet' WHEN context LIKE '%facing_bet' THEN 'hero_facing_bet' END AS decision,
  round_even(l_quantity / l_extendedprice, 6) AS to_call_ratio, CASE WHEN freq >= 0.75 THEN 'high' WHEN freq >= 0.55 THEN 'medium' ELSE 'low' END AS confidence FROM x
""")
def candidate_export_rows(spark, sf):
    source = item_sensitivity(spark, sf)
    keys = ITEM_KEYS.split(", ")
    rows = R.candidate_rows(R.normalize_sensitivity(source.withColumn("solver_job_id", F.to_json(F.struct(*keys)))))
    back = F.from_json("source_id", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double")
    return rows.withColumn("k", back).select(
        *[F.col(f"k.{c}").alias(c) for c in keys], "exclusion_reason", F.col("bootstrap_label").alias("label"), "label_source", F.col("position_model").alias("position"),
        F.col("decision_context_type").alias("decision"), "to_call_ratio", F.col("candidate_confidence").alias("confidence"),
    )


@query("group_stability_verdicts", "A9 J3", SENS_CTE + """
SELECT l_orderkey, runs, CASE WHEN runs < 2 THEN 'single_run_only' WHEN lo <> hi THEN 'action_unstable' END AS stability_error FROM g
""")
def group_stability_verdicts(spark, sf):
    return R.group_stability(item_sensitivity(spark, sf).select("l_orderkey", "dominant_action"), ["l_orderkey"])


@query("candidate_run_quality", "A7 A8", SENS_CTE + """
, o AS (SELECT *, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS ord, CASE WHEN err IS NOT NULL THEN 'solver_not_ok' WHEN l_tax <= 0 THEN 'root_not_hero' WHEN iterations < 25 THEN 'iterations_too_low' END AS bad FROM r),
q AS (SELECT l_orderkey, count(*) AS runs, arg_min(bad, ord) FILTER (bad IS NOT NULL) AS first_bad, min(ord) FILTER (bad IS NOT NULL) AS bad_at, min(ord) FILTER (act = 'ALL_IN' AND bad IS NULL) AS all_in_at,
   min(act) AS lo, max(act) AS hi, avg(round_even(freq, 6)) AS af, min(round_even(freq, 6)) AS mf FROM o GROUP BY 1),
z AS (SELECT *, CASE WHEN runs < 2 THEN 'single_run_only' WHEN first_bad IS NOT NULL THEN first_bad WHEN lo <> hi THEN 'dominant_action_unstable' END AS why FROM q)
SELECT l_orderkey, runs, CASE WHEN why IS NULL THEN 'ok' ELSE 'failed' END AS status, CASE WHEN why IS NULL THEN lo END AS action, why AS reason,
  round(CASE WHEN runs < 2 OR first_bad IS NOT NULL THEN 0.0 ELSE af END, 5) AS frequency_avg, round(CASE WHEN runs < 2 OR first_bad IS NOT NULL THEN 0.0 ELSE mf END, 5) AS frequency_min,
  concat_ws(',', CASE WHEN runs >= 2 AND all_in_at IS NOT NULL AND (bad_at IS NULL OR all_in_at < bad_at) THEN 'extreme_action_all_in' END, why) AS flags FROM z
""")
def candidate_run_quality(spark, sf):
    q = R.run_quality(_quality_input(spark, sf), ["l_orderkey"], "ord")
    return q.select(
        "l_orderkey", "runs", F.col("quality_status").alias("status"), F.col("candidate_action").alias("action"), F.col("exclusion_reason").alias("reason"),
        F.round("dominant_frequency_avg", 5).alias("frequency_avg"), F.round("dominant_frequency_min", 5).alias("frequency_min"), F.array_join("danger_flags", ",").alias("flags"),
    )


def _quality_input(spark, sf):
    return item_sensitivity(spark, sf).select(
        "l_orderkey", "context", (F.col("l_linenumber") * F.lit(100000000000) + F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"),
        F.lower("solver_status").alias("solver_status"), "error", F.lit("ok").alias("candidate_status"), F.lit(None).cast("string").alias("candidate_reason"),
        F.col("dominant_action").alias("candidate_action"), F.bround("dominant_frequency", 6).alias("candidate_frequency"), "iterations", "exploitability_last", "root_matches_hero", "root_player_role",
        "dominant_action",
    )


@query("sensitivity_by_context", "A8", SENS_CTE + """
, o AS (SELECT *, CASE WHEN err IS NOT NULL THEN 1 WHEN l_tax <= 0 THEN 1 WHEN iterations < 25 THEN 1 END AS bad FROM r),
q AS (SELECT context, l_orderkey, count(*) < 2 OR max(bad) IS NOT NULL OR min(act) <> max(act) AS unstable FROM o GROUP BY 1, 2),
u AS (SELECT context, count(*) FILTER (unstable) AS n FROM q GROUP BY 1)
SELECT context, count(*) AS solve_count, count(*) FILTER (act = 'ALL_IN') AS all_in_count, round_even(count(*) FILTER (act = 'ALL_IN') / count(*)::DOUBLE, 6) AS all_in_rate, max(u.n) AS unstable_group_count
FROM r JOIN u USING (context) GROUP BY context
""")
def sensitivity_by_context(spark, sf):
    rows = _quality_input(spark, sf)
    return R.sensitivity_by_context(rows, R.run_quality(rows, ["context", "l_orderkey"], "ord"))


@query("candidate_report_row", "A11", SENS_CTE + """
, t AS (SELECT count(*) AS total_spots, count(*) FILTER (why IS NULL) AS usable_rows, count(*) FILTER (why IS NOT NULL) AS rejected_spots, count(*) FILTER (l_tax <= 0) AS root_player_not_hero_errors,
  count(*) FILTER (why IS NULL AND act = 'CHECK') AS n_check, count(*) FILTER (why IS NULL AND act = 'FOLD') AS n_fold, count(*) FILTER (why IS NULL AND act = 'BET_33') AS n_raise FROM x)
SELECT total_spots, usable_rows, rejected_spots, root_player_not_hero_errors, n_check, n_fold, n_raise, CASE WHEN greatest(n_check, n_fold, n_raise) > 0 THEN round_even(least(n_check, n_fold, n_raise) / greatest(n_check, n_fold, n_raise)::DOUBLE, 6) END AS class_ratio,
  concat_ws(',', CASE WHEN root_player_not_hero_errors > 0 THEN 'root_player_not_hero' END, CASE WHEN usable_rows <= 0 THEN 'no_usable_rows' END,
    CASE WHEN least(n_check, n_fold, n_raise) = 0 THEN 'missing_check_fold_raise_class' WHEN least(n_check, n_fold, n_raise) / greatest(n_check, n_fold, n_raise)::DOUBLE < 0.75 THEN 'class_distribution_imbalanced' END) AS critical, 'failed' AS status FROM t
""")
def candidate_report_row(spark, sf):
    runs = R.normalize_sensitivity(item_sensitivity(spark, sf))
    verdict = R.group_stability(runs, ["group_id"])
    judged = R.join_verdict(runs, verdict, ["group_id"]).withColumn("exclusion_reason", R.exclusion_reason())
    judged = judged.withColumn("excluded", F.col("exclusion_reason").isNotNull()).withColumn("bootstrap_label", R.solver_action(F.col("dominant_action")))
    out = R.candidate_report(judged)
    return out.withColumn("critical", F.array_join("critical_warnings", ",")).drop("critical_warnings")


# ---- run logs --------------------------------------------------------------------------------


def event_runs(spark, sf):
    i = F.col("event_id")
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("profile"), (i % 4).cast("string").alias("iterations"), F.col("value").alias("duration_ms"),
        F.when(i % 10 == 0, "skipped").when(i % 10 == 1, "timeout").when(i % 10 < 4, "failed").otherwise("OK").alias("solver_status"),
        F.when(i % 20 == 2, "labeling_disabled").when(i % 20 == 3, "timeout").alias("quality_reason"), F.when(i % 30 == 12, "hard TIMEOUT").alias("error"),
        F.when(i % 50 == 22, F.array(F.lit("x"), F.lit("Timeout at 5"))).alias("warnings"), F.when(i % 100 == 99, F.lit(True)).alias("invalid"),
    )


def _state(df):
    return df.withColumn("state", R.run_state(F.col("solver_status"), F.col("quality_reason"), F.col("error"), F.col("warnings"), F.col("invalid")))


STATE_CTE = """
WITH s AS (SELECT event_type AS profile, CAST(event_id % 4 AS VARCHAR) AS iterations, value AS duration_ms, CASE WHEN event_id % 100 = 99 THEN 'error' WHEN event_id % 10 >= 4 THEN 'solved' WHEN event_id % 10 = 0 THEN 'skipped'
  WHEN event_id % 10 = 1 OR event_id % 20 = 3 OR event_id % 30 = 12 OR event_id % 50 = 22 THEN 'timeout' ELSE 'error' END AS state, event_id FROM events)
"""


@query("run_log_analytics", "A5 P29 S2", STATE_CTE + """
, a AS (SELECT grouping_id(profile, iterations) AS g, profile, iterations, count(*) AS total, count(*) FILTER (state = 'solved') AS solved, count(*) FILTER (state = 'skipped') AS skipped,
  count(*) FILTER (state = 'timeout') AS timeouts, count(*) FILTER (state = 'error') AS errors, round(avg(duration_ms), 3) AS avg_duration_ms FROM s GROUP BY GROUPING SETS ((), (profile), (iterations)))
SELECT CASE g WHEN 3 THEN 'all' WHEN 1 THEN 'profile' ELSE 'iterations' END AS level, CASE g WHEN 3 THEN '' WHEN 1 THEN profile ELSE iterations END AS key, total, solved, skipped, timeouts, errors, avg_duration_ms,
  CASE WHEN g = 3 THEN CASE WHEN timeouts / total > 0.3 THEN 'reduce_profiles_or_iterations' WHEN solved / total > 0.8 THEN 'stable_for_smoke_runs' ELSE 'keep_controlled_smoke_scope' END END AS recommendation FROM a
""")
def run_log_analytics(spark, sf):
    return R.run_analytics(_state(event_runs(spark, sf)))


@query("calibration_rollup", "A6 S18 J1 F18", STATE_CTE + """
, st AS (SELECT profile, iterations, duration_ms, CASE state WHEN 'solved' THEN 'ok' WHEN 'timeout' THEN 'timeout' ELSE 'failed' END AS status FROM s),
grid AS (SELECT p.profile, i.iterations FROM (SELECT DISTINCT event_type AS profile FROM events) p, (SELECT unnest(['0', '1', '2', '3', '9']) AS iterations) i),
want AS (SELECT coalesce(profile, '*') AS profile, coalesce(iterations, '*') AS iterations, grouping_id(profile, iterations) AS g FROM grid GROUP BY CUBE (profile, iterations)),
have AS (SELECT coalesce(profile, '*') AS profile, coalesce(iterations, '*') AS iterations, count(*) AS total, count(*) FILTER (status = 'ok') AS solved, count(*) FILTER (status = 'timeout') AS timeouts,
  count(*) FILTER (status = 'failed') AS errors, avg(duration_ms) FILTER (status = 'ok') AS aok, avg(duration_ms) AS aall FROM st GROUP BY CUBE (profile, iterations))
SELECT profile, iterations, coalesce(total, 0) AS total, coalesce(solved, 0) AS solved, coalesce(timeouts, 0) AS timeouts, coalesce(errors, 0) AS errors, round_even(solved / total, 4) AS success_rate,
  round_even(timeouts / total, 4) AS timeout_rate, round(aok, 3) AS avg_success_duration_ms, round(aall, 3) AS avg_duration_ms,
  CASE WHEN total IS NULL THEN 'no_rows' WHEN solved / total < 0.8 THEN 'not_recommended_success_rate_below_80_percent' WHEN timeouts / total > 0.1 THEN 'not_recommended_timeout_rate_above_10_percent'
    WHEN aall > 3000 THEN 'avoid_large_batches_avg_duration_above_3000_ms' WHEN solved / total > 0.9 THEN 'stable_for_solver_batch' ELSE 'usable_with_caution' END AS recommendation
FROM want LEFT JOIN have USING (profile, iterations)
""")
def calibration_rollup(spark, sf):
    runs = _state(event_runs(spark, sf))
    runs = runs.withColumn("status", F.when(F.col("state") == "solved", "ok").when(F.col("state") == "timeout", "timeout").otherwise("failed"))
    plan = runs.select("profile").distinct().withColumn("iterations", F.explode(F.array(*[F.lit(i) for i in ("0", "1", "2", "3", "9")])))
    return R.calibration_rollup(runs, plan)


@query("run_quality_reasons", "P30 K6", """
SELECT CASE WHEN event_id % 30 = 12 THEN 'solver_failed' WHEN event_id % 7 = 0 THEN 'result_incomplete' WHEN event_id % 200 < 100 THEN 'iterations_too_low' WHEN event_id % 5 = 0 THEN 'exploitability_missing'
  WHEN event_id % 3 = 0 THEN 'strategy_entry_count_too_low' ELSE 'labeling_disabled' END AS reason, count(*) AS runs FROM events GROUP BY 1
""")
def run_quality_reasons(spark, sf):
    i = F.col("event_id")
    rows = event_runs(spark, sf)
    reason = R.run_quality_reason(i % 200, i % 7 != 0, i % 5 != 0, (i % 3).cast("int"), F.col("error"))
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


@query("batch_summary_row", "A10", """
WITH b AS (SELECT CASE WHEN event_id % 6 = 0 THEN 'failed' ELSE 'ok' END AS m, CASE WHEN event_id % 10 >= 4 THEN 'ok' ELSE 'failed' END AS s FROM events)
SELECT count(*) AS total, count(*) FILTER (m = 'ok') AS mapped, count(*) FILTER (s = 'ok') AS solved, count(*) FILTER (m = 'failed') AS mapping_failed, count(*) FILTER (m = 'ok' AND s <> 'ok') AS solver_failed,
  count(*) FILTER (m = 'failed') + count(*) FILTER (m = 'ok' AND s <> 'ok') AS failed_total, 'partial' AS status FROM b
""")
def batch_summary_row(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(i % 6 == 0, "failed").otherwise("ok").alias("mapping_status"), F.when(i % 10 >= 4, "ok").otherwise("failed").alias("solver_status")
    )
    return R.batch_summary(rows)
