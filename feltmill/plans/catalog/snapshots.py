"""Decision snapshots spelled from the orders: features, validation, strict rows, candidates, aligned rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import schemas as H
from ...functions import poker as K
from ...functions.rules import is_true
from ...operators import jobs as J
from ...operators import normalize as N
from ...operators import snapshots as S
from ...registry import query, table
from .cards import deals
from .sqlcards import DECK_CTE, PAIRS_CTE, deal_cte, score_sql


@query("pot_arithmetic", "P15 F18", """
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE o_totalprice END AS pot, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 50) * 100.0 END::DOUBLE AS c, CASE WHEN o_orderkey % 11 = 0 THEN 1.0 ELSE (o_orderkey % 97) / 97.0::DOUBLE END::DOUBLE AS e FROM orders)
SELECT o_orderkey, round(CASE WHEN pot > 0 THEN c / pot END, 10) AS ratio, round(CASE WHEN pot + c > 0 THEN c / (pot + c) END, 10) AS required, round(e * (pot + c) - c, 4) AS ev,
  round(ln(1 + least(e, 0.999999::DOUBLE) * pot / (1.0 - least(e, 0.999999::DOUBLE))), 8) AS max_clamp, CASE WHEN e >= 1 THEN 'inf' ELSE 'finite' END AS max_inf, CASE WHEN e >= 1 THEN 500.0 ELSE least(500.0, round(e * pot / (1 - e), 4)) END AS max_cap,
  round(power(e, greatest(1, o_orderkey % 4)), 10) AS multiway FROM x
""")
def pot_arithmetic(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 9 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("pot"), F.when(k % 3 == 0, 0.0).otherwise((k % 50) * 100.0).alias("c"), F.when(k % 11 == 0, 1.0).otherwise((k % 97) / F.lit(97.0)).alias("e")
    )
    e, pot, c = F.col("e"), F.col("pot"), F.col("c")
    capped = K.call_max(e, pot, "cap", None)
    return rows.select(
        "o_orderkey", K.pot_ratio(c, pot).alias("ratio"), K.equity_required(pot, c).alias("required"), F.round(K.expected_value(e, pot, c), 4).alias("ev"),
        F.round(F.log(K.call_max(e, pot, "clamp", None) + 1), 8).alias("max_clamp"), F.when(K.call_max(e, pot, "inf") == float("inf"), "inf").otherwise("finite").alias("max_inf"),
        F.least(F.lit(500.0), F.round(capped, 4)).alias("max_cap"), K.multiway_equity(e, F.col("o_orderkey") % 4).alias("multiway"),
    )


def order_snapshots(spark, sf):
    """Orders as decision snapshots, some of them broken."""
    k = F.col("o_orderkey")
    street = F.when(k % 10 == 9, "SHOWDOWN").when(k % 4 == 0, "preflop").when(k % 4 == 1, "FLOP").when(k % 4 == 2, "TURN").otherwise("RIVER")
    board = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(*[F.lit(c) for c in ("2c", "7♦", "10h")])).when(k % 4 == 2, F.array(*[F.lit(c) for c in ("2c", "7d", "Th", "Ks")])).otherwise(
        F.array(*[F.lit(c) for c in ("2c", "7d", "Th", "Ks", "4h")]))
    board = F.when(k % 21 == 1, F.array(F.lit("2c"))).otherwise(board)
    hero = F.when(k % 17 == 0, F.array(F.lit("A♠"), F.lit("A♠"))).when(k % 19 == 0, F.array(F.lit("Ah"))).otherwise(F.array(F.lit("A♠"), F.lit("Kd")))
    price = F.when(k % 3 == 0, 0.0).otherwise((k % 7 + 1) * 10.0)
    raise_state = F.when(price > 0, "relance").otherwise("mise")
    call_state = F.when(price > 0, "paie").otherwise("check")

    def button(i, state, text, enabled=F.lit(True)):
        return F.struct(F.lit(i).alias("index"), enabled.alias("enabled"), state.alias("state"), F.lit(1.0).alias("value"), text.alias("text"), F.lit(None).cast("double").alias("confidence"))

    none = F.lit(None).cast("string")
    buttons = F.array(button(0, none, F.concat(raise_state, F.lit(" 40"))), button(1, F.upper(call_state), none), button(2, F.lit("fold"), F.lit("fold"), k % 5 != 0))
    active = F.array_compact(F.array(raise_state, call_state, F.when(k % 5 != 0, F.lit("fold"))))
    start = F.lit(1000.0)

    def player(seat, name, state, stack, is_in, changed):
        return F.struct(
            F.lit(seat).alias("seat"), F.lit(name).alias("name"), state.alias("state"), is_in.alias("active"), F.lit(True).alias("active_at_start"), changed.alias("changed_this_round"), stack.alias("stack"),
            start.alias("stack_start"), (stack / 10).alias("stack_bb"), F.lit(0.25).alias("confidence"),
        )

    players = F.array(
        player(1, "Hero", F.lit("paid"), F.lit(900.0), F.lit(True), F.lit(False)), player(2, "Rival", F.when(k % 2 == 0, "raise").otherwise("check"), (k % 1000).cast("double"), F.lit(True), k % 6 == 0),
        player(3, "Gone", F.lit("fold"), F.lit(5000.0), F.lit(False), F.lit(False)),
    )
    action = F.when(k % 13 == 0, "WAIT").when(price > 0, F.when(k % 2 == 0, "CALL").otherwise("FOLD")).otherwise(F.when(k % 2 == 0, "CHECK").otherwise("RAISE"))
    equity = F.when(k % 8 != 0, (k % 101) / F.lit(101.0))
    pot = (k % 90 + 10) * 1.0
    features = F.struct(
        hero.alias("hero_cards"), board.alias("board_cards"), F.when(k % 15 != 0, F.array(F.lit("Qs"), F.lit("Qd"))).alias("villain_hand"), none.alias("villain_range"), none.alias("street"),
        F.when(k % 23 != 0, "BTN").alias("hero_position"), F.lit(5.0).alias("player_start"), F.when(k % 12 == 0, 3.0).otherwise(2.0).alias("player_active"), F.when(k % 12 == 0, 2.0).otherwise(1.0).alias("active_opponents"),
        pot.alias("pot"), (pot / 10).alias("pot_bb"), price.alias("to_call"), (price / 10).alias("to_call_bb"), F.when(k % 25 != 0, 500.0).alias("stack"), F.lit(None).cast("double").alias("effective_stack"),
        equity.alias("equity_table"), F.lit(0.4).alias("equity_1v1"), F.lit(None).cast("double").alias("equity_required"), F.when(k % 4 == 0, 1.5).alias("ev_bb"), F.when(k % 4 == 0, 900.0).alias("call_max_bb"),
        F.lit(None).cast("double").alias("solver_iterations"), F.lit(None).cast("double").alias("solver_timeout_s"), (k % 14 != 0).alias("decision_context_known"), F.lit(None).cast("boolean").alias("has_check"),
        F.lit(None).cast("boolean").alias("has_call"), F.lit(None).cast("boolean").alias("has_raise"), F.lit(None).cast("double").alias("to_call_pot_ratio"), buttons.alias("buttons"), active.alias("buttons_active"), players.alias("players"), F.when(k % 2 == 0, "bb").alias("units"),
    )
    return table(spark, sf, "orders", wide=True).select(
        "o_orderkey", F.concat(F.lit("s"), k.cast("string")).alias("snapshot_id"), F.lit("ml_dataset_v1").alias("schema_version"), F.when(k % 29 == 0, "note").otherwise("ml_decision_snapshot").alias("type"), F.lit("2026-01-01").alias("recorded_at"),
        F.struct(street.alias("street"), F.lit("legacy").alias("label_source"), F.lit(None).cast("string").alias("source_type"), none.alias("units")).alias("metadata"), features.alias("features"),
        F.struct(action.alias("legacy_action"), F.when(k % 31 == 0, "RES").otherwise(action).alias("final_action"), (k % 37 != 0).alias("label_valid"), F.lit(False).alias("known_bug_risk")).alias("labels"),
        F.create_map(F.lit("pot_ocr"), F.lit(0.9), F.lit("buttons_min"), F.when(k % 41 == 0, 0.2).otherwise(0.8)).alias("confidence"),
        F.struct(F.lit(True).alias("usable_for_training"), F.lit(None).cast("boolean").alias("usable_for_solver"), (k % 43 == 0).alias("amount_unit_missing")).alias("quality_flags"),
    )


SNAP_CTE = """
WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 9 THEN 'SHOWDOWN' WHEN o_orderkey % 4 = 0 THEN 'PREFLOP' WHEN o_orderkey % 4 = 1 THEN 'FLOP' WHEN o_orderkey % 4 = 2 THEN 'TURN' ELSE 'RIVER' END AS street,
  CASE WHEN o_orderkey % 21 = 1 THEN 1 WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 4 + 2 END AS board_n, (CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 7 + 1) * 10.0 END)::DOUBLE AS price, (o_orderkey % 90 + 10)::DOUBLE AS pot,
  CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 101) / 101.0::DOUBLE END AS eq FROM orders),
s AS (SELECT *, CASE WHEN k % 13 = 0 THEN 'WAIT' WHEN price > 0 THEN CASE WHEN k % 2 = 0 THEN 'CALL' ELSE 'FOLD' END ELSE CASE WHEN k % 2 = 0 THEN 'CHECK' ELSE 'RAISE' END END AS act,
  CASE street WHEN 'PREFLOP' THEN 0 WHEN 'FLOP' THEN 3 WHEN 'TURN' THEN 4 WHEN 'RIVER' THEN 5 END AS need FROM o)
"""


@query("rebuilt_snapshot_features", "P16 P17 P18", SNAP_CTE + """
, r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 0.24 ELSE 0.58 END::DOUBLE AS l0, CASE WHEN k % 2 = 0 THEN 0.92 ELSE 0.32 END::DOUBLE + CASE WHEN k % 6 = 0 THEN 0.08 ELSE 0.0 END::DOUBLE AS a0, (1000.0 - k % 1000) / 1000.0::DOUBLE AS inv FROM s)
SELECT k AS o_orderkey, round(price / pot, 8) AS to_call_pot_ratio, round(price / (pot + price), 8) AS required, price <= 0 AS has_check, price > 0 AS has_call, TRUE AS has_raise,
  concat_ws(',', CASE WHEN price > 0 THEN 'relance' ELSE 'mise' END, CASE WHEN price > 0 THEN 'paie' ELSE 'check' END, CASE WHEN k % 5 <> 0 THEN 'fold' END) AS buttons,
  2 AS profiles, round(greatest(0.0, l0 - 0.1 * inv), 8) AS looseness, round(least(1.0, a0 + 0.18 * inv), 8) AS aggression, round(eq * (pot + price) - price, 6) AS ev,
  CASE WHEN k % 17 = 0 THEN 0.96::DOUBLE WHEN k % 19 <> 0 THEN round(0.05 + 0.34 + 11 / 12.0::DOUBLE * 0.18 + 0.13 + 0.12 + 0.06, 8) END AS strength FROM r
""")
def rebuilt_snapshot_features(spark, sf):
    r = S.rebuilt_features(order_snapshots(spark, sf))
    b = F.col("rebuilt")
    rival = F.get(b["opponent_profiles"], F.lit(1))
    return r.select(
        "o_orderkey", F.round(b["to_call_pot_ratio"], 8).alias("to_call_pot_ratio"), F.round(b["equity_required"], 8).alias("required"), b["has_check"].alias("has_check"), b["has_call"].alias("has_call"), b["has_raise"].alias("has_raise"),
        F.array_join(b["buttons_active"], ",").alias("buttons"), F.size(b["opponent_profiles"]).alias("profiles"), F.round(rival["looseness"], 8).alias("looseness"), F.round(rival["aggression"], 8).alias("aggression"),
        F.round(b["ev"], 6).alias("ev"), F.round(b["starting_hand_strength"], 8).alias("strength"),
    )


@query("padded_opponent_profiles", "P17", """
SELECT o_orderkey, o_orderkey % 5 AS wanted, CAST(o_orderkey % 5 AS INT) AS profiles, CASE WHEN o_orderkey % 5 > 2 THEN 'opponent_' || (o_orderkey % 5) END AS last_padded FROM orders
""")
def padded_opponent_profiles(spark, sf):
    r = S.rebuilt_features(order_snapshots(spark, sf)).withColumn("wanted", F.col("o_orderkey") % 5)
    # The profiles alone, then padded once: beside them the other rebuilt features would be computed for nothing.
    r = r.select("o_orderkey", "wanted", F.col("rebuilt.opponent_profiles").alias("profiles"))
    r = r.withColumn("padded", K.padded_profiles(F.col("profiles"), F.col("wanted").cast("int")))
    padded = F.col("padded")
    return r.select("o_orderkey", "wanted", F.size(padded).alias("profiles"), F.when(F.col("wanted") > 2, F.try_element_at(padded, F.lit(-1))["name"]).alias("last_padded"))


@query("snapshot_semantic_errors", "P36 P19", SNAP_CTE + """
SELECT k AS o_orderkey, concat_ws(';', CASE WHEN k % 29 = 0 THEN 'invalid_type' END, CASE WHEN act = 'WAIT' THEN 'wait_action;invalid_action:WAIT' END, CASE WHEN k % 31 = 0 THEN 'invalid_action:RES' WHEN act = 'WAIT' THEN 'wait_action;invalid_action:WAIT' END,
  CASE WHEN k % 31 = 0 THEN 'action_label_mismatch' END, CASE WHEN k % 37 = 0 THEN 'not_trainable' END, CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN 'invalid_hero_cards' END, CASE WHEN k % 17 = 0 THEN 'duplicate_cards' END,
  CASE WHEN need IS NULL THEN 'invalid_street:SHOWDOWN' END, CASE WHEN need <> board_n THEN 'board_street_mismatch:' || street END, CASE WHEN act = 'FOLD' AND k % 5 = 0 THEN 'action_impossible:FOLD' END) AS errors,
  k % 29 <> 0 AND act <> 'WAIT' AND k % 37 <> 0 AS trainable, k % 29 <> 0 AND k % 37 <> 0 AND k % 43 <> 0 AS live_trainable FROM s
""")
def snapshot_semantic_errors(spark, sf):
    rows = S.semantic_errors(order_snapshots(spark, sf))
    return rows.select("o_orderkey", F.array_join("errors", ";").alias("errors"), S.trainable().alias("trainable"), S.live_trainable().alias("live_trainable"))


@query("snapshot_structure_errors", "P37 S19", """
SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderkey % 4 = 1 THEN '<root> missing:labels' WHEN o_orderkey % 4 = 2 THEN '<root> unknown:extra' WHEN o_orderkey % 4 = 3 THEN '<root> key_order_mismatch' END, CASE WHEN o_orderkey % 5 = 0 THEN 'features missing:pot' END) AS structure,
  concat_ws(';', CASE WHEN o_orderkey % 7 = 0 THEN 'features.price bad_type:STRING' END) AS types FROM orders
""")
def snapshot_structure_errors(spark, sf):
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, F.lit('"x"')).when(k % 2 == 0, F.lit("3")).otherwise("3.5")
    features = F.concat(F.lit('"features": {'), F.when(k % 5 == 0, F.lit("")).otherwise('"pot": 1.0, '), F.lit('"price": '), price, F.lit("}"))
    labels = F.lit('"labels": {"a": "b"}')
    raw = F.when(k % 4 == 1, F.concat(F.lit("{"), features, F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("{"), features, F.lit(", "), labels, F.lit(', "extra": 1}'))).when(
        k % 4 == 3, F.concat(F.lit("{"), labels, F.lit(", "), features, F.lit("}"))).otherwise(F.concat(F.lit("{"), features, F.lit(", "), labels, F.lit("}")))
    rows = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    checked = S.structural_errors(rows, "raw", {"": ["features", "labels"], "features": ["pot", "price"]})
    checked = S.type_errors(checked, "raw", {"features.price": ["DOUBLE"]})
    return checked.select("o_orderkey", F.array_join("structure_errors", ";").alias("structure"), F.array_join("type_errors", ";").alias("types"))


@query("strict_training_rows", "P38 P39 K7 X1", SNAP_CTE + """
, q AS (SELECT *, coalesce(eq, 0.4) AS e, price / (pot + price) AS req FROM s),
d AS (SELECT *, CASE WHEN price <= 0 THEN CASE WHEN e >= 0.62 THEN 'BET' ELSE 'CHECK' END ELSE CASE WHEN e >= req + 0.24::DOUBLE THEN 'RAISE' WHEN e >= req THEN 'CALL' ELSE 'FOLD' END END AS dec FROM q)
SELECT k AS o_orderkey, dec AS decision, CASE dec WHEN 'BET' THEN greatest(1.0, round_even(pot * 0.5, 2)) WHEN 'RAISE' THEN greatest(price * 2, round_even(pot * 0.6, 2)) END AS raise_amount,
  concat_ws(';', CASE WHEN k % 19 = 0 AND k % 17 <> 0 THEN 'invalid_hero_cards' END, CASE WHEN need IS NULL THEN 'invalid_street' END, CASE WHEN need <> board_n THEN 'board_street_mismatch' END, CASE WHEN k % 17 = 0 THEN 'duplicate_cards' END,
    CASE WHEN k % 23 = 0 THEN 'missing_hero_position' END, CASE WHEN dec = 'FOLD' AND k % 5 = 0 THEN 'action_impossible:FOLD' END) AS reasons,
  CASE WHEN NOT ((k % 19 = 0 AND k % 17 <> 0) OR need IS NULL OR need <> board_n OR k % 17 = 0 OR k % 23 = 0 OR (dec = 'FOLD' AND k % 5 = 0)) THEN CASE WHEN dec = 'BET' THEN 'RAISE' ELSE dec END END AS label FROM d
""")
def strict_training_rows(spark, sf):
    rows = S.strict_rows(S.threshold_decision(order_snapshots(spark, sf)))
    return rows.select("o_orderkey", F.col("decision.action").alias("decision"), F.col("decision.raise_amount").alias("raise_amount"), F.array_join("reasons", ";").alias("reasons"), "label")


@query("live_bb_candidates", "P20 P47 P41 S4 X4", SNAP_CTE + """
SELECT k AS o_orderkey, CASE WHEN k % 31 = 0 THEN 'RAISE' ELSE act END AS label, street, pot / 10 AS pot_bb, CASE WHEN k % 4 = 0 THEN 500.0 ELSE 0.0 END::DOUBLE AS call_max_bb, round(coalesce(eq, 0), 8) AS equity, round(coalesce(eq, 0) - price / (pot + price), 8) AS gap,
  90.0::DOUBLE AS hero_stack, CASE WHEN k % 1000 > 0 THEN least(90.0, (k % 1000) / 10.0) ELSE 90.0 END::DOUBLE AS effective, (price <= 0)::INT::DOUBLE AS has_check, CASE WHEN k % 12 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS opponents,
  CASE WHEN eq IS NOT NULL AND k % 4 = 0 THEN 'stored_equity_ev_callmax_used' WHEN eq IS NOT NULL THEN 'rebuilt_equity_features_used' ELSE 'deterministic_features_only' END AS status FROM s
""")
def live_bb_candidates(spark, sf):
    rows = S.live_candidates(S.rebuilt_features(order_snapshots(spark, sf)), "hero")
    c = N.col
    return rows.select(
        F.substring("snapshot_id", 2, 20).cast("bigint").alias("o_orderkey"), F.col("bootstrap_label").alias("label"), c("metadata.street").alias("street"), c("features.pot_bb").alias("pot_bb"), c("features.call_max_bb").alias("call_max_bb"),
        F.round(c("features.equity_table"), 8).alias("equity"), F.round(c("features.equity_gap"), 8).alias("gap"), c("features.hero_stack_bb").alias("hero_stack"), c("features.effective_stack_bb").alias("effective"),
        c("features.has_check").alias("has_check"), c("features.active_opponents").alias("opponents"), F.col("enrichment_status").alias("status"),
    )


@query("snapshot_job_mapping", "P24 P26 P22", SNAP_CTE + """
, m AS (SELECT *, CASE WHEN k % 41 = 0 THEN 'confidence_too_low:buttons_min' WHEN street IN ('SHOWDOWN', 'PREFLOP') THEN 'unsupported_street:' || street WHEN k % 12 = 0 THEN 'non_heads_up_snapshot' WHEN k % 15 = 0 THEN 'villain_hand_missing'
   WHEN k % 14 = 0 THEN 'decision_context_unknown' WHEN k % 17 = 0 THEN 'ValueError:invalid_card:hero_hand:A♠' WHEN k % 19 = 0 THEN 'ValueError:hero_hand_card_count:1_expected:2' ELSE 'ValueError:invalid_card:hero_hand:A♠' END AS why FROM s)
SELECT k AS o_orderkey, CASE WHEN why IS NULL THEN 'ok' ELSE 'failed' END AS status, why AS error FROM m
""")
def snapshot_job_mapping(spark, sf):
    jobs = J.jobs_from_snapshots(order_snapshots(spark, sf))
    return jobs.select(F.regexp_extract("source_snapshot_id", "([0-9]+)", 1).cast("bigint").alias("o_orderkey"), F.col("mapping_status").alias("status"), F.col("mapping_error").alias("error"))


@query("generated_run_candidates", "P45 F30", """
WITH x AS (SELECT o_orderkey AS k, (o_orderkey % 100 + 1)::DOUBLE AS pot, (o_orderkey % 20)::DOUBLE AS c, CASE WHEN o_orderkey % 50 = 0 THEN 1.0 ELSE (o_orderkey % 89) / 89.0::DOUBLE END::DOUBLE AS e FROM orders)
SELECT k AS o_orderkey, CASE k % 4 WHEN 0 THEN 'RAISE' WHEN 1 THEN 'CALL' WHEN 2 THEN 'ALL_IN' ELSE 'BET_42' END AS label, CASE k % 4 WHEN 2 THEN 'all_in_excluded' WHEN 3 THEN 'unmapped_action' END AS dropped, round_even(c / (pot + c), 6) AS required,
  round(e * (pot + c) - c, 6) AS ev, round(CASE WHEN e >= 1 THEN 500.0 ELSE least(500.0, e * pot / (1 - e)) END, 6) AS call_max, 1.0::DOUBLE AS has_check, (k % 2)::DOUBLE AS has_call, (1 - k % 2)::DOUBLE AS has_raise FROM x
""")
def generated_run_candidates(spark, sf):
    k = F.col("o_orderkey")
    legal = F.when(k % 2 == 0, F.create_map(F.lit("CHECK"), F.lit(0.5), F.lit("BET_33"), F.lit(0.5))).otherwise(F.create_map(F.lit("CHECK"), F.lit(0.5), F.lit("CHECK_CALL"), F.lit(0.5)))
    rows = table(spark, sf, "orders").select(
        "o_orderkey", (k % 100 + 1).cast("double").alias("pot"), (k % 20).cast("double").alias("to_call"), F.lit(100.0).alias("stack"), F.when(k % 50 == 0, 1.0).otherwise((k % 89) / F.lit(89.0)).alias("equity"), legal.alias("action_frequencies"),
        F.when(k % 4 == 0, "bet 33").when(k % 4 == 1, "check-call").when(k % 4 == 2, "allin").otherwise("BET_42").alias("dominant_action"),
    )
    out = S.run_candidates(rows)
    c = N.col
    return out.select(
        "o_orderkey", F.col("bootstrap_label").alias("label"), F.col("drop_reason").alias("dropped"), c("features.equity_required").alias("required"), c("features.ev_bb").alias("ev"), F.round(c("features.call_max_bb"), 6).alias("call_max"),
        c("features.has_check").alias("has_check"), c("features.has_call").alias("has_call"), c("features.has_raise").alias("has_raise"),
    )


def flat_candidates(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders", wide=True).select(
        F.when(k % 6 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("source_id"), k.alias("row_index"), F.when(k % 4 == 0, "flop").otherwise("river").alias("street"), F.when(k % 7 == 0, "").otherwise('["Ah","Kd"]').alias("hero_cards"),
        F.lit('["2c","3c","4c"]').alias("board_cards"), F.when(k % 9 == 0, "x").otherwise((k % 300).cast("string")).alias("pot"), F.when(k % 3 == 0, "0").otherwise((k % 40 + 1).cast("string")).alias("to_call"), F.lit("1000").alias("stack"),
        F.when(k % 5 == 0, "True").otherwise("false").alias("excluded"), F.when(k % 5 == 0, "").otherwise("RAISE").alias("bootstrap_label"), F.when(k % 5 == 0, "action_unstable").alias("exclusion_reason"), F.when(k % 2 == 0, "BET_33").otherwise("CHECK").alias("raw_action"),
        F.when(k % 8 != 0, ((k % 50) / F.lit(50.0)).cast("string")).alias("equity_1v1"), F.when(k % 11 == 0, "4").alias("player_active"), F.lit("IP").alias("position_model"), F.when(k % 10 == 1, "weak").alias("weak_rule_reason"),
    )


ALIGNED_CTE = """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 300)::DOUBLE END AS pot, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE (o_orderkey % 40 + 1) END::DOUBLE AS c, o_orderkey % 5 = 0 AS ex,
  CASE WHEN o_orderkey % 8 <> 0 THEN (o_orderkey % 50) / 50.0::DOUBLE ELSE 0.5 END::DOUBLE AS e1, CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 1 END AS opp FROM orders),
y AS (SELECT *, round_even(power(e1, opp), 10) AS et FROM x)
"""


@query("aligned_export_rows", "P14 P15 K8 F17", ALIGNED_CTE + """
SELECT k AS row_index, CASE WHEN k % 6 <> 0 THEN 'c' || k ELSE 'bootstrap_v5_' || format('{:06d}', k) END AS snapshot_id, CASE WHEN k % 4 = 0 THEN 'FLOP' ELSE 'RIVER' END AS street,
  CASE WHEN NOT ex THEN 'RAISE' END AS label, NOT ex AS usable, opp::BIGINT AS opponents, et AS equity_table, round(et * (pot + c) - c, 10) AS ev, round(CASE WHEN pot + c > 0 THEN c / (pot + c) END, 10) AS required, k % 8 <> 0 AS known,
  CASE WHEN c > 0 THEN 'relance,paie,fold' ELSE 'mise,check,fold' END AS buttons, CASE WHEN c > 0 THEN CASE WHEN k % 2 = 0 THEN 'raise 33' ELSE 'raise 20' END ELSE CASE WHEN k % 2 = 0 THEN 'bet 33' ELSE 'bet 20' END END AS first_button,
  CASE WHEN ex THEN 'action_unstable' WHEN k % 10 = 1 THEN 'weak' ELSE 'bootstrap_solver_candidate' END AS debug_reason, opp AS profiles, 2 AS players, k % 7 = 0 AS hero_uncertain FROM y
""")
def aligned_export_rows(spark, sf):
    rows = S.aligned_rows(flat_candidates(spark, sf))
    c = N.col
    return rows.select(
        c("metadata.hand_id").alias("row_index"), "snapshot_id", c("metadata.street").alias("street"), F.col("bootstrap_label").alias("label"), c("quality_flags.usable_for_training").alias("usable"), c("features.active_opponents").alias("opponents"),
        c("features.equity_table").alias("equity_table"), c("features.ev").alias("ev"), c("features.equity_required").alias("required"), c("features.equity_known").alias("known"),
        F.array_join(c("features.buttons_active"), ",").alias("buttons"), F.get(c("features.buttons"), F.lit(0))["text"].alias("first_button"), c("debug.decision_reason").alias("debug_reason"), F.size(c("features.opponent_profiles")).alias("profiles"),
        F.size(c("features.players")).alias("players"), c("quality_flags.hero_cards_uncertain").alias("hero_uncertain"),
    )


def equity_candidates(spark, sf):
    """Flat rows of dealt cards: boards of three to five cards, suits renamed every other row, some rows without a showdown."""
    k = F.col("c_custkey")
    spots = deals(spark, sf, "customer", "c_custkey")
    renamed = lambda cards: F.when(k % 2 == 0, F.transform(cards, lambda c: F.translate(c, "shdc", "hcsd"))).otherwise(cards)
    shown = F.slice("board", F.lit(1), F.when(k % 3 == 0, 5).when(k % 3 == 1, 4).otherwise(3))
    board = F.when(k % 11 == 0, F.concat(F.slice("hero", 1, 1), F.slice("board", 1, 4))).when(k % 17 == 0, F.concat(shown, F.array(F.lit("")))).otherwise(shown)
    villain = F.when(k % 13 == 0, F.array(F.lit("??"), F.lit("Ah"))).when(k % 14 == 0, F.slice("villain", 1, 1)).otherwise(F.col("villain"))
    return spots.select(
        k.alias("row_index"), F.lit("RIVER").alias("street"), F.to_json(renamed(F.col("hero"))).alias("hero_cards"), F.when(k % 19 != 0, F.to_json(renamed(villain))).alias("villain_hand"), F.to_json(renamed(board)).alias("board_cards"),
        (k % 300 + 1).cast("string").alias("pot"), (k % 40).cast("string").alias("to_call"), F.when(k % 8 == 0, ((k % 50) / F.lit(50.0)).cast("string")).alias("equity_1v1"), F.when(k % 5 == 0, "3").alias("player_active"),
        F.when(k % 4 == 0, '{"RAISE": 0.75, "CALL": 0.25}').alias("action_frequencies"),
    )


@query("aligned_export_equity", "P14 P15 F25", f"""
WITH {DECK_CTE}, {PAIRS_CTE}, {deal_cte('customer', 'c_custkey')},
spots AS (SELECT c_custkey AS k, dm[1]|dm[2] AS h, dm[3]|dm[4] AS v, CASE c_custkey % 3 WHEN 0 THEN dm[5]|dm[6]|dm[7]|dm[8]|dm[9] WHEN 1 THEN dm[5]|dm[6]|dm[7]|dm[8] ELSE dm[5]|dm[6]|dm[7] END AS b,
  c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 14 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 8 <> 0 AS shown FROM dealt),
options AS (SELECT 0::BIGINT AS m, 0 AS n UNION ALL SELECT m, 1 FROM deckc UNION ALL SELECT m, 2 FROM pairs),
runs AS (SELECT k, h|b|o.m AS hm, v|b|o.m AS vm FROM spots JOIN options o ON o.n = k % 3 AND (o.m & (h|v|b)) = 0 WHERE shown),
s1 AS ({score_sql('runs', 'hm', 'hs')}), s2 AS ({score_sql('s1', 'vm', 'vs')}),
found AS (SELECT k, round_even(avg(CASE WHEN hs > vs THEN 1.0 WHEN hs = vs THEN 0.5 ELSE 0.0 END), 10) AS e FROM s2 GROUP BY k),
x AS (SELECT k, CASE WHEN k % 8 = 0 THEN round_even((k % 50) / 50.0::DOUBLE, 10) ELSE e END AS e1, (k % 300 + 1)::DOUBLE AS pot, (k % 40)::DOUBLE AS c, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS opp FROM spots LEFT JOIN found USING (k)),
y AS (SELECT *, coalesce(e1, 0.5) AS one, round_even(power(coalesce(e1, 0.5), opp), 10) AS et FROM x)
SELECT k AS row_index, e1 IS NOT NULL AS known, round(one, 8) AS equity, round(et, 8) AS equity_table, round(et * (pot + c) - c, 6) AS ev, round(least(et, 0.999999) * pot / (1 - least(et, 0.999999)), 4) AS call_max,
  CASE WHEN k % 4 = 0 THEN 2 ELSE 0 END AS n_frequencies, '2026-05-26' AS fix_date, '' AS ml_action, FALSE AS incoherent FROM y
""")
def aligned_export_equity(spark, sf):
    rows = S.aligned_rows(equity_candidates(spark, sf))
    c = N.col
    return rows.select(
        c("metadata.hand_id").alias("row_index"), c("features.equity_known").alias("known"), F.round(c("features.equity_1v1"), 8).alias("equity"), F.round(c("features.equity_table"), 8).alias("equity_table"),
        F.round(c("features.ev"), 6).alias("ev"), F.round(c("features.call_max"), 4).alias("call_max"), F.size(c("audit.action_frequencies")).alias("n_frequencies"), c("metadata.decision_engine_fix_date").alias("fix_date"),
        c("labels.ml_action").alias("ml_action"), c("quality_flags.buttons_incoherent").alias("incoherent"),
    )


@query("bootstrap_feature_views", "P34 P5 S7 P33", """
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 300)::DOUBLE END AS pot FROM orders)
SELECT k AS row_index, pot, CASE WHEN k % 8 <> 0 THEN round((k % 50) / 50.0::DOUBLE - 0.25, 8) END AS gap, round(CASE WHEN pot > 0 THEN 1000 / pot END, 8) AS spr, CASE WHEN k % 11 = 0 THEN 3.0 END::DOUBLE AS opponents, CASE WHEN k % 7 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS known,
  CASE WHEN k % 2 = 0 THEN 0.35 END::DOUBLE AS looseness, CASE WHEN k % 4 = 0 THEN 'flop' ELSE 'river' END AS street FROM x
""")
def bootstrap_feature_views(spark, sf):
    rows = flat_candidates(spark, sf).withColumns({
        "features.equity_required": F.lit("0.25"),
        "opponent_profiles": F.when(F.col("row_index") % 2 == 0, F.lit('[{"looseness": 0.2, "aggression": 1.0}, {"looseness": 0.5}, {"aggression": 0.1}]')).otherwise("[not json"),
    })
    out = S.feature_views(rows, H.FEATURE_ALIASES)
    c = N.col
    return out.select(
        "row_index", c("features.pot").alias("pot"), F.round(c("features.equity_gap"), 8).alias("gap"), F.round(c("features.stack_to_pot_ratio"), 8).alias("spr"), c("features.active_opponents").alias("opponents"),
        c("features.hero_cards_known").alias("known"), F.round(c("features.opponent_looseness_avg"), 8).alias("looseness"), c("metadata.street").alias("street"),
    )


@query("prediction_input_check", "P42", """
SELECT o_orderkey AS row_index, CASE WHEN o_orderkey % 9 = 0 AND FALSE THEN '' ELSE '' END AS errors, concat_ws(';', CASE WHEN o_orderkey % 4 = 0 THEN 'unknown_category:street:flop' END, CASE WHEN o_orderkey % 8 = 0 THEN 'optional_numeric_field_missing:equity_1v1' END, 'optional_numeric_field_missing:ev') AS warnings FROM orders
""")
def prediction_input_check(spark, sf):
    out = S.input_check(flat_candidates(spark, sf), ["pot", "stack"], {"street": ["river", "turn"]}, ["equity_1v1", "ev"])
    return out.select("row_index", F.array_join("input_errors", ";").alias("errors"), F.array_join("input_warnings", ";").alias("warnings"))


@query("solver_context_choice", "P41", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 'IP' WHEN o_orderkey % 4 = 1 THEN 'OOP' WHEN o_orderkey % 2 = 1 THEN 'IP' ELSE 'OOP' END ELSE 'OOP' END AS position, CASE WHEN o_orderkey % 3 > 0 THEN 'hero_facing_bet' ELSE 'hero_check_or_bet' END AS context FROM orders
""")
def solver_context_choice(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(k % 4 == 0, "btn").when(k % 4 == 1, "UTG").otherwise("?").alias("hero_position"), (k % 3).cast("double").alias("to_call"), F.lit(0.0).alias("has_call"), k.alias("attempt"))
    context = S.solver_context(F.col("hero_position"), F.col("to_call"), F.col("has_call"), F.col("attempt"))
    return rows.select("o_orderkey", context["position"].alias("position"), context["context"].alias("context"))
