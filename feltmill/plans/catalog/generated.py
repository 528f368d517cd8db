"""Generated spots whose index is a table key, and request rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import cards as C
from ...sources import files as I
from ...sources import generated as G
from ...operators import jobs as J
from ...registry import query, table
from .records import SENS_CTE, item_sensitivity
from ...operators import runs as R


def _indexed(spark, sf, name, key):
    return table(spark, sf, name, wide=True).select(F.col(key).alias("generation_index"))


@query("generated_board_profiles", "S15 P40 F27", """
SELECT c_custkey AS generation_index, unnest(['drawy_board_spot', 'paired_board_spot', 'made_hand_vs_draw_spot', 'top_pair_spot', 'two_pair_plus_spot']) AS profile, 7 AS distinct_cards, TRUE AS holds FROM customer
""")
def generated_board_profiles(spark, sf):
    base = _indexed(spark, sf, "customer", "c_custkey")
    out = None
    for profile in G.BOARD_PROFILES:
        rows = G.generated_cards(base, profile)
        board, hero = F.col("board"), F.col("hero_hand")
        ranks = F.transform(board, C.rank_value)
        top = F.array_max(ranks)
        hole = F.transform(hero, C.rank_value)
        holds = {
            "drawy_board_spot": C.is_drawy(board), "paired_board_spot": C.is_paired(board), "made_hand_vs_draw_spot": F.array_contains(ranks, F.get(hole, F.lit(0))),
            "top_pair_spot": F.get(hole, F.lit(0)) == top, "two_pair_plus_spot": F.size(F.array_intersect(ranks, hole)) == 2,
        }[profile]
        part = rows.select("generation_index", F.lit(profile).alias("profile"), F.size(F.array_distinct(F.concat("hero_hand", "villain_hand", "board"))).alias("distinct_cards"), holds.alias("holds"))
        out = part if out is None else out.unionByName(part)
    return out


@query("generated_solver_jobs", "S14 P22 P26", """
SELECT o_orderkey AS generation_index, 'synthetic_solver_job_random_river_spot_seed_17_' || format('{:06d}', o_orderkey) AS solver_job_id, 'ok' AS status, 5 AS board_cards, TRUE AS amounts_from_pools FROM orders
""")
def generated_solver_jobs(spark, sf):
    jobs = G.generated_jobs(_indexed(spark, sf, "orders", "o_orderkey"), "random_river_spot")
    texts = jobs.withColumns({c: F.col(c).cast("string") for c in ("pot", "to_call", "stack", "iterations", "timeout_s")}).withColumn("bet_sizes", F.col("bet_sizes").cast("array<string>"))
    checked = J.validate_jobs(texts)
    pools = F.col("pot").isin(*G.POTS) & F.col("stack").isin(*G.STACKS) & (F.col("to_call") <= F.col("pot") / 2)
    return checked.select("generation_index", "solver_job_id", "status", F.size("board").alias("board_cards"), pools.alias("amounts_from_pools"))


@query("generated_hero_jobs", "S16 P26", """
SELECT o_orderkey AS generation_index, 'hero_ip_facing_bet' AS generation_profile, TRUE AS in_pools, 9 AS cards, 0 AS seat FROM orders
""")
def generated_hero_jobs(spark, sf):
    jobs = J.build_hero_jobs(G.hero_jobs(_indexed(spark, sf, "orders", "o_orderkey"), "hero_ip_facing_bet"))
    pools = F.col("pot").isin(*G.BET_POTS) & F.col("to_call").isin(*G.PRICES) & F.col("build_error").isNull()
    return jobs.select("generation_index", "generation_profile", pools.alias("in_pools"), F.size(F.array_distinct(F.concat("hero_hand", "villain_hand", "board"))).alias("cards"), F.col("hero_solver_player").alias("seat"))


@query("generated_decision_snapshots", "S17", """
SELECT o_orderkey AS generation_index, 'synthetic:' || (o_orderkey + 1) AS snapshot_id, TRUE AS board_fits, TRUE AS amounts_fit, TRUE AS players_fit FROM orders
""")
def generated_decision_snapshots(spark, sf):
    s = G.generated_snapshots(_indexed(spark, sf, "orders", "o_orderkey"))
    fits = F.lit(False)
    for street, n in C.STREET_CARDS.items():
        fits = F.when(F.col("street") == street, F.size("board_cards") == n).otherwise(fits)
    amounts = F.col("pot").between(40.0, 500.0) & F.col("to_call").between(0.0, 250.0)
    players = (F.size("players") == F.col("player_start")) & F.col("player_start").between(F.col("player_active"), F.lit(5)) & (F.size("buttons") == 3)
    return s.select("generation_index", "snapshot_id", fits.alias("board_fits"), amounts.alias("amounts_fit"), players.alias("players_fit"))


@query("experiment_plan_rows", "S18", """
WITH t AS (SELECT unnest(['high_spr_small_call_b33', 'mid_spr_medium_call_b66', 'low_spr_large_call_b100']) AS scenario, unnest([100.0, 300.0, 800.0]) AS pot, unnest([0.10, 0.33, 0.75]) AS r)
SELECT s_suppkey, context, scenario, iterations, round((CASE WHEN context = 'hero_oop_check_or_bet' THEN 0.0 ELSE pot * r END)::DOUBLE, 6) AS to_call, 'sensitivity_' || context || '_' || scenario || '_it' || iterations AS solver_job_id
FROM supplier, t, (SELECT unnest(['hero_oop_check_or_bet', 'hero_ip_facing_bet', 'hero_oop_facing_bet']) AS context), (SELECT unnest([25, 50, 100]) AS iterations)
""")
def experiment_plan_rows(spark, sf):
    out = G.experiment_plan(table(spark, sf, "supplier").select("s_suppkey"))
    return out.select("s_suppkey", "context", "scenario", "iterations", "to_call", "solver_job_id")


@query("weak_rule_top_up", "M6 U2 S20", SENS_CTE + """
, wn AS (SELECT k.label, count(x.act) AS n FROM (SELECT unnest(['CHECK', 'FOLD', 'RAISE']) AS label) k LEFT JOIN (SELECT CASE act WHEN 'BET_33' THEN 'RAISE' ELSE act END AS act FROM x WHERE why IS NULL) x ON x.act = k.label GROUP BY 1),
wt AS (SELECT label, greatest(10, 34, (SELECT max(n) FROM wn)) - n AS need FROM wn), wg AS (SELECT label, unnest(generate_series(0, need - 1)) AS i FROM wt WHERE need > 0)
SELECT 'weak_rule_' || lower(label) || '_' || CASE WHEN i < 10000 THEN lpad(i::VARCHAR, 4, '0') ELSE i::VARCHAR END AS source_id, label AS bootstrap_label,
  CASE label WHEN 'CHECK' THEN 180 + i % 5 * 30 WHEN 'FOLD' THEN 300 + i % 5 * 50 ELSE 220 + i % 5 * 40 END::DOUBLE AS pot, CASE label WHEN 'CHECK' THEN 0 WHEN 'FOLD' THEN 180 + i % 4 * 60 ELSE CASE WHEN i % 2 = 0 THEN 0 ELSE 40 END END::DOUBLE AS to_call,
  CASE label WHEN 'CHECK' THEN 'CHECK' WHEN 'FOLD' THEN 'FOLD' ELSE ['BET_33', 'BET_50', 'BET_66', 'RAISE_33', 'RAISE_66'][CAST(i % 5 + 1 AS INT)] END AS raw_action FROM wg
""")
def weak_rule_top_up(spark, sf):
    rows = R.candidate_rows(R.normalize_sensitivity(item_sensitivity(spark, sf)))
    return G.weak_rule_rows(rows, balance=True).select("source_id", "bootstrap_label", "pot", "to_call", "raw_action")


@query("solve_request_parsing", "S12", """
SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 5 = 0 THEN '''preflop'' rejected' END, CASE WHEN c_custkey % 7 = 0 THEN 'stacks_bb not an integer:ten' END, CASE WHEN c_custkey % 11 = 0 THEN 'invalid bet_sizes' END, CASE WHEN c_custkey % 13 = 0 THEN 'invalid initial_board' END) AS errors,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 'As Kc 7d' END AS board, CASE WHEN c_custkey % 7 <> 0 THEN 100 END::BIGINT AS stacks_bb FROM customer
""")
def solve_request_parsing(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.cast("string").alias("name"), F.when(k % 5 == 0, "Preflop").otherwise(" flop").alias("starting_street"),
        F.when(k % 13 == 0, "AsKc7").when(k % 3 == 0, "AsKc7d").when(k % 3 == 1, "As Kc 7d").otherwise("As,Kc,7d").alias("initial_board"), F.when(k % 7 == 0, "ten").otherwise("100").alias("stacks_bb"),
        F.when(k % 11 == 0, "0.5,x").otherwise("0.33, 0.75").alias("bet_sizes"), F.lit("").alias("abstraction_path"), F.lit("500").alias("iterations"),
    )
    out = I.parse_requests(rows)
    good = ~F.exists("board", lambda c: c.isNull())
    return out.select(F.col("name").cast("bigint").alias("c_custkey"), F.array_join("errors", ";").alias("errors"), F.when(good, F.array_join("board", " ")).alias("board"), "stacks_bb")


@query("conversation_sections", "S11", "SELECT conv_id, 2 * count(*) AS sections FROM conversations GROUP BY 1")
def conversation_sections(spark, sf):
    def section(hand):
        head = F.concat(F.lit("## Game: "), F.col("conv_id").cast("string"), F.lit(" | Hand: "), hand.cast("string"), F.lit(" ##\n"))
        return F.concat(head, F.regexp_replace("text", "##", ""), F.lit("\n"))

    blobs = table(spark, sf, "conversations").select("conv_id", F.concat(section(F.col("turn")), section(F.col("turn") + 1000)).alias("text"))
    return I.split_sections(blobs, "conv_id", "text").groupBy("conv_id").agg(F.count(F.lit(1)).alias("sections"))
