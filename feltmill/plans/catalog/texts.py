"""Texts, labels, prompts and scenarios. Where the tables hold no action text it is spelled from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import cards as C
from ...functions import text as X
from ...functions import values as V
from ...operators import normalize as N
from ...registry import query, table


@query("page_text_cleaning", "F1", r"""
WITH t AS (SELECT page_id, regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM pages),
c AS (SELECT page_id, trim(regexp_replace(translate(regexp_replace(x, '<[^>]+>', ' ', 'g'), '_-', '  '), '\s+', ' ', 'g')) AS x FROM t)
SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM c
""")
def page_text_cleaning(spark, sf):
    cleaned = table(spark, sf, "pages", wide=True).select("page_id", X.clean_action(F.col("html")).alias("x"))
    return cleaned.select("page_id", F.length("x").cast("bigint").alias("n_chars"), F.md5("x").alias("digest"))


ACTION_SPARK = """CASE event_id % 9 WHEN 0 THEN '<b>Checks</b>' WHEN 1 THEN concat('Call &amp; ', value) WHEN 2 THEN concat('x <action>raises to ', value, '</action>')
  WHEN 3 THEN 'FOLDED' WHEN 4 THEN concat('all_in-', value) WHEN 5 THEN concat('b', value) WHEN 6 THEN concat(value, ' bb') WHEN 7 THEN 'k' ELSE 'wins the pot' END"""


@query("action_text_classes", "F1 F2 F3 P9", """
SELECT event_id,
  CASE event_id % 9 WHEN 0 THEN 'Checks' WHEN 1 THEN 'Call & ' || value WHEN 2 THEN 'raises to ' || value WHEN 3 THEN 'FOLDED' WHEN 4 THEN 'all in ' || value
    WHEN 5 THEN 'b' || value WHEN 6 THEN value || ' bb' WHEN 7 THEN 'k' ELSE 'wins the pot' END AS cleaned,
  CASE event_id % 9 WHEN 0 THEN 'CHECK' WHEN 7 THEN 'CHECK' WHEN 1 THEN 'CALL' WHEN 3 THEN 'FOLD' WHEN 8 THEN NULL ELSE 'RAISE' END AS action_class,
  CASE event_id % 9 WHEN 0 THEN 'NO_INVEST' WHEN 7 THEN 'NO_INVEST' WHEN 1 THEN 'CALL' WHEN 3 THEN 'NO_INVEST' WHEN 8 THEN NULL ELSE 'RAISE' END AS intent,
  CASE WHEN event_id % 9 IN (2, 4, 5) THEN value END AS bet_size FROM events
""")
def action_text_classes(spark, sf):
    rows = table(spark, sf, "events").select("event_id", X.clean_action(F.expr(ACTION_SPARK)).alias("cleaned"))
    c = X.action_class(F.col("cleaned"))
    return rows.select("event_id", "cleaned", c.alias("action_class"), X.intent_of(c).alias("intent"), X.bet_size(F.col("cleaned")).alias("bet_size"))


@query("document_action_words", "F7", r"""
SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '\bthe\b')) AS INT) AS whole_words,
  CAST((length(upper(text)) - length(replace(upper(text), 'TH', ''))) / 2 AS INT) AS parts FROM documents
""")
def document_action_words(spark, sf):
    low, up = F.lower("text"), F.upper("text")
    return table(spark, sf, "documents", wide=True).select(
        "doc_id", F.regexp_count(low, F.lit(r"\bthe\b")).alias("whole_words"),
        ((F.length(up) - F.length(F.replace(up, F.lit("TH"), F.lit("")))) / 2).cast("int").alias("parts"),
    )


HISTORY_SPARK = """concat_ws(', ', if(event_id % 2 = 0, 'UTG check', 'UTG fold'), if(event_id % 3 = 0, 'CO bet 20', 'CO called 2'),
  if(event_id % 5 = 0, concat('BTN RAISE', value), 'BTN checked'), if(event_id % 7 = 0, 'allin', 'all-in'))"""


@query("action_history_counts", "F6 F7 F8 F9", """
SELECT event_id,
  (event_id % 2 = 0)::INT + (event_id % 5 <> 0)::INT AS word_checks, (event_id % 3 <> 0)::INT AS word_calls, (event_id % 2 <> 0)::INT AS word_folds,
  (event_id % 3 = 0)::INT + 1 + CASE WHEN event_id % 5 = 0 AND FALSE THEN 1 ELSE 0 END AS word_raises,
  (event_id % 2 = 0)::INT + (event_id % 5 <> 0)::INT AS part_checks, (event_id % 3 <> 0)::INT AS part_calls, (event_id % 2 <> 0)::INT AS part_folds,
  (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 7 = 0)::INT AS part_raises,
  CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_id % 5 = 0 THEN value ELSE 1.0 END ELSE 0.0 END AS price,
  event_id % 4 = 3 AS can_raise, CASE event_id % 4 WHEN 3 THEN 3 ELSE 2 END AS moves FROM events
""")
def action_history_counts(spark, sf):
    moves = F.expr("CASE event_id % 4 WHEN 0 THEN \"['check', 'fold']\" WHEN 1 THEN 'fold, call' WHEN 2 THEN \"['fold','call']\" ELSE 'call 2, raise 10,fold' END")
    rows = table(spark, sf, "events").select("event_id", F.expr(HISTORY_SPARK).alias("h"), X.legal_moves(moves).alias("m"))
    w, p = X.history_word_counts(F.col("h")), X.history_part_counts(F.col("h"))
    return rows.select(
        "event_id", w["check"].alias("word_checks"), w["call"].alias("word_calls"), w["fold"].alias("word_folds"), w["bet_raise"].alias("word_raises"),
        p["check"].alias("part_checks"), p["call"].alias("part_calls"), p["fold"].alias("part_folds"), p["bet_raise"].alias("part_raises"),
        X.price_from_history(X.has_move(F.col("m"), "CALL"), F.col("h")).alias("price"),
        X.has_raise_move(F.col("m")).alias("can_raise"), F.size("m").alias("moves"),
    )


@query("oracle_label_normalization", "F4 F5 P41", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CASE l_linenumber % 7 WHEN 0 THEN 'CHECK' WHEN 1 THEN 'FOLD' WHEN 2 THEN 'CALL' WHEN 3 THEN 'RAISE' WHEN 4 THEN 'RAISE' WHEN 5 THEN 'RAISE' ELSE 'SHRUG NOW' END AS oracle_label,
  CASE l_linenumber % 7 WHEN 0 THEN 'CHECK' WHEN 1 THEN NULL WHEN 2 THEN 'RAISE' WHEN 3 THEN NULL WHEN 4 THEN 'FOLD' WHEN 5 THEN 'RAISE' ELSE NULL END AS solver_action,
  CASE l_linenumber % 7 WHEN 0 THEN 'CHECK' WHEN 1 THEN 'ALL_IN' WHEN 2 THEN 'RAISE' WHEN 3 THEN 'CALL' WHEN 4 THEN 'FOLD' WHEN 5 THEN 'RAISE_66' ELSE 'CALL' END AS live_action FROM lineitem
""")
def oracle_label_normalization(spark, sf):
    q = F.col("l_quantity").cast("string")
    n = F.col("l_linenumber") % 7
    oracle = F.when(n == 0, "check").when(n == 1, " Fold now").when(n == 2, "CALL").when(n == 3, F.concat(q, F.lit("bb"))).when(n == 4, q).when(n == 5, F.concat(F.lit("Raise "), q)).otherwise("shrug now")
    action = F.when(n == 0, "check").when(n == 1, "all-in").when(n == 2, "bet 33").when(n == 3, "CHECK_CALL").when(n == 4, "fold").when(n == 5, "RAISE-66").otherwise("col")
    live = F.when(n == 1, "allin").otherwise(action)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.oracle_label(oracle).alias("oracle_label"), X.solver_action(action).alias("solver_action"),
        X.live_solver_action(live).alias("live_action"),
    )


@query("numbered_action_labels", "F30", """
SELECT event_id, CASE CAST(event_id % 15 AS INT) WHEN 0 THEN 'FOLD' WHEN 1 THEN 'CHECK' WHEN 2 THEN 'CALL' WHEN 13 THEN 'ALL_IN' WHEN 14 THEN 'ACTION_14'
  WHEN 3 THEN 'BET_33' WHEN 4 THEN 'BET_75' WHEN 5 THEN 'BET_100' WHEN 6 THEN 'BET_12_5' WHEN 7 THEN 'BET_200'
  WHEN 8 THEN 'RAISE_33' WHEN 9 THEN 'RAISE_75' WHEN 10 THEN 'RAISE_100' WHEN 11 THEN 'RAISE_12_5' ELSE 'RAISE_200' END AS label FROM events
""")
def numbered_action_labels(spark, sf):
    sizes = F.array(*[F.lit(x) for x in (0.33, 0.75, 1.0, 0.125, 2.0)])
    return table(spark, sf, "events").select("event_id", X.action_label(F.col("event_id") % 15, sizes).alias("label"))


@query("card_spellings", "F12", """
SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Th' WHEN 1 THEN 'As' WHEN 2 THEN 'Kd' WHEN 3 THEN 'Qc' WHEN 4 THEN NULL WHEN 5 THEN '9h' WHEN 6 THEN 'Ad' WHEN 7 THEN 'Th' ELSE NULL END AS loose,
  CASE c_custkey % 9 WHEN 2 THEN 'Kd' WHEN 7 THEN 'Th' END AS strict,
  CASE c_custkey % 9 WHEN 0 THEN 'Th' WHEN 2 THEN 'Kd' WHEN 3 THEN 'Qc' WHEN 7 THEN 'Th' END AS history FROM customer
""")
def card_spellings(spark, sf):
    texts = ["10♥", "A spades", "kD", "Q♣", "??", "9â™¥", "one card", "10h", ""]
    c = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("c_custkey") % 9).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", C.parse_card(c).alias("loose"), C.strict_card(c).alias("strict"), C.history_card(c).alias("history"))


@query("card_list_splitting", "F11 F13 P31", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 3 ELSE 1 END AS even_cards, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END AS all_cards,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Ah Kd 7c' WHEN 2 THEN 'Ah Kd 7c 2' ELSE '??x' END AS shown,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PREFLOP' WHEN o_orderkey % 4 IN (1, 2) THEN 'POSTFLOP' ELSE 'UNKNOWN' END AS stage FROM orders
""")
def card_list_splitting(spark, sf):
    c = F.get(F.array(*[F.lit(t) for t in ("", "AhKd7c", "AhKd7c2", "??x")]), (F.col("o_orderkey") % 4).cast("int"))
    even = F.size(C.split_cards(c))
    return table(spark, sf, "orders").select(
        "o_orderkey", even.alias("even_cards"), F.size(C.split_cards(c, keep_tail=True)).alias("all_cards"), C.known_cards(c).alias("shown"),
        N.stage_group(F.lit(None).cast("string"), even.cast("double")).alias("stage"),
    )


def prompt_records(spark, sf):
    """Orders spelled as prompt records."""
    o = F.col("o_orderkey")
    street = F.get(F.array(*[F.lit(s) for s in ("before the flop", "on the flop", "on the turn", "on the river")]), (o % 4).cast("int"))
    prompt = F.concat(
        F.lit("It is "), street, F.lit(". Your position is "), F.when(o % 2 == 0, "SB").otherwise("bb"), F.lit(". The current pot size is "), (o % 500 + 1).cast("string"),
        F.lit(".5 chips, current stack: "), (o % 900 + 100).cast("string"), F.lit(" left.\nHere is a game summary:\nA  checked,\n B bet 20\n Now it is your turn.\nLegal actions: fold, call "),
        (o % 40).cast("string"), F.lit(", raise\nYour EV: -"), (o % 9).cast("string"), F.lit(".25 Your equity: "), (o % 100).cast("string"), F.lit(" %"),
    )
    answer = F.when(o % 5 == 0, "<action>Check</action>").when(o % 5 == 1, "call").when(o % 5 == 2, F.concat(F.lit("raise to "), (o % 70).cast("string"))).when(o % 5 == 3, "Fold").otherwise("hmm")
    null = F.lit(None).cast("string")
    metadata = F.when(o % 3 == 0, F.create_map(F.lit("street"), F.lit("turn"), F.lit("board"), F.lit("AhKd7c2s"), F.lit("to_act"), F.lit("BB"), F.lit("hero_hand"), F.lit("QsQd")))
    return table(spark, sf, "orders", wide=True).select(
        o.alias("_source_row_idx"), F.when(o % 10 == 0, "test").otherwise("").alias("_source_split"), prompt.alias("prompt"), null.alias("instruction"),
        answer.alias("response"), null.alias("output"), null.alias("chosen"), null.alias("rejected"), null.alias("action"), F.col("o_custkey").cast("string").alias("hand_id"),
        null.alias("street"), null.alias("position"), F.lit("9h9c").alias("hole_cards"), F.when(o % 4 == 1, "2c3c4c").alias("board"),
        F.when(o % 2 == 0, F.lit(77.0)).alias("pot"), F.when(o % 5 == 2, F.lit(12.5)).alias("bet_amount"), metadata.alias("metadata"),
    )


PROMPT_CTE = """
WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderkey % 3 = 0 AS meta FROM orders),
p AS (SELECT k, o_custkey, meta, CASE WHEN k % 10 = 0 THEN 'test' ELSE 'train' END AS split,
  ['PREFLOP', 'FLOP', 'TURN', 'TURN'][CAST(k % 4 + 1 AS INT)] AS text_street, CASE WHEN k % 2 = 0 THEN 'SB' ELSE 'BB' END AS text_pos,
  CAST(k % 500 + 1 AS DOUBLE) + 0.5 AS text_pot, CAST(k % 900 + 100 AS DOUBLE) AS stack, -(CAST(k % 9 AS DOUBLE) + 0.25) AS text_ev, CAST(k % 100 AS DOUBLE) AS text_eq,
  'fold, call ' || (k % 40) || ', raise' AS legal, CASE k % 5 WHEN 0 THEN '<action>Check</action>' WHEN 1 THEN 'call' WHEN 2 THEN 'raise to ' || (k % 70) WHEN 3 THEN 'Fold' ELSE 'hmm' END AS raw,
  CASE k % 5 WHEN 0 THEN 'CHECK' WHEN 1 THEN 'CALL' WHEN 2 THEN 'RAISE' WHEN 3 THEN 'FOLD' END AS four,
  CASE k % 5 WHEN 0 THEN 'NO_INVEST' WHEN 1 THEN 'CALL' WHEN 2 THEN 'RAISE' WHEN 3 THEN 'NO_INVEST' END AS intent,
  CASE WHEN k % 5 = 2 THEN CAST(k % 70 AS DOUBLE) END AS size FROM o)
"""
PROMPT_OUT = ("source_row_id", "street", "hero_position", "villain_position", "hero_cards", "board_cards", "pot_size", "effective_stack", "action_history", "legal_actions",
              "raw_action", "normalized_action_4class", "label_3intent", "bet_size", "ev", "equity")


@query("prompt_rows_with_metadata", "P1 P2 F10", PROMPT_CTE + """
SELECT 'cfg:' || split || ':' || k AS source_row_id, CASE WHEN meta THEN 'TURN' ELSE text_street END AS street, CASE WHEN meta THEN 'BB' ELSE text_pos END AS hero_position,
  CASE WHEN (CASE WHEN meta THEN 'BB' ELSE text_pos END) = 'BB' THEN 'SB' ELSE 'BB' END AS villain_position, CASE WHEN meta THEN 'QsQd' ELSE '9h9c' END AS hero_cards,
  CASE WHEN meta THEN 'AhKd7c2s' WHEN k % 4 = 1 THEN '2c3c4c' END AS board_cards, text_pot AS pot_size, stack AS effective_stack, 'A checked, B bet 20' AS action_history, legal AS legal_actions,
  raw AS raw_action, four AS normalized_action_4class, intent AS label_3intent, size AS bet_size, text_ev AS ev, text_eq AS equity FROM p
""")
def prompt_rows_with_metadata(spark, sf):
    rows = N.prompt_rows(prompt_records(spark, sf), "prompts_a", "see terms", "local", config="cfg")
    N.normalized_frame(rows)
    return rows.select(*PROMPT_OUT)


@query("prompt_rows_with_columns", "P1 P3 F10", PROMPT_CTE + """
SELECT split || ':' || k AS source_row_id, text_street AS street, text_pos AS hero_position, CASE WHEN text_pos = 'BB' THEN 'SB' ELSE 'BB' END AS villain_position, '9h9c' AS hero_cards,
  CASE WHEN k % 4 = 1 THEN '2c3c4c' END AS board_cards, CASE WHEN k % 2 = 0 THEN 77.0 ELSE text_pot END::DOUBLE AS pot_size, stack AS effective_stack, 'A checked, B bet 20' AS action_history,
  legal AS legal_actions, raw AS raw_action, four AS normalized_action_4class, intent AS label_3intent, CASE WHEN k % 5 = 2 THEN 12.5::DOUBLE END AS bet_size,
  CAST(NULL AS DOUBLE) AS ev, CAST(NULL AS DOUBLE) AS equity FROM p
""")
def prompt_rows_with_columns(spark, sf):
    rows = N.prompt_rows(prompt_records(spark, sf), "prompts_b", "see terms", "local", from_metadata=False)
    return rows.select(*PROMPT_OUT)


@query("prompt_audit_rows", "P4 F17", PROMPT_CTE + """
SELECT 'cfg:' || split || ':' || k AS source_row_id, raw AS raw_response, CASE WHEN meta THEN 'QsQd' END AS meta_hand, CAST(k AS BIGINT) AS record_row, split = 'test' AS record_test FROM p
""")
def prompt_audit_rows(spark, sf):
    rows = N.audit_rows(N.prompt_rows(prompt_records(spark, sf), "prompts_a", "see terms", "local", config="cfg"))
    return rows.select(
        "source_row_id", "raw_response", F.get_json_object("raw_metadata_json", "$.hero_hand").alias("meta_hand"),
        F.get_json_object("raw_record_json", "$._source_row_idx").cast("bigint").alias("record_row"),
        (F.get_json_object("raw_record_json", "$._source_split") == "test").alias("record_test"),
    )


FEATURE_SQL_TAIL = """
  CASE WHEN meta THEN 4.0 WHEN k % 4 = 1 THEN 3.0 ELSE 0.0 END AS board_cards, CASE WHEN meta THEN 'TURN' ELSE text_street END AS street, intent AS label
FROM p WHERE intent IS NOT NULL
"""


@query("feature_frame_from_prompts", "P6 P7 F6 F7 K5", PROMPT_CTE + """
SELECT 'cfg:' || split || ':' || k AS source_row_id, round(text_pot / 100.0, 8) AS pot_bb, round((k % 40) / 100.0::DOUBLE, 8) AS to_call_bb, round(stack / text_pot, 8) AS stack_to_pot_ratio,
  round((k % 40) / text_pot, 8) AS to_call_pot_ratio, 1.0::DOUBLE AS has_fold, 1.0::DOUBLE AS has_raise, 2.0::DOUBLE AS action_count, 1.0::DOUBLE AS checks, 1.0::DOUBLE AS raises,""" + FEATURE_SQL_TAIL)
def feature_frame_from_prompts(spark, sf):
    rows = N.usable_rows(N.prompt_rows(prompt_records(spark, sf), "prompts_a", "see terms", "local", config="cfg"))
    f = N.feature_frame(rows)
    return _feature_out(f, True)


@query("feature_frame_without_history", "P7", PROMPT_CTE + """
SELECT 'cfg:' || split || ':' || k AS source_row_id, round(text_pot / 100.0, 8) AS pot_bb, 0.0::DOUBLE AS to_call_bb, round(stack / text_pot, 8) AS stack_to_pot_ratio,
  0.0::DOUBLE AS to_call_pot_ratio, 1.0::DOUBLE AS has_fold, 1.0::DOUBLE AS has_raise, 0.0::DOUBLE AS action_count, 0.0::DOUBLE AS checks, 0.0::DOUBLE AS raises,""" + FEATURE_SQL_TAIL)
def feature_frame_without_history(spark, sf):
    rows = N.usable_rows(N.prompt_rows(prompt_records(spark, sf), "prompts_a", "see terms", "local", config="cfg"))
    return _feature_out(N.feature_frame(rows, with_history=False), False)


def _feature_out(f, history):
    c = N.col
    return f.select(
        "source_row_id", F.round(c("features.pot_bb"), 8).alias("pot_bb"), F.round(c("features.to_call_bb"), 8).alias("to_call_bb"),
        F.round(c("features.stack_to_pot_ratio"), 8).alias("stack_to_pot_ratio"), F.round(c("features.to_call_pot_ratio"), 8).alias("to_call_pot_ratio"),
        c("features.has_fold").alias("has_fold"), c("features.has_raise").alias("has_raise"), c("features.action_count").alias("action_count"),
        c("features.prior_check_count").alias("checks"), c("features.prior_bet_raise_count").alias("raises"),
        c("features.board_card_count").alias("board_cards"), c("metadata.street").alias("street"), F.col("label_3intent").alias("label"),
    )


def scenario_source(spark, sf):
    k = F.col("o_orderkey")
    decision = F.when(k % 6 == 0, "check").when(k % 6 == 1, "fold").when(k % 6 == 2, "call").when(k % 6 == 3, "10.0bb").when(k % 6 == 4, "Raise 29").otherwise("muck it")
    pre = k % 2 == 0
    return table(spark, sf, "orders", wide=True).select(
        k.cast("string").alias("row_index"), F.when(pre, "preflop_a.csv").otherwise("postflop_b.csv").alias("source_file"), decision.alias("correct_decision"),
        F.when(k % 3 == 0, "['check', 'bet 10']").otherwise("fold, call, raise 3").alias("available_moves"),
        F.when(pre, F.concat(F.lit("UTG/"), (k % 9).cast("string"), F.lit(".0bb/BTN/call/CHECK"))).alias("prev_line"),
        F.when(~pre, F.concat(F.lit("OOP_CHECK/IP_BET_5/OOP_RAISE_"), (k % 11).cast("string"))).alias("postflop_action"),
        F.when(k % 8 == 0, "0").otherwise((k % 50).cast("string")).alias("pot_size"), F.when(k % 4 == 0, "").otherwise("3").alias("num_players"), F.lit("2").alias("num_bets"),
        F.when(~pre, "Flop").alias("evaluation_at"), F.when(~pre, "KsJh2d").alias("board_flop"), F.when(k % 5 == 0, "nan").when(~pre, "7s").alias("board_turn"),
        F.lit(None).cast("string").alias("board_river"), F.when(k % 7 == 0, F.lit(None)).otherwise("utg").alias("hero_pos"),
    )


@query("scenario_rows", "P8 F4 F6 F7 F8 F9 S6", """
WITH s AS (SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS pre, CASE WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE o_orderkey % 50 END AS pot,
  CASE o_orderkey % 6 WHEN 0 THEN 'CHECK' WHEN 1 THEN 'FOLD' WHEN 2 THEN 'CALL' WHEN 3 THEN 'RAISE' WHEN 4 THEN 'RAISE' END AS label,
  CASE WHEN o_orderkey % 3 = 0 THEN 0.0 WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS DOUBLE) ELSE 1.0 END AS price FROM orders)
SELECT 'scenario:' || CASE WHEN pre THEN 'preflop_a.csv' ELSE 'postflop_b.csv' END || ':' || k AS snapshot_id, label, CASE WHEN pre THEN 'PREFLOP' ELSE 'FLOP' END AS street,
  round(CASE WHEN pot > 0 THEN 100.0::DOUBLE / pot ELSE 0.0 END, 8) AS stack_to_pot_ratio, price::DOUBLE AS to_call,
  (k % 3 = 0)::INT::DOUBLE AS has_check, (k % 3 <> 0)::INT::DOUBLE AS has_call, CASE WHEN k % 4 = 0 THEN 6.0 ELSE 3.0 END::DOUBLE AS num_players,
  (CASE WHEN pre THEN 0 ELSE 3 END + CASE WHEN NOT pre AND k % 5 <> 0 THEN 1 ELSE 0 END)::DOUBLE AS board_cards,
  CASE WHEN pre THEN 2.0 ELSE 3.0 END::DOUBLE AS action_count, CASE WHEN k % 7 = 0 THEN 'UNKNOWN' ELSE 'UTG' END AS hero_position FROM s WHERE label IS NOT NULL
""")
def scenario_rows(spark, sf):
    rows, _ = N.scenario_rows(scenario_source(spark, sf))
    c = N.col
    return rows.select(
        "snapshot_id", F.col("bootstrap_label").alias("label"), c("metadata.street").alias("street"), F.round(c("features.stack_to_pot_ratio"), 8).alias("stack_to_pot_ratio"),
        c("features.to_call_bb").alias("to_call"), c("features.has_check").alias("has_check"), c("features.has_call").alias("has_call"), c("features.num_players").alias("num_players"),
        c("features.board_card_count").alias("board_cards"), c("features.action_count").alias("action_count"), c("features.hero_position").alias("hero_position"),
    )


@query("scenario_unmapped_labels", "P8 A1", "SELECT 'muck it' AS output, count(*) AS rows FROM orders WHERE o_orderkey % 6 = 5")
def scenario_unmapped_labels(spark, sf):
    return N.scenario_rows(scenario_source(spark, sf))[1]


@query("intent_relabel", "P9 P10", """
SELECT CASE o_orderkey % 6 WHEN 2 THEN 'CALL' WHEN 3 THEN 'RAISE' WHEN 4 THEN 'RAISE' ELSE 'NO_INVEST' END AS intent, CASE o_orderkey % 6 WHEN 0 THEN 'CHECK' WHEN 1 THEN 'FOLD' WHEN 2 THEN 'CALL' ELSE 'RAISE' END AS original,
  CASE o_orderkey % 6 WHEN 2 THEN 'CALL' WHEN 3 THEN 'RAISE' WHEN 4 THEN 'RAISE' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'CHECK' ELSE 'FOLD' END END AS played, count(*) AS n FROM orders WHERE o_orderkey % 6 <> 5 GROUP BY ALL
""")
def intent_relabel(spark, sf):
    rows, _ = N.scenario_rows(scenario_source(spark, sf))
    out = N.relabel_intents(rows)
    played = X.action_of_intent(F.col("bootstrap_label"), N.col("features.has_check") > 0)
    return out.groupBy(F.col("bootstrap_label").alias("intent"), N.col("audit.original_label").alias("original"), played.alias("played")).agg(F.count(F.lit(1)).alias("n"))


@query("safe_number_parsing", "F15 F16 F18 P5 P33", """
SELECT event_id, CASE event_id % 8 WHEN 0 THEN value WHEN 1 THEN 15.0 WHEN 6 THEN -0.5 END AS number, CASE event_id % 8 WHEN 0 THEN value WHEN 1 THEN 15.0 WHEN 6 THEN -0.5 WHEN 5 THEN 1.0 END AS with_words,
  CASE event_id % 8 WHEN 7 THEN 42 END::BIGINT AS whole, event_id % 8 IN (2, 3) AS schema_null, event_id % 8 IN (2, 3) AS audit_null, event_id % 8 = 5 AS flag,
  CASE event_id % 8 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN ' 1.5e1 ' WHEN 2 THEN 'fallback' WHEN 3 THEN 'None' WHEN 4 THEN 'inf' WHEN 5 THEN 'Yes' WHEN 6 THEN '-.5' ELSE '42' END AS first_text
FROM (SELECT event_id, value FROM events) WHERE event_id % 8 <> 7
UNION ALL SELECT event_id, 42.0, 42.0, 42, FALSE, FALSE, FALSE, '42' FROM events WHERE event_id % 8 = 7
""")
def safe_number_parsing(spark, sf):
    t = F.expr("CASE event_id % 8 WHEN 0 THEN cast(value as string) WHEN 1 THEN ' 1.5e1 ' WHEN 2 THEN '  ' WHEN 3 THEN 'None' WHEN 4 THEN 'inf' WHEN 5 THEN 'Yes' WHEN 6 THEN '-.5' ELSE '42' END")
    rows = table(spark, sf, "events").select("event_id", t.alias("t"))
    c = F.col("t")
    return rows.select(
        "event_id", V.to_double(c).alias("number"), V.to_double(c, bool_words=True).alias("with_words"), V.to_int(c).alias("whole"), V.is_null_like(c, "schema").alias("schema_null"),
        V.is_null_like(c, "audit").alias("audit_null"), V.to_flag(c).alias("flag"), V.first_text(c, F.lit("fallback")).alias("first_text"),
    )


@query("json_cells", "F17", """
SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 3 + 1 AS listed, '[' || CAST(json_extract(props, '$.k') AS BIGINT) || ',1]' AS encoded FROM events
""")
def json_cells(spark, sf):
    k = F.try_element_at(V.json_map(F.col("props")), F.lit("k"))
    rows = table(spark, sf, "events").select("event_id", k.alias("k"))
    cell = F.concat(F.lit('["'), F.array_join(F.array_repeat(F.lit("x"), (F.col("k").cast("bigint") % 3 + 1).cast("int")), '","'), F.lit('"]'))
    return rows.select("event_id", "k", F.size(V.json_list(cell)).cast("bigint").alias("listed"), V.json_text(F.array(F.col("k").cast("bigint"), F.lit(1).cast("bigint"))).alias("encoded"))


@query("iso_and_epoch_times", "F31", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events
""")
def iso_and_epoch_times(spark, sf):
    return table(spark, sf, "events").select("event_id", V.iso_utc(F.col("ts").cast("timestamp")).alias("iso"), V.epoch_seconds(F.col("ts").cast("timestamp")).alias("seconds"))


@query("big_blind_amounts", "P21 F18", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE (o_orderkey % 4) * 10.0 END::DOUBLE AS big_blind, round(o_totalprice / CASE WHEN o_orderkey % 4 = 0 THEN 1.0 ELSE (o_orderkey % 4) * 10.0 END, 8) AS pot_bb,
  CASE WHEN o_orderkey % 4 = 0 THEN 'big_blind_missing_or_inferred' ELSE 'explicit_big_blind_available' END AS note, CASE WHEN o_orderkey % 4 = 0 THEN 'inferred:unit_is_big_blind' ELSE 'read:bb' END AS rule FROM orders
""")
def big_blind_amounts(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("features.pot"), (F.col("o_orderkey") % 4 * 10).cast("string").alias("bb"))
    out = N.to_big_blinds(rows)
    return out.select(
        "o_orderkey", N.col("features.big_blind").alias("big_blind"), F.round(N.col("features.pot_bb"), 8).alias("pot_bb"), F.col("big_blind_missing_or_inferred").alias("note"),
        N.col("audit.big_blind_inference_rule").alias("rule"),
    )


@query("source_profile_routing", "P48", """
SELECT source, CASE source_type WHEN 'behavioral_hand_history' THEN FALSE ELSE TRUE END AS supervised, source_type, count(*) AS docs FROM (
  SELECT source, CASE WHEN ascii(md5(source)) % 2 = 0 THEN 'behavioral_hand_history' ELSE 'solver_oracle' END AS source_type FROM documents) GROUP BY ALL
""")
def source_profile_routing(spark, sf):
    docs = table(spark, sf, "documents").select("source")
    kind = F.when(F.ascii(F.md5("source")) % 2 == 0, "behavioral_hand_history").otherwise("solver_oracle")
    profiles = docs.distinct().withColumn("source_type", kind)
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return N.attach_profiles(counts, profiles, "source").select("source", "supervised", "source_type", "docs")


@query("event_schema_alignment_row", "K8 U5 P43", """
SELECT event_id, '' AS "metadata.game", event_type AS "features.kind", CAST(value AS VARCHAR) AS "features.value", '' AS bootstrap_label FROM events
""")
def event_schema_alignment_row(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), "value").alias("features"))
    flat = N.flatten_one_level(rows)
    out = N.aligned_columns(flat, ["event_id", "metadata.game", "features.kind"], ["features.kind", "features.value", "bootstrap_label"])
    return out.withColumn("event_id", F.col("event_id").cast("bigint"))
