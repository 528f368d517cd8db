"""Replays: one order is one hand; the events of a user are one endless hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.keys import seeded_digest
from ...functions.values import half_even
from ...operators import equity as E
from ...operators import replay as R
from ...registry import query, table
from ...session import stored
from .sqlcards import DECK_CTE, deal_cte

#: The player whose decisions the text histories follow.
HERO = "wren"


# ---- hand records ---------------------------------------------------------------------------


def record_hands(spark, sf):
    """Orders as two-player hand records; the digest of the key decides the actions."""
    orders = E.spread(table(spark, sf, "orders").select(F.col("o_orderkey").alias("hand_id"), "o_totalprice"), ["hand_id"])
    digest = orders.withColumn("dg", seeded_digest(17, F.col("hand_id")))

    def act(i):
        d = (F.instr(F.lit("0123456789abcdef"), F.substr("dg", i + 1, F.lit(1))) - 1)
        seat = F.concat(F.lit("p"), (F.lit(1) + i % 2).cast("string"))
        raised = ((i + 1) * 20 + d).cast("string")
        return (
            F.when(d <= 2, F.concat(seat, F.lit(" cc")))
            .when(d <= 6, F.concat(seat, F.lit(" cbr "), raised))
            .when(d == 7, F.concat(seat, F.lit(" f")))
            .when(d == 8, F.concat(seat, F.lit(" cbr")))
            .when(d <= 10, F.when(i < 5, F.lit("d db AcKd7s")).otherwise(F.lit("d db 2h")))
            .otherwise(F.lit("p1 sm"))
        )

    return digest.select(
        "hand_id",
        F.concat(F.array(F.lit("d dh p1 AhKd"), F.lit("d dh p2 ????")), F.transform(F.sequence(F.lit(0), F.lit(13)), act)).alias("actions"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("blinds"),
        F.array(F.lit(0.5), F.lit(0.5)).alias("antes"),
        F.array(F.col("o_totalprice"), F.lit(200.0)).alias("stacks"),
        F.array(F.lit("a"), F.lit("b")).alias("players"),
    )


RECORD_CTE = """
WITH RECURSIVE dg AS (SELECT o_orderkey AS hand_id, o_totalprice, sha256('17:' || o_orderkey) AS dg FROM orders),
a0 AS (SELECT hand_id, o_totalprice, i, instr('0123456789abcdef', substr(dg, CAST(i + 1 AS INT), 1)) - 1 AS d FROM dg CROSS JOIN (SELECT unnest(range(14)) AS i)),
acts AS (SELECT hand_id, o_totalprice, i, 1 + i % 2 AS p,
           CASE WHEN d <= 2 THEN 'cc' WHEN d <= 6 THEN 'cbr' WHEN d = 7 THEN 'f' WHEN d = 8 THEN 'cbr' WHEN d <= 10 THEN 'db' ELSE 'sm' END AS kind,
           CASE WHEN d BETWEEN 3 AND 6 THEN CAST((i + 1) * 20 + d AS DOUBLE) END AS amount,
           CASE WHEN d <= 2 THEN 'p' || (1 + i % 2) || ' cc' WHEN d <= 6 THEN 'p' || (1 + i % 2) || ' cbr ' || ((i + 1) * 20 + d)
                WHEN d = 7 THEN 'p' || (1 + i % 2) || ' f' WHEN d = 8 THEN 'p' || (1 + i % 2) || ' cbr'
                WHEN d <= 10 THEN CASE WHEN i < 5 THEN 'd db AcKd7s' ELSE 'd db 2h' END ELSE 'p1 sm' END AS txt FROM a0),
walk AS (
  SELECT hand_id, -1::BIGINT AS i, 4.0::DOUBLE AS pot, 2.0::DOUBLE AS cur, 1.0::DOUBLE AS c1, 2.0::DOUBLE AS c2, 0::BIGINT AS boards,
         4.0::DOUBLE AS pot0, 2.0::DOUBLE AS cur0, 1.0::DOUBLE AS mine0, 0::BIGINT AS boards0, 'd dh p1 AhKd | d dh p2 ????' AS hist, '' AS hist0 FROM dg
  UNION ALL
  SELECT w.hand_id, w.i + 1,
    w.pot + CASE WHEN a.kind IN ('cc', 'cbr') THEN greatest(0.0, CASE WHEN a.kind = 'cc' THEN w.cur ELSE coalesce(a.amount, w.cur) END - CASE WHEN a.p = 1 THEN w.c1 ELSE w.c2 END) ELSE 0 END,
    CASE WHEN a.kind = 'db' THEN 0.0 WHEN a.kind = 'cbr' THEN greatest(w.cur, coalesce(a.amount, w.cur)) ELSE w.cur END,
    CASE WHEN a.kind = 'db' THEN 0.0 WHEN a.p = 1 AND a.kind = 'cc' THEN greatest(w.cur, w.c1) WHEN a.p = 1 AND a.kind = 'cbr' THEN greatest(coalesce(a.amount, w.cur), w.c1) ELSE w.c1 END,
    CASE WHEN a.kind = 'db' THEN 0.0 WHEN a.p = 2 AND a.kind = 'cc' THEN greatest(w.cur, w.c2) WHEN a.p = 2 AND a.kind = 'cbr' THEN greatest(coalesce(a.amount, w.cur), w.c2) ELSE w.c2 END,
    w.boards + CASE WHEN a.kind = 'db' THEN CASE WHEN a.i < 5 THEN 3 ELSE 1 END ELSE 0 END,
    w.pot, w.cur, CASE WHEN a.p = 1 THEN w.c1 ELSE w.c2 END, w.boards, w.hist || ' | ' || a.txt, w.hist
  FROM walk w JOIN acts a ON a.hand_id = w.hand_id AND a.i = w.i + 1)
"""


@query("record_replay_decisions", "W1 X6 F11 F13 F14", RECORD_CTE + """
SELECT w.hand_id, CAST(w.i + 2 AS INT) AS action_index, round(w.pot0, 6) AS pot_size, round(greatest(0.0, w.cur0 - w.mine0), 6) AS to_call,
       CASE WHEN w.boards0 >= 5 THEN 'RIVER' WHEN w.boards0 = 4 THEN 'TURN' WHEN w.boards0 >= 3 THEN 'FLOP' ELSE 'PREFLOP' END AS street,
       CASE WHEN a.p = 1 THEN 'SB' ELSE 'BB' END AS hero_position, CASE WHEN a.p = 1 THEN 'Ah Kd' ELSE '????' END AS hero_cards,
       CASE a.kind WHEN 'f' THEN 'FOLD' WHEN 'cbr' THEN 'RAISE' ELSE CASE WHEN w.cur0 - w.mine0 > 0 THEN 'CALL' ELSE 'CHECK' END END AS action_class,
       CASE WHEN w.cur0 - w.mine0 > 0 THEN 'fold, call ' || CAST(w.cur0 - w.mine0 AS BIGINT) || ', raise' ELSE 'check, bet' END AS legal_actions,
       CASE WHEN a.p = 1 THEN a.o_totalprice ELSE 200.0 END AS effective_stack, a.amount AS bet_size, w.hist0 AS action_history
FROM walk w JOIN acts a ON a.hand_id = w.hand_id AND a.i = w.i WHERE a.kind IN ('cc', 'cbr', 'f')
""")
def record_replay_decisions(spark, sf):
    rows = R.record_decisions(record_hands(spark, sf))
    return rows.select(
        "hand_id", "action_index", half_even(F.col("pot_size"), 6).alias("pot_size"), half_even(F.col("to_call"), 6).alias("to_call"), "street",
        "hero_position", "hero_cards", F.col("normalized_action_4class").alias("action_class"), "legal_actions", "effective_stack", "bet_size", "action_history",
    )


EVENT_SQL = """
WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'board' WHEN 'signup' THEN 'other' ELSE 'bet' END AS kind,
   CASE event_type WHEN 'click' THEN 'cc' WHEN 'purchase' THEN 'cbr' WHEN 'error' THEN 'f' END AS code, event_id % 3 + 1 AS player,
   CASE WHEN event_type = 'purchase' THEN value END AS amount FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN kind = 'board' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM e),
b AS (SELECT *, greatest(CASE WHEN segment = 0 THEN 2.0 ELSE 0.0 END, coalesce(max(amount) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS current_bet FROM s),
l AS (SELECT *, CASE code WHEN 'cc' THEN current_bet WHEN 'cbr' THEN amount END AS lev FROM b),
c AS (SELECT *, greatest(CASE WHEN segment = 0 AND player <= 2 THEN player * 1.0 ELSE 0.0 END,
        coalesce(max(lev) OVER (PARTITION BY user_id, segment, player ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS contribution FROM l),
p AS (SELECT *, 3.0 + coalesce(sum(coalesce(greatest(0.0, lev - contribution), 0.0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS pot FROM c)
SELECT event_id, segment, round(CAST(current_bet AS DOUBLE), 4) AS current_bet, round(CAST(greatest(0.0, current_bet - contribution) AS DOUBLE), 4) AS to_call, round(CAST(pot AS DOUBLE), 4) AS pot
FROM p WHERE kind = 'bet'
"""


def event_actions(spark, sf):
    kind = F.when(F.col("event_type") == "view", "board").when(F.col("event_type") == "signup", "other").otherwise("bet")
    code = F.when(F.col("event_type") == "click", "cc").when(F.col("event_type") == "purchase", "cbr").when(F.col("event_type") == "error", "f")
    player = (F.col("event_id") % 3 + 1).cast("int")
    return table(spark, sf, "events").select(
        "user_id", "ts", "event_id", kind.alias("kind"), code.alias("code"), player.alias("player"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
        F.when(player <= 2, player.cast("double")).otherwise(0.0).alias("blind"), F.lit(2.0).alias("max_blind"), F.lit(3.0).alias("start_pot"),
    )


@query("event_bet_replay", "W1 W3", EVENT_SQL)
def event_bet_replay(spark, sf):
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    rows = R.replay_bets(event_actions(spark, sf), ["user_id"], ["ts", "event_id"], slice_of=day).filter("kind = 'bet'")
    return rows.select(
        "event_id", F.col("segment").cast("bigint").alias("segment"),
        *[F.round(F.col(c), 4).alias(c) for c in ("current_bet", "to_call", "pot")],
    )


# ---- text histories -------------------------------------------------------------------------


def history_texts(spark, sf):
    """Orders as text hands. Status decides the outcome: F a showdown, O none, P a third player or a side pot."""
    spots = E.dealt(E.spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"]), F.concat(F.lit("17:"), F.col("o_orderkey").cast("string")))
    cards = {n: F.array_join(n, ",") for n in ("hero", "villain")}
    flop = F.array_join(F.slice("board", 1, 3), ", ")
    bet = (F.col("o_orderkey") % 5 * 20 + 20).cast("string")
    third = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)
    side = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 1)
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("## Game: "), F.col("o_custkey").cast("string"), F.lit(" | Hand: "), F.col("o_orderkey").cast("string"), F.lit(" ##")),
            F.lit("wren posts small blind ($160)"), F.lit("Player 3 posts big blind ($320)"),
            F.when(third, F.lit("Player 4 calls $320.")),
            F.when(F.col("o_orderstatus") == "O", F.lit("wren folds.")).otherwise(F.lit("wren calls $160.")),
            F.when(F.col("o_orderstatus") != "O", F.lit("Player 3 checks.")),
            F.concat(F.lit("*** FLOP *** ["), flop, F.lit("]")),
            F.concat(F.lit("wren bets $"), bet, F.lit(".")),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Player 3 raises $"), (F.col("o_orderkey") % 7 * 30 + 10).cast("string"), F.lit("."))).otherwise(
                F.concat(F.lit("Player 3 calls $"), bet, F.lit("."))),
            F.concat(F.lit("*** TURN *** ["), F.get("board", F.lit(3)), F.lit("]")),
            F.lit("wren checks."), F.when(F.col("o_orderkey") % 4 == 0, F.lit("Player 3 bets $50")).otherwise(F.lit("Player 3 checks.")),
            F.concat(F.lit("*** RIVER *** ["), F.get("board", F.lit(4)), F.lit("]")),
            F.lit("wren checks."),
            F.when(side, F.lit("Dealer: side pot created")),
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("wren shows ["), cards["hero"], F.lit("]"))),
            F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("Player 3 shows ["), cards["villain"], F.lit("]"))),
            F.when(third, F.lit("Player 4 shows [2c,2d]")),
            F.lit("wren wins $1,920."),
        )
    )
    return spots.select("o_orderkey", F.array_join(lines, "\n").alias("text"))


HISTORY_CTE = f"""
{DECK_CTE}, {deal_cte('orders', 'o_orderkey')},
src AS (SELECT o.*, d, o_orderkey % 5 * 20 + 20 AS bet, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 * 30 + 10 END AS raised,
          CASE WHEN o_orderkey % 4 = 0 THEN 50 ELSE 0 END AS stab,
          o_orderstatus = 'P' AND o_orderkey % 2 = 0 AS third, o_orderstatus = 'P' AND o_orderkey % 2 = 1 AS side
        FROM orders o JOIN dealt USING (o_orderkey)),
parsed AS (SELECT *, CASE WHEN side THEN 'side_pot_not_supported' WHEN o_orderstatus = 'O' THEN 'showdown_missing' WHEN third THEN 'multiway_not_supported' END AS reason,
          CAST(480 + CASE WHEN third THEN 320 ELSE 0 END + CASE WHEN o_orderstatus <> 'O' THEN 160 ELSE 0 END + bet + coalesce(raised, bet) + stab AS DOUBLE) AS pot FROM src)
"""


@query("text_hand_parse", "W3 S11", "WITH " + HISTORY_CTE + """
SELECT o_orderkey AS hand_id, o_custkey AS game_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason AS rejection_reason,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE d[1] || ' ' || d[2] END AS hero_hand,
       CASE WHEN o_orderstatus = 'O' THEN NULL ELSE d[3] || ' ' || d[4] END AS villain_hand,
       d[5] || ' ' || d[6] || ' ' || d[7] || ' ' || d[8] || ' ' || d[9] AS board, pot AS pot_final,
       CAST(CASE WHEN o_orderstatus = 'O' THEN 9 ELSE 12 END + CASE WHEN third THEN 2 ELSE 0 END AS INT) AS actions, 1920.0::DOUBLE AS won FROM parsed
""")
def text_hand_parse(spark, sf):
    hands = R.parse_text_hands(history_texts(spark, sf), ["o_orderkey"], HERO)
    return hands.select(
        "hand_id", "game_id", "status", "rejection_reason",
        F.array_join("hero_hand", " ").alias("hero_hand"), F.array_join("villain_hand", " ").alias("villain_hand"),
        F.array_join(R.board_for(F.col("board"), F.lit("RIVER")), " ").alias("board"), "pot_final", F.size("actions").alias("actions"), "won",
    )


HERO_CTE = """
acts AS (
  SELECT o_orderkey, unnest(generate_series(1, 9)) AS i, bet, raised, stab FROM parsed WHERE o_orderstatus = 'F'),
a AS (
  SELECT o_orderkey, i, CASE WHEN i <= 4 THEN 'PREFLOP' WHEN i <= 6 THEN 'FLOP' WHEN i <= 8 THEN 'TURN' ELSE 'RIVER' END AS street,
    CASE WHEN i IN (1, 3, 5, 7, 9) THEN 1 ELSE 2 END AS p,
    CASE i WHEN 1 THEN 'post' WHEN 2 THEN 'post' WHEN 3 THEN 'calls' WHEN 4 THEN 'checks' WHEN 5 THEN 'bets'
           WHEN 6 THEN CASE WHEN raised IS NOT NULL THEN 'raises' ELSE 'calls' END WHEN 7 THEN 'checks'
           WHEN 8 THEN CASE WHEN stab > 0 THEN 'bets' ELSE 'checks' END ELSE 'checks' END AS act,
    CAST(CASE i WHEN 1 THEN 160 WHEN 2 THEN 320 WHEN 3 THEN 160 WHEN 5 THEN bet WHEN 6 THEN coalesce(raised, bet) WHEN 8 THEN stab END AS DOUBLE) AS amount FROM acts),
w AS (
  SELECT o_orderkey, 0::BIGINT AS i, 0.0::DOUBLE AS pot, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 'PREFLOP' AS street, NULL::VARCHAR AS err FROM parsed WHERE o_orderstatus = 'F'
  UNION ALL
  SELECT w.o_orderkey, a.i,
    w.pot + CASE WHEN e IS NOT NULL THEN 0 ELSE lev - own END,
    CASE WHEN a.p = 1 AND e IS NULL THEN lev ELSE m1 END, CASE WHEN a.p = 2 AND e IS NULL THEN lev ELSE m2 END, a.street, e
  FROM w JOIN a ON a.o_orderkey = w.o_orderkey AND a.i = w.i + 1 AND w.err IS NULL,
  LATERAL (SELECT CASE WHEN a.street <> w.street THEN 0.0 ELSE w.c1 END AS m1, CASE WHEN a.street <> w.street THEN 0.0 ELSE w.c2 END AS m2) x,
  LATERAL (SELECT CASE WHEN a.p = 1 THEN m1 ELSE m2 END AS own, greatest(m1, m2) AS top) y,
  LATERAL (SELECT CASE WHEN a.act = 'checks' AND top <> own THEN 'pot_reconstruction_failed'
                       WHEN a.act = 'calls' AND a.amount < top - own THEN 'all_in_complex_not_supported'
                       WHEN a.act = 'calls' AND a.amount > top - own THEN 'pot_reconstruction_failed'
                       WHEN (a.act = 'raises' OR (a.act = 'bets' AND top <> own)) AND a.amount <= top THEN 'pot_reconstruction_failed' END AS e,
                  CASE WHEN a.act IN ('post', 'calls') OR (a.act = 'bets' AND top = own) THEN own + a.amount
                       WHEN a.act IN ('raises', 'bets') THEN a.amount ELSE own END AS lev) z),
ends AS (SELECT o_orderkey, arg_max(pot, i) AS pot, max(err) AS err, max(i) AS steps FROM w GROUP BY 1)
"""


@query("hero_action_replay", "W2", "WITH RECURSIVE " + HISTORY_CTE + ", " + HERO_CTE + """
SELECT o_orderkey AS hand_id, CASE WHEN err IS NULL THEN 'ok' ELSE 'failed' END AS replay_status, err AS replay_reason,
       CASE WHEN err IS NULL THEN pot END AS pot_reconstructed,
       CAST((steps >= 3)::INT + (steps >= 5)::INT + (steps >= 7)::INT + (steps >= 9)::INT AS INT) AS contexts,
       CASE WHEN err IS NULL THEN 3 ELSE 0 END AS snapshots FROM ends
""")
def hero_action_replay(spark, sf):
    hands = R.replay_hero(R.parse_text_hands(history_texts(spark, sf), ["o_orderkey"], HERO).filter("status = 'ok'"), HERO)
    return hands.select(
        "hand_id", "replay_status", "replay_reason", "pot_reconstructed", F.size("contexts").alias("contexts"), F.size("snapshots").alias("snapshots")
    )


@query("hand_snapshot_rows", "P25", "WITH " + HISTORY_CTE + """
SELECT o_orderkey AS hand_id, o_custkey AS game_id,
  CASE WHEN r IS NULL THEN 'ok' ELSE 'failed' END AS status, r AS rejection_reason,
  CASE WHEN r IS NULL THEN 'game' || o_custkey || '_hand' || o_orderkey || '_turn' END AS snapshot_id,
  d[5] || ' ' || d[6] || ' ' || d[7] || ' ' || d[8] AS board, pot
FROM (SELECT *, CASE WHEN side THEN 'side_pot_not_supported' WHEN o_orderstatus = 'O' THEN 'hero_hand_missing' WHEN third THEN 'multiway_context_not_supported' END AS r FROM parsed)
""")
def hand_snapshot_rows(spark, sf):
    shots = R.hand_snapshots(R.parse_text_hands(history_texts(spark, sf), ["o_orderkey"], HERO), "TURN", F.lit(0.0))
    return shots.select("hand_id", "game_id", "status", "rejection_reason", "snapshot_id", F.array_join("board_cards", " ").alias("board"), "pot")


@query("stage_ledger_counts", "U7 A10", "WITH " + HISTORY_CTE + """
, led AS (SELECT 'parse' AS stage, 'failed' AS status FROM parsed WHERE reason IS NOT NULL
          UNION ALL SELECT 'snapshot', 'ok' FROM parsed WHERE reason IS NULL)
SELECT stage, count(*) AS rows, count(*) FILTER (status = 'ok') AS ok_rows, count(*) FILTER (status <> 'ok') AS failed_rows,
       CASE WHEN count(*) FILTER (status = 'ok') = 0 THEN 'failed' WHEN count(*) FILTER (status <> 'ok') > 0 THEN 'partial' ELSE 'ok' END AS status
FROM led GROUP BY stage
""")
def stage_ledger_counts(spark, sf):
    # Stored, or both parts of the ledger deal and parse every hand.
    hands = stored(R.parse_text_hands(history_texts(spark, sf), ["o_orderkey"], HERO).drop("actions", "players"), "hands")
    shots = R.hand_snapshots(hands.filter("status = 'ok'"), "RIVER", F.lit(0.0))
    return R.ledger_summary(R.stage_ledger(hands, shots))
