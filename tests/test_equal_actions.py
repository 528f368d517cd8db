"""Replay of actions that the order leaves equal, or that share a millisecond."""

from collections import Counter
from datetime import timedelta

from pyspark.sql import functions as F

from feltmill.operators import replay as R
from feltmill.streaming.intake import _Table
from test_ordered_stream import action, replayed

SCHEMA = "hand_id long, at int, event_id long, kind string, code string, player int, amount double"


def test_equal_actions_are_taken_in_one_order_by_all_steps(spark):
    hands, steps, copies = 60, 12, 6
    rows = []
    for hand in range(hands):
        for at in range(steps):
            kind, code = ("board", None) if at == 6 else ("bet", ("cc", "cbr")[(hand + at) % 2])
            rows += [(hand, at, at, kind, code, (hand + at) % 3 + 1, 10.0 * at + hand if code == "cbr" else None)] * copies
    wanted = Counter()
    for hand in range(hands):
        state = _Table(0, 2.0, 3.0, [1.0, 2.0, 0.0])
        for _, at, event, kind, code, player, amount in (r for r in rows if r[0] == hand):
            row = state.take(hand, event, kind, code, player, amount)
            if row:
                wanted[tuple(round(x, 4) for x in row)] += 1
    actions = spark.createDataFrame(rows, SCHEMA).repartition(8, F.rand(3)).withColumns({
        "blind": F.when(F.col("player") <= 2, F.col("player").cast("double")).otherwise(0.0), "max_blind": F.lit(2.0), "start_pot": F.lit(3.0),
    })
    found = R.replay_bets(actions, ["hand_id"], ["at", "event_id"], slice_of=F.floor(F.col("at") / 3)).filter("kind = 'bet'")
    given = Counter(tuple(round(x, 4) for x in r) for r in found.select("hand_id", "event_id", "segment", "current_bet", "to_call", "pot").collect())
    assert given == wanted


def test_actions_of_one_millisecond_keep_their_microseconds(spark):
    first, second = (list(action(1, 5, event, **more)) for event, more in ((9, {"code": "cbr", "player": 1, "amount": 30.0}), (2, {"player": 3})))
    first[1] += timedelta(microseconds=100)
    second[1] += timedelta(microseconds=700)
    found, lost = replayed(spark, [[tuple(second), tuple(first)], [action(-1, 300, -1, "other")]])
    assert lost == [] and found[9][1] == 2.0 and found[2][1] == 30.0
