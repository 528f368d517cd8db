"""Replay of actions that arrive late, interleaved or out of order; hands that end; actions too late to be folded."""

from datetime import datetime, timedelta

from feltmill.session import scratch_path
from feltmill.streaming import intake

SCHEMA = "hand_id long, ts timestamp, event_id long, kind string, code string, player int, amount double"
START = datetime(2024, 1, 1)


def action(hand, minute, event, kind="bet", code="cc", player=1, amount=None):
    return hand, START + timedelta(minutes=minute), event, kind, code, player, amount


def replayed(spark, files, late="30 minutes", idle="1 day"):
    target = scratch_path(spark, "ordered")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{target}/arrived")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{target}/arrived")
    intake.take_once(intake.replay_stream(stream, 3, [1.0, 2.0], 3.0, late, idle), f"{target}/table", f"{target}/checkpoint")
    found = spark.read.parquet(f"{target}/table")
    lost = intake.late_actions(spark.read.parquet(f"{target}/arrived"), found)
    return {r.event_id: (r.segment, r.current_bet, r.to_call, r.pot) for r in found.collect()}, sorted(r.event_id for r in lost.collect())


def test_order_of_arrival_does_not_matter(spark):
    rows = [
        action(1, 0, 1, code="cbr", player=1, amount=6.0), action(1, 1, 2, player=2), action(1, 1, 3, player=3), action(1, 2, 4, "board"),
        action(1, 3, 5, code="cbr", player=2, amount=10.0), action(1, 4, 6, code="f", player=3), action(2, 2, 7, player=3), action(2, 9, 8, code="cbr", player=1, amount=4.0),
    ]
    end = [action(-1, 300, -1, "other")]
    straight, none = replayed(spark, [rows, end])
    assert none == [] and straight[1] == (0, 2.0, 1.0, 3.0) and straight[5][0] == 1 and len(straight) == 7
    mixed, none = replayed(spark, [[rows[k] for k in part] for part in ([5, 0, 7], [3, 1], [6, 4, 2])] + [end])
    assert (mixed, none) == (straight, [])


def test_actions_behind_the_watermark_are_counted_not_folded(spark):
    files = [
        [action(1, 20, 1)], [action(-1, 100, -1, "other")], [action(-1, 101, -2, "other")], [action(1, 10, 3, code="cbr", player=2, amount=50.0)],
        [action(1, 30, 4, player=3), action(1, 200, 2)], [action(-1, 300, -3, "other")],
    ]
    found, lost = replayed(spark, files)
    assert lost == [3, 4] and set(found) == {1, 2} and found[2][1] == 2.0


def test_a_hand_ends_after_its_pause(spark):
    files = [[action(1, 0, 1, code="cbr", player=1, amount=20.0)], [action(-1, 200, -1, "other")], [action(-1, 400, -2, "other")], [action(1, 390, 2, player=2)], [action(-1, 900, -3, "other")]]
    kept, _ = replayed(spark, files, idle="1 day")
    assert kept[2][1] == 20.0
    ended, _ = replayed(spark, files, idle="1 hour")
    assert ended[2][1] == 2.0
