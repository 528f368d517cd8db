"""The events table as a stream; every job ends when the table has been taken."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ...registry import query, table
from ...session import scratch_path
from ...streaming import intake as S
from .replay import EVENT_SQL


def event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


STATUS = "CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'timeout' ELSE 'failed' END"


def _status():
    return F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "timeout").otherwise("failed")


@query("stream_run_intake", "T1 K12", f"SELECT event_id, event_type AS profile, {STATUS} AS status, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def stream_run_intake(spark, sf):
    records = event_stream(spark, sf).select("event_id", F.col("event_type").alias("profile"), _status().alias("status"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    target = scratch_path(spark, "intake")
    S.take_once(records, f"{target}/table", f"{target}/checkpoint")
    return spark.read.parquet(f"{target}/table")


@query("stream_status_windows", "T2 A5", f"""
SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS profile, count(*) AS total, count(*) FILTER ({STATUS} = 'ok') AS solved, count(*) FILTER ({STATUS} = 'timeout') AS timeouts FROM events GROUP BY 1, 2
""")
def stream_status_windows(spark, sf):
    records = event_stream(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("profile"), _status().alias("status"))
    target = scratch_path(spark, "windows")
    S.keep_latest(S.status_windows(records, "ts", ["profile"], "1 day", "60 days"), f"{target}/table", f"{target}/checkpoint", ["window_start", "profile"])
    rows = S.latest(spark, f"{target}/table", ["window_start", "profile"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


LINE = "'{\"event_id\":' || event_id || ',\"profile\":\"' || event_type || '\"'"


@query("stream_log_lines", "T1 S2", f"""
SELECT 'record' AS part, event_id, event_type AS profile, {STATUS} AS status, value, NULL AS line FROM events WHERE event_id % 97 <> 0
UNION ALL SELECT 'broken', NULL, NULL, NULL, NULL, substr({LINE}, 1, 24) FROM events WHERE event_id % 97 = 0
""")
def stream_log_lines(spark, sf):
    """JSON lines in three deliveries, some cut off on the way: records are typed, cut lines stand apart as they came."""
    records = table(spark, sf, "events").select("event_id", F.col("event_type").alias("profile"), _status().alias("status"), "value")
    line = F.to_json(F.struct("*"))
    target = scratch_path(spark, "lines")
    for number in range(3):
        cut = F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 24)).otherwise(line)
        records.filter(F.col("event_id") % 3 == number).select(cut.alias("value")).write.text(f"{target}/in/part={number}")
        stream = S.run_log_stream(spark, f"{target}/in", records.schema)
        S.take_lines(stream.drop("part"), f"{target}/table", f"{target}/checkpoint")
    good, broken = S.taken(spark, f"{target}/table", records.schema)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in records.schema]
    good = good.select(F.lit("record").alias("part"), *records.columns, F.lit(None).cast("string").alias("line"))
    return good.unionByName(broken.select(F.lit("broken").alias("part"), *empty, "line"))


DELIVERED = """
WITH e AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
d AS (SELECT events.*, least(2, CAST(floor((epoch_us(ts) - epoch_us(a)) * 3 / greatest(1, epoch_us(b) - epoch_us(a))) AS INT)) AS third FROM events, e),
p AS (SELECT *, CASE WHEN third = 0 AND event_id % 11 = 0 THEN 2 WHEN third = 0 AND event_id % 11 = 1 THEN 1 ELSE third END AS part FROM d),
m AS (SELECT k.part, max(q.ts) - INTERVAL '2 days' AS mark FROM (SELECT DISTINCT part FROM p) k LEFT JOIN p q ON q.part < k.part GROUP BY 1)
"""


@query("stream_windows_late_rows", "T2 A5", DELIVERED + f"""
SELECT strftime(time_bucket(INTERVAL '1 day', ts), '%Y-%m-%d %H:%M') AS window_start, event_type AS profile, coalesce(time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' <= mark, FALSE) AS late,
  count(*) AS total, count(*) FILTER ({STATUS} = 'ok') AS solved, count(*) FILTER ({STATUS} = 'timeout') AS timeouts FROM p JOIN m USING (part) GROUP BY 1, 2, 3
""")
def stream_windows_late_rows(spark, sf):
    """The events come in three deliveries by time; some of the first third come with the second or the last one, most of them late."""
    events = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("profile"), _status().alias("status"))
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    us = lambda t: F.unix_micros(F.lit(t))
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - us(first)) * 3 / F.greatest(F.lit(1), us(last) - us(first))).cast("int"))
    part = F.when((third == 0) & (F.col("event_id") % 11 == 0), 2).when((third == 0) & (F.col("event_id") % 11 == 1), 1).otherwise(third)
    target = scratch_path(spark, "late-windows")
    for number in range(3):
        events.filter(part == number).write.parquet(f"{target}/in/part={number}")
        stream = spark.readStream.schema(events.schema).parquet(f"{target}/in")
        S.count_windows(stream.drop("part"), "ts", ["profile"], f"{target}/table", f"{target}/checkpoint", "1 day", "2 days", fan=2)
    rows = S.window_counts(spark, f"{target}/table", ["profile"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@query("stream_upsert", "T3 K9 J5", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    target = scratch_path(spark, "upsert")
    S.upsert_stream(event_stream(spark, sf).select("user_id", "event_id", "value"), f"{target}/table", f"{target}/checkpoint", "user_id", "event_id")
    return S.latest(spark, f"{target}/table", ["user_id"], "event_id").select("user_id", "event_id", "value")


def actions_of(events):
    kind = F.when(F.col("event_type") == "view", "board").when(F.col("event_type") == "signup", "other").otherwise("bet")
    code = F.when(F.col("event_type") == "click", "cc").when(F.col("event_type") == "purchase", "cbr").when(F.col("event_type") == "error", "f")
    return events.select(
        F.col("user_id").alias("hand_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), code.alias("code"), (F.col("event_id") % 3 + 1).cast("int").alias("player"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"),
    )


@query("stream_hand_replay", "T4 W2", EVENT_SQL)
def stream_hand_replay(spark, sf):
    """The events come in three deliveries by time, every tenth one delivery late; a last action of no hand moves the watermark on."""
    actions = actions_of(table(spark, sf, "events"))
    first, last = actions.agg(F.min("ts"), F.max("ts")).first()
    third = F.least(F.lit(2), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 3 / F.greatest(F.lit(1), F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)))).cast("int"))
    part = F.least(F.lit(2), third + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    target = scratch_path(spark, "replay")
    late = (last - first) * 2 / 3 + timedelta(seconds=1)
    for number in range(3):
        actions.filter(part == number).write.mode("append").parquet(f"{target}/arrived")
    beat = spark.createDataFrame([(last + 2 * late,)], "ts timestamp").select(F.lit(-1).cast("bigint").alias("hand_id"), "ts", F.lit(-1).cast("bigint").alias("event_id"), F.lit("other").alias("kind"), F.lit(None).cast("string").alias("code"), F.lit(1).alias("player"), F.lit(None).cast("double").alias("amount"))
    beat.write.mode("append").parquet(f"{target}/arrived")
    stream = spark.readStream.schema(actions.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}/arrived")
    S.take_once(S.replay_stream(stream, 3, [1.0, 2.0], 3.0, f"{int(late.total_seconds())} seconds", "3650 days"), f"{target}/table", f"{target}/checkpoint")
    rows = spark.read.parquet(f"{target}/table")
    return rows.select("event_id", "segment", *[F.round(c, 4).alias(c) for c in ("current_bet", "to_call", "pot")])
