"""Inputs on which rows are easily lost: ties, missing labels, bad tokens, odd headers, late batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import library as L
from ...operators import ranges as R
from ...operators import splits as M
from ...registry import query, table
from ...session import scratch_path
from ...sources import files as I
from ...streaming import intake as S

BAD_TOKENS = {
    "XX": "invalid_ranks", "AKq": "invalid_suit_mark", "AKs-QTs": "unequal_gaps", "AAs": "pair_with_suit_mark", "AhAh": "duplicate_card",
    "77-AK": "pair_and_non_pair", "AKs-QJo": "unequal_suit_marks", "A": "invalid_hand_token",
}
TOKENS = [*BAD_TOKENS, "AKs", "22+", "KQs-JTs"]


@query("range_token_errors", "F24", f"""
WITH t AS (SELECT p_partkey, {TOKENS!r}[CAST(p_partkey % {len(TOKENS)} + 1 AS INT)] AS token FROM part)
SELECT p_partkey, token, CASE token {' '.join(f"WHEN '{t}' THEN '{e}'" for t, e in BAD_TOKENS.items())} END AS error
FROM t WHERE token IN {tuple(BAD_TOKENS)!r}
""")
def range_token_errors(spark, sf):
    token = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("p_partkey") % len(TOKENS) + 1).cast("int"))
    texts = table(spark, sf, "part", wide=True).select("p_partkey", F.concat(F.lit("QQ, "), token, F.lit(" ,AJo")).alias("text"))
    return R.range_errors(texts, "p_partkey", "text").select("p_partkey", "token", "error")


@query("insert_only_tied_rows", "K9", """
WITH i AS (SELECT CASE WHEN c_nationkey % 7 <> 0 THEN c_nationkey END AS spot_id, c_custkey // 40 AS created_at, c_name AS name FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY spot_id ORDER BY created_at, name) AS n FROM i)
SELECT CASE WHEN n = 1 AND spot_id IS DISTINCT FROM 3 THEN 'table' ELSE 'rejected' END AS part, spot_id, created_at, name FROM r
UNION ALL SELECT 'table', 3, 0, 'there'
""")
def insert_only_tied_rows(spark, sf):
    key = F.when(F.col("c_nationkey") % 7 != 0, F.col("c_nationkey").cast("long"))
    incoming = table(spark, sf, "customer").select(key.alias("spot_id"), F.floor(F.col("c_custkey") / 40).alias("created_at"), F.col("c_name").alias("name"))
    kept, rejected = L.insert_only(spark.createDataFrame([(3, 0, "there")], incoming.schema), incoming)
    return kept.withColumn("part", F.lit("table")).unionByName(rejected.drop("error").withColumn("part", F.lit("rejected")))


@query("splits_of_missing_labels", "M1 M2 M3 M4", """
WITH o AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS label FROM orders), n AS (SELECT label, count(*) AS n FROM o GROUP BY 1)
SELECT m.method, label, CASE m.method WHEN 'half' THEN greatest(1, CAST(round_even(n * 0.5, 0) AS BIGINT)) ELSE n END AS n
FROM n CROSS JOIN (SELECT unnest(['three_way', 'two_way', 'grouped', 'half']) AS method) m
""")
def splits_of_missing_labels(spark, sf):
    label = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus"))
    group = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    rows = table(spark, sf, "orders").select("o_orderkey", label.alias("label"), group.alias("grp"))
    found = {
        "three_way": M.stratified_three_way(rows, "label", "o_orderkey"), "two_way": M.stratified_two_way(rows, "label", "o_orderkey"),
        "grouped": M.grouped_split(rows, "label", "grp"), "half": M.stratified_fraction(rows, "label", "o_orderkey", 0.5),
    }
    parts = [df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("method", F.lit(name)) for name, df in found.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


HEADERS = ("## Game: 1 | Hand: ", "##  Game: 1 | Hand: ", "## game: 1 | hand: ")


@query("history_file_sections", "S11", f"""
SELECT {list(HEADERS)!r}[CAST(o_orderkey % 3 + 1 AS INT)] || o_orderkey || ' ##' || chr(10) || 'one calls ' || o_custkey || chr(10) || 'two folds.' AS text FROM orders
""")
def history_file_sections(spark, sf):
    head = F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    text = F.concat(head, F.col("o_orderkey").cast("string"), F.lit(" ##\none calls "), F.col("o_custkey").cast("string"), F.lit("\ntwo folds."))
    path = scratch_path(spark, "histories")
    table(spark, sf, "orders").select(text.alias("value")).write.text(path)
    return I.history_sections(spark, path).select("text")


@query("stream_upsert_late_batches", "T3", "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def stream_upsert_late_batches(spark, sf):
    """Three batches, the newest events first."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "value")
    target = scratch_path(spark, "late")
    edge = rows.agg(F.max("event_id").alias("m")).first()["m"] or 0
    for low, high in ((2 * edge // 3, edge + 1), (edge // 3, 2 * edge // 3), (0, edge // 3)):
        rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).write.mode("append").parquet(f"{target}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{target}/in")
        S.upsert_stream(stream, f"{target}/table", f"{target}/checkpoint", "user_id", "event_id")
    return S.latest(spark, f"{target}/table", ["user_id"], "event_id").select("user_id", "event_id", "value")
