"""Feature profiles, correlations and schema checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import profile as Q
from ...operators.ranks import running
from ...registry import query, table

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linestatus", "flat"]
LONG = """
WITH u AS (SELECT l_returnflag AS label, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_linestatus', 'flat']) AS feature, unnest([CAST(l_quantity AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR), l_linestatus, '0.0']) AS value FROM lineitem),
n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS number FROM u)
"""


def item_values(spark, sf):
    rows = table(spark, sf, "lineitem", wide=True).select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linestatus", F.lit(0.0).alias("flat"))
    return Q.feature_values(rows, FEATURES, "l_returnflag")


@query("feature_statistics_report", "A15", LONG + """
SELECT feature, count(*) AS rows, count(*) FILTER (lower(value) IN ('', 'none', 'null', '[]', 'unknown')) AS null_count, count(DISTINCT value) AS nunique, round_even(min(number), 8) AS min, round_even(max(number), 8) AS max, round(avg(number), 8) AS mean,
  round(stddev_pop(number), 8) AS std, round_even(count(*) FILTER (abs(number) <= 1e-12) / count(*)::DOUBLE, 8) AS zero_proportion FROM n GROUP BY 1
""")
def feature_statistics_report(spark, sf):
    return Q.feature_statistics(item_values(spark, sf), 8)


@query("feature_by_label_report", "A15", LONG + "SELECT feature, label, count(*) AS count, round(avg(number), 8) AS mean, round(stddev_pop(number), 8) AS std FROM n GROUP BY 1, 2")
def feature_by_label_report(spark, sf):
    return Q.label_statistics(item_values(spark, sf), 8)


@query("constant_feature_list", "A16", LONG + "SELECT feature FROM n GROUP BY 1 HAVING count(DISTINCT value) <= 1 OR stddev_pop(number) <= 1e-12 OR count(*) FILTER (abs(number) <= 1e-12) / count(*)::DOUBLE >= 0.995")
def constant_feature_list(spark, sf):
    return Q.constant_features(Q.feature_statistics(item_values(spark, sf))).select("feature")


SUSPECT = """
WITH u AS (SELECT o_orderstatus AS label, unnest(['price', 'leak', 'gate']) AS feature, unnest([o_totalprice, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END + (o_orderkey % 2) * 0.1, CASE o_orderstatus WHEN 'F' THEN 1.0 ELSE 0.0 END]) AS number FROM orders),
m AS (SELECT feature, label, round_even(avg(number), 6) AS mean FROM u GROUP BY 1, 2), r AS (SELECT feature, round_even(min(number), 6) AS lo, round_even(max(number), 6) AS hi FROM u GROUP BY 1),
s AS (SELECT feature, max(mean) - min(mean) AS spread, arg_max(label, mean * 1000 + ascii(label) / 1000.0) AS suspected_label, min(CASE WHEN mean IN (0.0, 1.0) THEN 1 ELSE 0 END) AS b, count(*) AS k FROM m GROUP BY 1)
SELECT feature, suspected_label, round_even(spread, 6) AS spread, round_even(hi - lo, 6) AS global_range, round_even(spread / (hi - lo), 6) AS spread_to_range_ratio FROM s JOIN r USING (feature) WHERE k >= 2 AND hi - lo > 1e-12 AND (spread / (hi - lo) >= 0.8 OR (b = 1 AND spread >= 0.75))
"""


@query("suspect_feature_list", "A16", SUSPECT)
def suspect_feature_list(spark, sf):
    s = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        s.alias("label"), F.col("o_totalprice").alias("price"), (F.when(s == "F", 1.0).when(s == "O", 2.0).otherwise(3.0) + (F.col("o_orderkey") % 2) * 0.1).alias("leak"), F.when(s == "F", 1.0).otherwise(0.0).alias("gate")
    )
    values = Q.feature_values(rows, ["price", "leak", "gate"], "label")
    return Q.suspect_features(Q.feature_statistics(values), Q.label_statistics(values))


@query("label_heatmap_report", "A17 W5", LONG + """
  , m AS (SELECT feature, label, round(avg(number), 8) AS mean FROM n GROUP BY 1, 2), w AS (SELECT *, min(mean) OVER (PARTITION BY feature) AS lo, max(mean) OVER (PARTITION BY feature) AS hi FROM m)
SELECT feature, label, mean, CASE WHEN mean IS NULL THEN NULL WHEN hi = lo THEN 0.0 ELSE round_even((mean - lo) / (hi - lo), 8) END AS scaled FROM w
""")
def label_heatmap_report(spark, sf):
    return Q.label_heatmap(item_values(spark, sf), 8)


@query("category_share_report", "A17 O2", LONG + """
, c AS (SELECT feature, value, count(*) AS n, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM n GROUP BY 1, 2), t AS (SELECT feature, label, count(*) AS total FROM n GROUP BY 1, 2), x AS (SELECT feature, label, value, count(*) AS n FROM n GROUP BY 1, 2, 3)
SELECT feature, value, label, round_even(coalesce(x.n, 0) / total::DOUBLE, 6) AS share FROM c JOIN t USING (feature) LEFT JOIN x USING (feature, label, value) WHERE r <= 8
""")
def category_share_report(spark, sf):
    return Q.category_shares(item_values(spark, sf), 8)


@query("top_value_report", "O2 A15", LONG + "SELECT feature, value, count(*) AS n, CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS INT) AS position FROM n GROUP BY 1, 2 QUALIFY position <= 20")
def top_value_report(spark, sf):
    return Q.top_values(item_values(spark, sf), 20)


@query("categorical_cardinality_report", "A18", """
WITH u AS (SELECT unnest(['p_brand', 'p_type', 'p_name']) AS feature, unnest([p_brand, p_type, p_name]) AS value FROM part)
SELECT feature, count(DISTINCT value) AS cardinality, CASE WHEN count(DISTINCT value) <= 30 THEN string_agg(DISTINCT value, '|' ORDER BY value) END AS "values" FROM u GROUP BY 1
""")
def categorical_cardinality_report(spark, sf):
    out = Q.cardinality(table(spark, sf, "part"), ["p_brand", "p_type", "p_name"], list_up_to=30)
    return out.withColumn("values", F.array_join("values", "|"))


@query("label_id_mapping", "A18", "SELECT l_returnflag AS label, CAST(row_number() OVER (ORDER BY l_returnflag) - 1 AS INT) AS id FROM (SELECT DISTINCT l_returnflag FROM lineitem)")
def label_id_mapping(spark, sf):
    return Q.label_ids(table(spark, sf, "lineitem"), "l_returnflag")


ENCODED = """
WITH x AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_quantity * 2 AS d, 0.0::DOUBLE AS z, (l_returnflag = 'A')::INT::DOUBLE AS ra, (l_returnflag = 'N')::INT::DOUBLE AS rn, (l_returnflag = 'R')::INT::DOUBLE AS rr FROM lineitem)
"""
NAMES = ["a", "b", "c", "d", "z", "flag=A", "flag=N", "flag=R"]
SQL_NAMES = ["a", "b", "c", "d", "z", "ra", "rn", "rr"]


def encoded_items(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.col("l_discount").alias("c"), (F.col("l_quantity") * 2).alias("d"), F.lit(0.0).alias("z"), F.col("l_returnflag").alias("flag"))
    return Q.encoded(rows, ["a", "b", "c", "d", "z"], {"flag": ["A", "N", "R"]})


def _pairs_sql():
    parts = []
    for i in range(len(NAMES)):
        for j in range(i + 1, len(NAMES)):
            flat = "z" in (SQL_NAMES[i], SQL_NAMES[j])
            value = "0.0" if flat else f"corr({SQL_NAMES[i]}, {SQL_NAMES[j]})"
            parts.append(f"SELECT '{NAMES[i]}' AS feature_a, '{NAMES[j]}' AS feature_b, {value}::DOUBLE AS correlation FROM x")
    return ENCODED + ", p AS (" + " UNION ALL ".join(parts) + ")"


@query("correlation_pairs", "M13", _pairs_sql() + " SELECT DISTINCT feature_a, feature_b, round(correlation, 6) + 0.0 AS correlation FROM p")
def correlation_pairs(spark, sf):
    rows, names = encoded_items(spark, sf)
    out = Q.correlation_rows(rows, Q.correlation_matrix(rows), names)
    return out.withColumn("correlation", F.round("correlation", 6) + F.lit(0.0))


@query("high_correlation_pairs", "M13 O4 F20", _pairs_sql() + """ SELECT DISTINCT feature_a, feature_b, round(correlation, 6) AS correlation, round(abs(correlation), 6) AS abs_correlation,
 CASE WHEN abs(correlation) > 0.95 THEN 'suspect_redundant' WHEN abs(correlation) > 0.9 THEN 'redondant' ELSE 'acceptable_monitor' END AS comment FROM p WHERE abs(correlation) > 0.3""")
def high_correlation_pairs(spark, sf):
    rows, names = encoded_items(spark, sf)
    return Q.high_pairs(Q.correlation_rows(rows, Q.correlation_matrix(rows), names), 0.3)


@query("variance_inflation_report", "M14 F20", """
WITH x AS (SELECT corr(l_quantity, l_extendedprice) AS ab, corr(l_quantity, l_discount) AS ac, corr(l_extendedprice, l_discount) AS bc FROM lineitem), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS det FROM x)
SELECT 'l_quantity' AS feature, round(greatest(1.0, (1 - bc * bc) / det), 5) AS vif FROM d UNION ALL SELECT 'l_extendedprice', round(greatest(1.0, (1 - ac * ac) / det), 5) FROM d UNION ALL SELECT 'l_discount', round(greatest(1.0, (1 - ab * ab) / det), 5) FROM d
""")
def variance_inflation_report(spark, sf):
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    rows, _ = Q.encoded(table(spark, sf, "lineitem"), names, {})
    vif = Q.variance_inflation(Q.correlation_matrix(rows, 1.0))
    return spark.createDataFrame(list(zip(names, vif)), "feature string, vif double").withColumn("vif", F.round("vif", 5))


@query("json_schema_inference", "A19 S19", """
SELECT 'k' AS path, count(*) AS present_count, TRUE AS required, 'int' AS types, 0::BIGINT AS empty_count, CAST(NULL AS VARCHAR) AS categorical_values FROM events
UNION ALL SELECT 'kind', count(*), TRUE, 'string', 0, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM events
UNION ALL SELECT 'deep', count(*), FALSE, 'object', 0, NULL FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 'deep.odd', count(*), TRUE, 'bool', 0, 'false,true' FROM events WHERE event_id % 3 = 0
UNION ALL SELECT 'deep.v', count(*), FALSE, 'float', 0, NULL FROM events WHERE event_id % 6 = 0
UNION ALL SELECT 'gap', count(*), TRUE, 'empty', count(*), NULL FROM events
""")
def json_schema_inference(spark, sf):
    i = F.col("event_id")
    deep = F.when(i % 3 == 0, F.concat(F.lit(', "deep": {"odd": '), (i % 2 == 1).cast("string"), F.when(i % 6 == 0, F.lit(', "v": 1.5')).otherwise(""), F.lit("}"))).otherwise("")
    raw = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "gap": "None"'), deep, F.lit("}"))
    out = Q.json_schema(table(spark, sf, "events", wide=True).select(raw.alias("raw")), "raw", categories=30)
    return out.withColumns({"types": F.array_join("types", ","), "categorical_values": F.array_join("categorical_values", ",")})


@query("csv_schema_inference", "A19 A20", """
SELECT 'num' AS path, CASE WHEN count(*) > 0 THEN 'float,int' END AS types, count(*) AS present_count, 0::BIGINT AS empty_count FROM events
UNION ALL SELECT 'props', 'json_object', count(*), 0 FROM events UNION ALL SELECT 'flag', 'bool', count(*), count(*) FILTER (event_id % 4 = 0) FROM events UNION ALL SELECT 'listed', 'json_array,string', count(*), 0 FROM events
""")
def csv_schema_inference(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.when(i % 2 == 0, i.cast("string")).otherwise("1.5").alias("num"), "props", F.when(i % 4 == 0, "None").otherwise("True").alias("flag"), F.when(i % 2 == 0, "[1,2]").otherwise("[x").alias("listed")
    )
    return Q.csv_schema(rows).withColumn("types", F.array_join("types", ","))


DIFF = """
SELECT unnest(['num', 'props', 'flag', 'listed', 'gone', 'more']) AS path, unnest(['ok', 'incompatible', 'empty', 'ok', 'missing', 'extra']) AS status
"""


def _diff(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(i.cast("string").alias("num"), "props", F.lit("").alias("flag"), F.lit("[1]").alias("listed"), F.lit("x").alias("more"))
    current = Q.csv_schema(rows)
    reference = spark.createDataFrame([("num", ["float"]), ("props", ["string"]), ("flag", ["bool"]), ("listed", ["array"]), ("gone", ["string"])], "path string, types array<string>")
    return Q.schema_diff(reference, current)


@query("schema_difference", "A20 U5", DIFF)
def schema_difference(spark, sf):
    return _diff(spark, sf).select("path", "status")


@query("schema_alignment_row", "A20 P35", "SELECT 1::BIGINT AS missing, 1::BIGINT AS extra, 1::BIGINT AS incompatible, 1::BIGINT AS \"empty\", 2::BIGINT AS ok, 1 AS leakage_used, 'needs_review' AS alignment_status")
def schema_alignment_row(spark, sf):
    return Q.alignment_status(_diff(spark, sf), ["num", "labels.final_action"])


@query("feature_contract_table", "M16 P35", """
SELECT unnest(['l_returnflag', 'l_quantity', 'l_discount', 'l_tax', 'flat', 'gone', 'audit.note', 'l_comment_like']) AS feature, unnest(['target', 'model_used', 'model_used', 'model_used', 'constant_excluded', 'not_available_yet', 'leakage_excluded', 'audit_only']) AS status
""")
def feature_contract_table(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", "l_discount", "l_tax", F.lit(0.0).alias("flat"), F.lit("None").alias("gone"), F.lit("x").alias("audit.note"), F.col("l_linestatus").alias("l_comment_like")
    )
    candidates = ["l_quantity", "l_discount", "l_tax", "flat", "gone"]
    stats = Q.feature_statistics(Q.feature_values(rows, candidates, "l_returnflag"))
    return Q.feature_contract(rows, stats, candidates, ["l_returnflag"])


@query("running_last_value", "W3", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase,
  CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS errors_before FROM events
""")
def running_last_value(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01"))
    kinds = {
        "last_purchase": ("last", F.when(F.col("event_type") == "purchase", F.col("value"))),
        "errors_before": ("sum", F.when(F.col("event_type") == "error", 1).otherwise(0)),
    }
    return running(rows, ["user_id"], ["ts", "event_id"], day, kinds).select("event_id", "last_purchase", "errors_before")
