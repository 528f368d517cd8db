"""Reports: counts, rates, confusion, metrics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import reports as P
from ...operators.profile import curve_diagnostic
from ...registry import query, table
from .records import SENS_CTE, item_sensitivity
from ...operators import runs as R


@query("value_count_report", "A1", "SELECT CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY 1")
def value_count_report(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("p"))
    return P.value_counts(rows, "p")


@query("nested_count_report", "A2", 'SELECT l_returnflag AS "outer", l_linestatus AS "inner", count(*) AS n FROM lineitem GROUP BY 1, 2')
def nested_count_report(spark, sf):
    return P.nested_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


@query("nested_count_maps", "A2", "SELECT l_returnflag AS \"outer\", string_agg(l_linestatus || '=' || n, ',' ORDER BY l_linestatus) AS counts FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def nested_count_maps(spark, sf):
    maps = P.as_map(P.nested_counts(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"), ["outer"], "inner", "n")
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("outer", F.array_join(entries, ",").alias("counts"))


@query("missing_rate_report", "A3", """
SELECT unnest(['text', 'lang', 'source', 'short_lang']) AS field, unnest([
  round_even(avg(CASE WHEN text IS NULL OR regexp_full_match(text, '\\s*') THEN 1.0 ELSE 0.0 END), 6), round_even(avg(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1.0 ELSE 0.0 END), 6),
  round_even(avg(CASE WHEN source IS NULL OR trim(source) = '' THEN 1.0 ELSE 0.0 END), 6), round_even(avg(CASE WHEN n_chars % 3 = 0 THEN 1.0 WHEN n_chars % 7 = 0 THEN 1.0 ELSE 0.0 END), 6)])::DOUBLE AS missing_rate FROM documents
""")
def missing_rate_report(spark, sf):
    short = F.when(F.col("n_chars") % 3 == 0, F.lit(None)).when(F.col("n_chars") % 7 == 0, F.lit("  ")).otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").select("text", "lang", "source", short.alias("short_lang"))
    return P.missing_rates(rows)


@query("export_summary_report", "A4 A29", SENS_CTE + """
, e AS (SELECT why IS NOT NULL AS excluded, coalesce(why, '') AS exclusion_reason, coalesce(CASE WHEN why IS NULL THEN CASE act WHEN 'BET_33' THEN 'RAISE' ELSE act END END, '') AS label,
  coalesce(CASE WHEN context LIKE '%check_or_bet' THEN 'hero_check_or_bet' WHEN context LIKE '%facing_bet' THEN 'hero_facing_bet' END, '') AS context FROM x)
SELECT 'all' AS dimension, '' AS value, count(*) AS rows, count(*) FILTER (excluded) AS excluded_rows FROM e
UNION ALL SELECT 'exclusion_reason', exclusion_reason, count(*), count(*) FILTER (excluded) FROM e GROUP BY 2
UNION ALL SELECT 'bootstrap_label', label, count(*), count(*) FILTER (excluded) FROM e GROUP BY 2
UNION ALL SELECT 'decision_context_type', context, count(*), count(*) FILTER (excluded) FROM e GROUP BY 2
UNION ALL SELECT 'street', 'RIVER', count(*), count(*) FILTER (excluded) FROM e
""")
def export_summary_report(spark, sf):
    rows = R.candidate_rows(R.normalize_sensitivity(item_sensitivity(spark, sf)))
    return P.export_summary(rows, ["exclusion_reason", "bootstrap_label", "decision_context_type", "street"])


@query("export_warning_row", "A4 A31", SENS_CTE + """
SELECT count(*) AS rows_total, count(*) FILTER (why IS NULL) AS exported, count(*) FILTER (why IS NOT NULL) AS excluded_count, 0.0::DOUBLE AS weak_rule_row_rate,
  CASE WHEN count(*) FILTER (why IS NULL) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS solver_candidate_row_rate,
  array_to_string(list_sort(list_filter(['not_gto', 'not_for_production', CASE WHEN count(*) FILTER (why IS NULL) > 0 THEN 'bootstrap_solver_untrusted' END, CASE WHEN count(*) FILTER (why = 'all_in_excluded') > 0 THEN 'all_in_excluded' END,
    CASE WHEN count(*) FILTER (why IS NULL) < 500 THEN 'small_dataset' END, 'call_class_absent'], lambda w: w IS NOT NULL)), ',') AS warnings FROM x
""")
def export_warning_row(spark, sf):
    rows = R.candidate_rows(R.normalize_sensitivity(item_sensitivity(spark, sf)))
    return P.export_warnings(rows).withColumn("warnings", F.array_join("warnings", ","))


@query("export_missing_fields", "A4", "SELECT unnest(['hero_cards', 'iterations', 'exploitability_last']) AS field, unnest([0, count(*) FILTER (l_quantity < 5), count(*)]) AS n FROM lineitem")
def export_missing_fields(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.array(F.lit("Ah")).alias("hero_cards"), F.when(F.col("l_quantity") >= 5, F.col("l_quantity").cast("string")).otherwise("none").alias("iterations"), F.lit(None).cast("double").alias("exploitability_last")
    )
    return P.missing_counts(rows, ["hero_cards", "iterations", "exploitability_last"])


PREDICTED = "CASE WHEN l_quantity < 20 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END"
COUNTS_CTE = f"WITH c AS (SELECT l_linestatus, l_returnflag AS label, {PREDICTED} AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)"


def predicted_items(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_linestatus", F.col("l_returnflag").alias("truth"), F.when(q < 20, "A").when(q < 35, "N").otherwise("R").alias("said"))


@query("confusion_matrix_report", "A12 A26", COUNTS_CTE + """
SELECT k.label, CAST(coalesce(sum(n) FILTER (prediction = 'A'), 0) AS BIGINT) AS "A", CAST(coalesce(sum(n) FILTER (prediction = 'N'), 0) AS BIGINT) AS "N", CAST(coalesce(sum(n) FILTER (prediction = 'R'), 0) AS BIGINT) AS "R",
  CAST(coalesce(sum(n) FILTER (prediction = 'X'), 0) AS BIGINT) AS "X" FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS label) k LEFT JOIN c USING (label) GROUP BY 1
""")
def confusion_matrix_report(spark, sf):
    return P.confusion_matrix(predicted_items(spark, sf), "truth", "said", ["A", "N", "R", "X"])


def _metrics_sql(group):
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    on = f"USING ({group}, class)" if group else "USING (class)"
    return COUNTS_CTE + f"""
, t AS (SELECT {g}label AS class, sum(n) AS support, sum(n) FILTER (label = prediction) AS hit FROM c GROUP BY ALL), p AS (SELECT {g}prediction AS class, sum(n) AS predicted FROM c GROUP BY ALL),
m AS (SELECT {g}class, coalesce(coalesce(hit, 0) / predicted::DOUBLE, 0) AS pr, coalesce(coalesce(hit, 0) / support::DOUBLE, 0) AS re, coalesce(support, 0) AS support FROM t FULL JOIN p {on}),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)
"""


@query("class_metric_report", "A13", _metrics_sql("") + "SELECT class, round(pr, 8) AS precision, round(re, 8) AS recall, round(f1, 8) AS f1, CAST(support AS BIGINT) AS support FROM f")
def class_metric_report(spark, sf):
    out = P.class_metrics(P.confusion_counts(predicted_items(spark, sf), "truth", "said"))
    return out.select("class", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("overall_metric_report", "A13", _metrics_sql("") + """
SELECT (SELECT CAST(sum(n) AS BIGINT) FROM c) AS rows, (SELECT round_even(sum(n) FILTER (label = prediction) / sum(n)::DOUBLE, 6) FROM c) AS accuracy, round_even(sum(f1) / 4, 6) AS macro_f1, round_even(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f
""")
def overall_metric_report(spark, sf):
    return P.overall_metrics(P.confusion_counts(predicted_items(spark, sf), "truth", "said"), labels=["A", "N", "R", "X"])


@query("grouped_performance_report", "A14", _metrics_sql("l_linestatus") + """
, a AS (SELECT l_linestatus, CAST(sum(n) AS BIGINT) AS rows, round_even(sum(n) FILTER (label = prediction) / sum(n)::DOUBLE, 6) AS accuracy FROM c GROUP BY 1)
SELECT l_linestatus, rows, accuracy, round_even(avg(f1), 6) AS macro_f1, round_even(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f JOIN a USING (l_linestatus) GROUP BY ALL
""")
def grouped_performance_report(spark, sf):
    return P.overall_metrics(P.confusion_counts(predicted_items(spark, sf), "truth", "said", ["l_linestatus"]), ["l_linestatus"])


@query("recall_by_source_and_label", "A14", COUNTS_CTE + "SELECT l_linestatus, label AS class, round(sum(n) FILTER (label = prediction) / sum(n)::DOUBLE, 8) AS recall FROM c GROUP BY 1, 2")
def recall_by_source_and_label(spark, sf):
    out = P.class_metrics(P.confusion_counts(predicted_items(spark, sf), "truth", "said", ["l_linestatus"]), ["l_linestatus"])
    return out.select("l_linestatus", "class", F.round("recall", 8).alias("recall"))


@query("normalized_confusion_report", "A27 W6", COUNTS_CTE + ", s AS (SELECT label, prediction, sum(n) AS n FROM c GROUP BY 1, 2) SELECT label, prediction, CAST(n AS BIGINT) AS n, round(n / (sum(n) OVER (PARTITION BY label))::DOUBLE, 8) AS share FROM s")
def normalized_confusion_report(spark, sf):
    out = P.normalized_confusion(P.confusion_counts(predicted_items(spark, sf), "truth", "said"))
    return out.withColumn("share", F.round("share", 8))


@query("confusion_reading_row", "A27", COUNTS_CTE + """
, s AS (SELECT label, prediction, sum(n) AS n FROM c GROUP BY 1, 2), o AS (SELECT * FROM s WHERE label <> prediction ORDER BY n DESC, label DESC, prediction DESC LIMIT 1),
h AS (SELECT coalesce(a.k, b.k) AS k, coalesce(p, 0) / (SELECT sum(n) FROM s)::DOUBLE AS ps, coalesce(t, 0) / (SELECT sum(n) FROM s)::DOUBLE AS ts FROM (SELECT prediction AS k, sum(n) AS p FROM s GROUP BY 1) a FULL JOIN (SELECT label AS k, sum(n) AS t FROM s GROUP BY 1) b ON a.k = b.k)
SELECT label AS actual, prediction AS predicted, CAST(n AS BIGINT) AS n, coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM h WHERE ps > ts + 0.10), '') AS over_predicted FROM o
""")
def confusion_reading_row(spark, sf):
    out = P.confusion_reading(P.confusion_counts(predicted_items(spark, sf), "truth", "said"))
    return out.withColumn("over_predicted", F.array_join("over_predicted", ","))


@query("label_share_report", "A28 W6", """
SELECT source, quality AS label, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY source))::DOUBLE, 8) AS share,
  CASE WHEN count(*) / (sum(count(*)) OVER (PARTITION BY source))::DOUBLE > 0.6 THEN 'above_60_percent' WHEN count(*) / (sum(count(*)) OVER (PARTITION BY source))::DOUBLE < 0.1 THEN 'below_10_percent' END AS warning
FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2
""")
def label_share_report(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    out = P.label_shares(rows, "quality", ["source"])
    return out.withColumn("share", F.round("share", 8))


@query("majority_baseline_report", "A28 M8", """
WITH c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_linestatus, arg_max(l_returnflag, n * 1000 + ascii(l_returnflag)) AS majority, round(max(n) / sum(n)::DOUBLE, 8) AS baseline FROM c GROUP BY 1
""")
def majority_baseline_report(spark, sf):
    out = P.majority_baseline(table(spark, sf, "lineitem"), "l_returnflag", ["l_linestatus"])
    return out.withColumn("baseline", F.round("baseline", 8))


@query("performance_grid_report", "J1 A26", """
WITH p AS (SELECT source, CASE WHEN toxic = 1 THEN 'river' WHEN quality = 1 THEN 'preflop' ELSE 'postflop' END AS model, count(*) AS rows FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
g AS (SELECT DISTINCT source FROM p) SELECT source, model, coalesce(CAST(rows AS VARCHAR), 'not available') AS rows FROM (SELECT source, unnest(['preflop', 'postflop', 'river']) AS model FROM g) LEFT JOIN p USING (source, model)
""")
def performance_grid_report(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    model = F.when(F.col("toxic") == 1, "river").when(F.col("quality") == 1, "preflop").otherwise("postflop")
    perf = rows.groupBy("source", model.alias("model")).agg(F.count(F.lit(1)).alias("rows"))
    return P.performance_grid(perf, "source", ["preflop", "postflop", "river"], ["rows"])


LONG_CTE = """
WITH r AS (SELECT event_type, avg(value) AS v, count(*) AS n, max(value) AS m FROM events GROUP BY 1),
l AS (SELECT event_type, 'scores.mean' AS metric, v AS value FROM r UNION ALL SELECT event_type, 'scores.top', m FROM r UNION ALL SELECT event_type, 'rows', n FROM r UNION ALL SELECT event_type, 'absent.path', NULL FROM r)
"""


def _event_reports(spark, sf):
    r = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"), F.max("value").alias("m"))
    doc = r.select("event_type", F.to_json(F.struct(F.struct(F.col("v").alias("mean"), F.col("m").alias("top")).alias("scores"), F.col("n").alias("rows"))).alias("report"))
    return P.metric_rows(doc, "report", ["scores.mean", "scores.top", "rows", "absent.path"], ["event_type"])


@query("report_metric_rows", "P46", LONG_CTE + "SELECT event_type, metric, round(value, 6) AS value FROM l")
def report_metric_rows(spark, sf):
    return _event_reports(spark, sf).withColumn("value", F.round("value", 6))


@query("report_comparison", "J10 O6", LONG_CTE + """
SELECT metric, round(a.value, 6) AS click, round(b.value, 6) AS view, round_even(a.value - b.value, 6) AS delta,
  CASE WHEN a.value - b.value IS NULL THEN 'not available' WHEN a.value - b.value > 5 THEN 'click' WHEN a.value - b.value < -5 THEN 'view' ELSE 'similar' END AS winner,
  CAST(CASE metric WHEN 'rows' THEN 1 WHEN 'scores.mean' THEN 2 WHEN 'scores.top' THEN 3 ELSE 0 END AS BIGINT) AS position
FROM (SELECT * FROM l WHERE event_type = 'click') a FULL JOIN (SELECT * FROM l WHERE event_type = 'view') b USING (metric)
""")
def report_comparison(spark, sf):
    rows = _event_reports(spark, sf)
    out = P.compare_metrics(rows.filter("event_type = 'click'"), rows.filter("event_type = 'view'"), ("click", "view"), 5.0)
    out = out.withColumn("position", P.category_position(F.col("metric"), ("rows", "scores.mean", "scores.top")))
    return out.withColumns({"click": F.round("click", 6), "view": F.round("view", 6)}).orderBy("position")


VARIANTS = """WITH v AS (SELECT CASE l_linenumber WHEN 1 THEN 'without_constant_features' ELSE 'variant_' || l_linenumber END AS name, avg(l_discount) AS macro_f1, avg(l_tax) AS weighted_f1, avg(l_quantity) / 100 AS accuracy FROM lineitem GROUP BY 1)"""


def _variants(spark, sf):
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").groupBy(F.when(n == 1, "without_constant_features").otherwise(F.concat(F.lit("variant_"), n.cast("string"))).alias("name")).agg(
        F.avg("l_discount").alias("macro_f1"), F.avg("l_tax").alias("weighted_f1"), (F.avg("l_quantity") / 100).alias("accuracy")
    )


@query("ablation_reading_report", "J12 M11", VARIANTS + " SELECT name, round(macro_f1, 8) AS macro_f1, round_even(macro_f1 - (SELECT macro_f1 FROM v WHERE name = 'without_constant_features'), 6) AS delta FROM v")
def ablation_reading_report(spark, sf):
    return P.ablation_reading(_variants(spark, sf)).withColumn("macro_f1", F.round("macro_f1", 8))


@query("best_model_selection", "O5", VARIANTS + " SELECT name AS selected_model FROM v ORDER BY macro_f1 DESC, weighted_f1 DESC, accuracy DESC LIMIT 1")
def best_model_selection(spark, sf):
    return P.best_model(_variants(spark, sf).withColumnRenamed("name", "model"))


@query("pivot_sum_report", "A26", """SELECT o_orderpriority, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0)::BIGINT AS "F", coalesce(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END), 0)::BIGINT AS "O", 0::BIGINT AS "Z" FROM orders GROUP BY 1""")
def pivot_sum_report(spark, sf):
    return P.pivot_sum(table(spark, sf, "orders").withColumn("one", F.lit(1)), "o_orderpriority", "o_orderstatus", ["F", "O", "Z"], "one")


@query("augmentation_accounting_row", "A30", """
WITH g AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'solver_generated' WHEN o_orderkey % 5 < 3 THEN 'resampled_jitter' ELSE 'real_imported' END AS m, CAST(o_custkey AS VARCHAR) AS s FROM orders)
SELECT count(*) AS final_rows, count(*) FILTER (m = 'real_imported') AS real_rows, count(*) FILTER (m = 'solver_generated') AS solver_rows, count(*) FILTER (m = 'resampled_jitter') AS resampled_rows, count(DISTINCT s) AS source_ids,
  round_even(count(*) / count(DISTINCT s)::DOUBLE, 6) AS inflation_ratio, 'imported_plus_solver_plus_resampling' AS generation_mode, CASE WHEN count(*) / count(DISTINCT s) > 20 THEN 'inflation_ratio_above_20,' ELSE '' END || CASE WHEN count(*) > 7000 THEN 'target_rows_above_learning_curve_overfit_threshold' ELSE '' END AS warnings FROM g
""")
def augmentation_accounting_row(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.when(k % 5 == 0, "solver_generated").when(k % 5 < 3, "resampled_jitter").otherwise("real_imported").alias("generation_method"), F.col("o_custkey").cast("string").alias("source_snapshot_id")
    )
    return P.augmentation_accounting(rows).withColumn("warnings", F.array_join("warnings", ","))


@query("training_reliability_row", "A31", """
SELECT count(*) AS rows, 3::BIGINT AS classes, 'dataset_used_for_pipeline_smoke_test_only,not_for_production,not_gto,contains_weak_rule_labels,model_may_learn_synthetic_rules,metrics_may_be_artificial_due_to_weak_rules,label_quality_bootstrap_weak_rule_untrusted,hero_cards_missing_or_null,all_in_absent_because_excluded' AS warnings,
  CAST(NULL AS VARCHAR) AS guard_error FROM orders
""")
def training_reliability_row(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        F.when(k % 3 == 0, "CALL").when(k % 3 == 1, "FOLD").otherwise("RAISE").alias("bootstrap_label"), F.when(k % 2 == 0, "weak_rule_bootstrap").alias("label_source"),
        F.when(k % 2 == 0, "bootstrap_weak_rule_untrusted").alias("label_quality"), F.when(k % 7 == 0, "[]").otherwise('["Ah"]').alias("hero_cards"), F.lit('["2c"]').alias("board_cards"),
    )
    return P.reliability(rows).withColumn("warnings", F.array_join("warnings", ","))


@query("learning_curve_reading", "M10 F20", VARIANTS + """
SELECT name, CASE WHEN accuracy * 4 > 0.95 AND accuracy * 4 - macro_f1 * 10 > 0.08 THEN 'overfit_probable' WHEN accuracy * 4 < 0.65 AND macro_f1 * 10 < 0.65 THEN 'underfit_probable' ELSE 'acceptable' END AS diagnostic FROM v
""")
def learning_curve_reading(spark, sf):
    return _variants(spark, sf).select("name", curve_diagnostic(F.col("accuracy") * 4, F.col("macro_f1") * 10).alias("diagnostic"))
