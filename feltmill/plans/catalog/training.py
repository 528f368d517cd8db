"""Classifiers on the line items: the return flag is the label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import training as M
from ...registry import query, table

MATRIX = M.Matrix(["features.quantity", "features.price", "features.discount", "features.tax"], ["features.status"], "bootstrap_label", "snapshot_id")
SETTINGS = M.Settings()
#: Three models at the full settings take minutes at the smallest sizes.
SMALL = M.Settings(iterations=10, trees=8, depth=5)


def training_rows(spark, sf):
    i = table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    late = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400.0
    return i.select(
        key.alias("snapshot_id"), F.col("l_returnflag").alias("bootstrap_label"), F.col("l_quantity").alias("features.quantity"), (late % 1000).alias("features.price"), F.col("l_discount").alias("features.discount"),
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("features.tax"), F.col("l_linestatus").alias("features.status"), F.when(F.col("l_linenumber") < 4, "solver_candidate").otherwise("weak_rule_bootstrap").alias("label_source"),
    )


@query("model_comparison", "M7 M8 A13 O5")
def model_comparison(spark, sf):
    return M.compare_models(training_rows(spark, sf), MATRIX, SMALL)


@query("batch_scoring", "M9 M7")
def batch_scoring(spark, sf):
    rows = M.kept(M.prepared(training_rows(spark, sf), MATRIX), "rows")
    model = M.fit("random_forest", rows, MATRIX, SETTINGS)
    scored = M.predict(model, rows)
    return scored.groupBy("_label", "prediction_label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_A"), 4).alias("mean_p_a"))


@query("learning_curve", "M10 M4")
def learning_curve(spark, sf):
    return M.learning_curve(training_rows(spark, sf), MATRIX, "logistic_regression", settings=SETTINGS)


@query("feature_ablation", "M11")
def feature_ablation(spark, sf):
    variants = {
        "full_current": (MATRIX, None), "without_price": (MATRIX.without(["features.price"]), None), "solver_candidate_only": (MATRIX, "solver_candidate"), "nobody_only": (MATRIX, "nobody"), "no_columns": (MATRIX.only([]), None),
    }
    return M.ablation(training_rows(spark, sf), variants, SETTINGS)


@query("source_transfer", "M12")
def source_transfer(spark, sf):
    return M.transfer(training_rows(spark, sf), MATRIX, ["solver_candidate", "weak_rule_bootstrap"], SETTINGS)


@query("top_model_features", "O3")
def top_model_features(spark, sf):
    rows = M.kept(M.prepared(training_rows(spark, sf), MATRIX), "rows")
    weights = M.top_coefficients(spark, M.fit("logistic_regression", rows, MATRIX, SETTINGS), MATRIX, 3)
    trees = M.importances(spark, M.fit("random_forest", rows, MATRIX, SETTINGS), MATRIX, 3)
    return weights.select("label", "feature", F.col("coefficient").alias("value")).unionByName(trees.select(F.lit("forest").alias("label"), "feature", F.col("importance").alias("value")))
