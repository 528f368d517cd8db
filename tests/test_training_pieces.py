"""Models are trained on rows spread over every core, however few bytes they are."""

import pytest

import feltmill.plans.catalog  # noqa: F401  (fills the registry)
from feltmill.operators import training as M
from feltmill.registry import REGISTRY

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def pieces(spark, monkeypatch, name):
    def fit(model, train, *args):
        raise Seen(train.rdd.getNumPartitions())

    monkeypatch.setattr(M, "fit", fit)
    with pytest.raises(Seen) as caught:
        REGISTRY[name].run(spark, SF)
    return caught.value.args[0]


def test_scoring_model_trains_on_every_core(spark, monkeypatch):
    assert pieces(spark, monkeypatch, "batch_scoring") >= spark.sparkContext.defaultParallelism


def test_models_of_the_feature_list_train_on_every_core(spark, monkeypatch):
    assert pieces(spark, monkeypatch, "top_model_features") >= spark.sparkContext.defaultParallelism


def test_forests_of_many_rows_are_grown_on_cells(spark, monkeypatch):
    rows = spark.range(4000).selectExpr(
        "concat('k', id) AS snapshot_id", "if(id % 97 > 40 AND id % 3 = 1, 'A', if(id % 5 = 0, 'N', 'R')) AS bootstrap_label", "CAST(id % 97 AS double) AS x", "CAST(nullif(id % 5, 4) AS double) AS y", "CAST(id % 3 AS string) AS c"
    )
    matrix, settings = M.Matrix(["x", "y"], ["c"]), M.Settings(trees=6, depth=6)
    ready = M.kept(M.prepared(rows, matrix), "rows")
    plain = M.fit("random_forest", ready, matrix, settings)
    seen = []
    whole = M.RandomForestClassifier.fit
    monkeypatch.setattr(M.RandomForestClassifier, "fit", lambda self, df: seen.append(df.count()) or whole(self, df))
    monkeypatch.setattr(M, "CELLS_FROM", 0)
    model = M.fit("random_forest", ready, matrix, settings)
    assert len(seen) == settings.trees and max(seen) <= 32 * 4 * 3 * 3
    assert len(model.stages[-1].trees) == settings.trees and model.stages[-1].numFeatures == plain.stages[-1].numFeatures
    assert M.vector_names(model, matrix) == M.vector_names(plain, matrix) and M.labels_of(model) == ["A", "N", "R"]

    def right(fitted):
        return M.predict(fitted, ready).filter("_label = prediction_label").count() / 4000

    assert right(model) > 0.9 and abs(right(model) - right(plain)) < 0.05
    again = M.fit("random_forest", ready.repartition(3), matrix, settings)
    assert M.importances(spark, again, matrix, 9).collect() == M.importances(spark, model, matrix, 9).collect()


def test_draws_of_cells_are_those_of_rows(spark):
    cells = spark.createDataFrame([(float(i), 7 * i + 1, 40) for i in range(200)], "a double, _cell bigint, _n bigint")
    drawn = M._drawn(cells, 20, 17).toPandas().drop(columns="a").to_numpy()
    assert 39 < drawn.mean() < 41 and 36 < drawn.var() < 44


def test_ranges_of_few_and_many_values(spark):
    rows = spark.range(10000).selectExpr("CAST(id % 3 AS double) AS few", "CAST(id AS double) AS many", "1.0D AS one")
    few, many, one = M.bin_edges(rows, ["few", "many", "one"])
    assert few[1:-1] == [0.5, 1.5] and len(one) == 3 and len(many) == M.BINS + 1 and abs(many[16] - 5000) < 50
