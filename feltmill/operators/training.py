"""MLlib training: vectors, weighted classifiers, comparison, scoring, learning curves, ablations, transfer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import half_even
from ..schemas import check_matrix
from ..session import passing, stored
from .reports import best_model, confusion_counts, majority_baseline, overall_metrics
from .splits import stratified_fraction, stratified_two_way

#: Forests of more rows than this are grown on cells (`_forest_on_cells`).
CELLS_FROM = 1_000_000
#: Ranges a number is cut into for a forest, as many as MLlib's own.
BINS = 32

MODELS = ("dummy", "logistic_regression", "random_forest", "extra_trees")


@dataclass(frozen=True)
class Matrix:
    """Which columns make up X. Listed categories stay categories even when they look like numbers."""

    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    label: str = "bootstrap_label"
    key: str = "snapshot_id"

    def without(self, names: Sequence[str]) -> "Matrix":
        return Matrix([c for c in self.numeric if c not in names], [c for c in self.categorical if c not in names], self.label, self.key)

    def only(self, names: Sequence[str]) -> "Matrix":
        return Matrix([c for c in self.numeric if c in names], [c for c in self.categorical if c in names], self.label, self.key)

    @property
    def size(self) -> int:
        return len(self.numeric) + len(self.categorical)


@dataclass(frozen=True)
class Settings:
    """Sizes of the classifiers; extra trees stand in as whole-sample forests."""

    iterations: int = 100
    trees: int = 100
    depth: int = 8
    seed: int = 17
    models: Sequence[str] = field(default=MODELS)


def _plain(name: str) -> str:
    return name.replace(".", "__")


def prepared(df: DataFrame, matrix: Matrix) -> DataFrame:
    """Columns under names MLlib accepts, with the class weight n / (classes * n_class).

    The weights come from one row per label and are broadcast: the optimizer takes them for as large as the rows
    they were counted from, and would shuffle every row by its label.
    """
    check_matrix([*matrix.numeric, *matrix.categorical])
    rows = df.select(
        F.col(f"`{matrix.key}`").alias("_key"), F.col(f"`{matrix.label}`").cast("string").alias("_label"),
        *[F.col(f"`{c}`").cast("double").alias(_plain(c)) for c in matrix.numeric],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("UNKNOWN")).alias(_plain(c)) for c in matrix.categorical],
        *[F.col(c) for c in ("split", "group") if c in df.columns],
    ).filter("_label IS NOT NULL")
    counts = rows.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.join(totals).select("_label", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("_weight"))
    return rows.join(F.broadcast(weights), "_label")


def kept(rows: DataFrame, label: str) -> DataFrame:
    """Prepared rows, stored once in even pieces.

    Training costs minutes on few bytes and goes over its rows dozens of times; pieces cut by bytes would leave it to one core.
    """
    spark = rows.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return stored(rows.repartition(parts, "_key"), label)


def vector_stages(matrix: Matrix) -> list:
    """Median for missing numbers, one column per category; an unseen category is all zeros."""
    stages: list = []
    numeric = [_plain(c) for c in matrix.numeric]
    parts = []
    if numeric:
        stages.append(Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__f" for c in numeric]))
        parts += [f"{c}__f" for c in numeric]
    for c in map(_plain, matrix.categorical):
        stages += [
            StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__v", dropLast=True, handleInvalid="keep"),
        ]
        parts.append(f"{c}__v")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def fit(name: str, train: DataFrame, matrix: Matrix, settings: Settings = Settings()) -> PipelineModel:
    """Fit one classifier on prepared rows."""
    if name == "random_forest" and matrix.size and train.count() > CELLS_FROM:
        return _forest_on_cells(train, matrix, settings)
    label = StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc")
    common = {"featuresCol": "features", "labelCol": "_y", "weightCol": "_weight"}
    if name == "logistic_regression":
        model = LogisticRegression(maxIter=settings.iterations, **common)
    elif name == "random_forest":
        model = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, maxMemoryInMB=512, **common)
    elif name == "extra_trees":
        model = RandomForestClassifier(numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, bootstrap=False, maxMemoryInMB=512, **common)
    else:
        raise ValueError(f"unsupported_model_type:{name}")
    return Pipeline(stages=[label, *vector_stages(matrix), model]).fit(train)


def bin_edges(rows: DataFrame, columns: Sequence[str]) -> list[list[float]]:
    """Edges of at most `BINS` ranges a column: between all of its values if they are that few, else at its quantiles."""
    sizes = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if sizes[c] <= 2 * BINS]
    listed = rows.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first().asDict() if few else {}
    listed = {c: values for c, values in listed.items() if len(values) <= BINS}
    many = [c for c in columns if c not in listed]
    quantiles = dict(zip(many, rows.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001))) if many else {}
    inner = [[(a + b) / 2 for a, b in zip(listed[c], listed[c][1:])] if c in listed else sorted(set(quantiles[c])) for c in columns]
    # A bucketizer wants one inner edge at least.
    return [[float("-inf"), *(cuts or [0.0]), float("inf")] for cuts in inner]


def _drawn(cells: DataFrame, trees: int, seed: int) -> DataFrame:
    """Add `_t0`, `_t1`, ...: how often the rows of a cell are drawn for each tree. The cell and the seed alone decide.

    A bootstrap draws every row a Poisson(1) number of times, so the n rows of a cell are drawn Poisson(n) times in all.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            times = np.empty((len(b), trees), np.int64)
            for i, (cell, n) in enumerate(zip(b["_cell"], b["_n"])):
                times[i] = np.random.Generator(np.random.Philox(key=[seed & 0xFFFFFFFF, int(cell) & 0xFFFFFFFFFFFFFFFF])).poisson(n, trees)
            yield pd.concat([b.drop(columns=["_cell", "_n"]).reset_index(drop=True), pd.DataFrame(times, columns=[f"_t{i}" for i in range(trees)])], axis=1)

    kept_columns = [f for f in cells.schema if f.name not in ("_cell", "_n")]
    schema = ", ".join([*[f"`{f.name}` double" for f in kept_columns], *[f"_t{i} bigint" for i in range(trees)]])
    return cells.mapInPandas(draw, schema)


def _forest_on_cells(train: DataFrame, matrix: Matrix, settings: Settings) -> PipelineModel:
    """A random forest of many rows, grown on counts of equal cells.

    A forest sees a number only as one of `BINS` ranges. Rows that agree in all ranges, categories and the label are one cell,
    so the cells are bounded by the matrix, however many rows there are, and counts of rows say all a tree asks for. Every row takes part:
    each tree draws it Poisson(1) times, chooses among the root of the features at a node and weighs as the others do.
    Trees are fitted a few at a time, as each leaves most cores idle.
    """
    spark = train.sparkSession
    *early, assembler = vector_stages(matrix)
    label = StringIndexer(inputCol="_label", outputCol="_y", handleInvalid="skip", stringOrderType="alphabetAsc")
    prep = Pipeline(stages=[label, *early]).fit(train)
    ready = prep.transform(train)
    numbers, categories = [f"{_plain(c)}__f" for c in matrix.numeric], [_plain(c) for c in matrix.categorical]
    ranges = [f"{c}__r" for c in numbers]
    binned = [Bucketizer(splitsArray=bin_edges(ready, numbers), inputCols=numbers, outputCols=ranges, handleInvalid="keep")] if numbers else []
    assembler = assembler.copy({assembler.inputCols: [*ranges, *[f"{c}__v" for c in categories]]})
    for stage in binned:
        ready = stage.transform(ready)
    keys = ["_y", "_weight", *ranges, *[f"{c}__i" for c in categories]]
    counted = ready.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_cell", F.xxhash64(*keys))
    cells = stored(_drawn(counted, settings.trees, settings.seed), "cells")
    for c, encoder in zip(categories, [s for s in prep.stages if s.hasParam("dropLast")]):
        cells = encoder.transform(cells.withColumn(f"{c}__i", F.col(f"{c}__i").alias(f"{c}__i", metadata=ready.schema[f"{c}__i"].metadata)))
    cells = assembler.transform(cells.withColumn("_y", F.col("_y").alias("_y", metadata=ready.schema["_y"].metadata)))

    seeds = np.random.SeedSequence(settings.seed).generate_state(settings.trees).tolist()

    def grow(i: int) -> RandomForestClassificationModel:
        rows = cells.filter(F.col(f"_t{i}") > 0).select("features", "_y", (F.col("_weight") * F.col(f"_t{i}")).alias("_w"))
        one = RandomForestClassifier(
            numTrees=1, maxDepth=settings.depth, maxBins=BINS, seed=seeds[i], bootstrap=False, featureSubsetStrategy="sqrt", maxMemoryInMB=512, featuresCol="features", labelCol="_y", weightCol="_w"
        )
        return one.fit(rows)

    with ThreadPool(8) as pool:
        grown = pool.map(inheritable_thread_target(spark)(grow), range(settings.trees))
    jvm = spark._jvm.org.apache.spark.ml.classification
    trees = spark.sparkContext._gateway.new_array(jvm.DecisionTreeClassificationModel, len(grown))
    for i, model in enumerate(grown):
        trees[i] = model._java_obj.trees()[0]
    whole = jvm.RandomForestClassificationModel(grown[0].uid, trees, grown[0].numFeatures, grown[0].numClasses)
    forest = RandomForestClassificationModel(whole)
    forest._set(numTrees=settings.trees, maxDepth=settings.depth, maxBins=BINS, seed=settings.seed)
    return PipelineModel([*prep.stages, *binned, assembler, forest])


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add `prediction_label` and one rounded probability per class. Rows need no known label."""
    names = labels_of(model)
    scored = rows
    for stage in model.stages[1:]:
        scored = stage.transform(scored)
    listed = F.array(*[F.lit(n) for n in names])
    probability = vector_to_array("probability")
    keep = [c for c in rows.columns]
    return scored.select(
        *keep, F.get(listed, F.col("prediction").cast("int")).alias("prediction_label"), *[half_even(F.get(probability, F.lit(i)), 6).alias(f"p_{n}") for i, n in enumerate(names)]
    )


def score(name: str, train: DataFrame, test: DataFrame, matrix: Matrix, labels: Sequence[str] | None, settings: Settings) -> DataFrame:
    """One metric row of a model on test rows; the dummy always says the majority class."""
    if name == "dummy":
        majority = majority_baseline(train, "_label").select(F.col("majority").alias("prediction_label"))
        said = test.join(F.broadcast(majority))
    else:
        said = predict(fit(name, train, matrix, settings), test)
    counts = _small(confusion_counts(said, "_label", "prediction_label"))
    return _small(overall_metrics(counts, labels=labels).withColumn("model", F.lit(name)))


def compare_models(df: DataFrame, matrix: Matrix, settings: Settings = Settings(), labels: Sequence[str] | None = None) -> DataFrame:
    """Metric rows of every model on the same stratified split, best one marked."""
    train, test = two_way(df, matrix, settings.seed)
    rows = None
    for name in settings.models:
        row = score(name, train, test, matrix, labels, settings)
        rows = row if rows is None else rows.unionByName(row)
    best = best_model(rows)
    return rows.join(best).select("model", "rows", "accuracy", "macro_f1", "weighted_f1", (F.col("model") == F.col("selected_model")).alias("selected"))


def _small(df: DataFrame) -> DataFrame:
    """Metric rows or label counts, a handful per call, held as literals so that nothing is trained or scored twice."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def lies_spread(df: DataFrame) -> bool:
    """Whether rows lie in pieces enough to be trained on where they are; a table of few pieces is moved, or few cores train."""
    return 2 * df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism


def two_way(df: DataFrame, matrix: Matrix, seed: int, in_place: bool = False, keyed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Stratified train and test rows, split once and stored by split.

    The key takes most of the space; what needs it no more leaves it out (`keyed`).
    """
    rows = stratified_two_way(prepared(df, matrix), "_label", "_key", seed, in_place=in_place)
    return _by_split(rows.drop("split_warning", *([] if keyed else ["_key"])))


def _by_split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = stored(rows, "split", "split")
    return split.filter("split = 'train'"), split.filter("split = 'test'")


def learning_curve(df: DataFrame, matrix: Matrix, model: str = "random_forest", fractions: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0), settings: Settings = Settings()) -> DataFrame:
    """Train and validation scores over growing, class-balanced shares of the training rows."""
    rows = None
    with passing(df.sparkSession):
        in_place = lies_spread(df)
        train, held = two_way(df, matrix, settings.seed, in_place)
        for fraction in fractions:
            with passing(df.sparkSession):
                part = stratified_fraction(train, "_label", "_key", fraction, settings.seed + int(fraction * 1000), in_place)
                part = part if fraction >= 1.0 else stored(part.drop("_key"), "part")
                fitted = fit(model, part, matrix, settings)
                inside, outside = (overall_metrics(_small(confusion_counts(predict(fitted, d), "_label", "prediction_label"))) for d in (part, held))
                row = _small(inside.select(F.lit(fraction).alias("train_fraction"), F.col("rows").alias("train_size"), F.col("accuracy").alias("train_accuracy"), F.col("macro_f1").alias("train_macro_f1")).join(
                    outside.select(F.col("accuracy").alias("validation_accuracy"), F.col("macro_f1").alias("validation_macro_f1"))
                ))
            rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("macro_f1_gap", half_even(F.col("train_macro_f1") - F.col("validation_macro_f1"), 6))


def _skipped(spark: SparkSession, name: str, reason: str) -> DataFrame:
    return spark.createDataFrame([(name, "skipped", reason)], "name string, status string, reason string")


def ablation(df: DataFrame, variants: dict[str, tuple[Matrix, str | None]], settings: Settings = Settings(), model: str = "logistic_regression", source: str = "label_source") -> DataFrame:
    """One row per variant (columns, optional source filter); variants that cannot train say why."""
    done: dict[str, DataFrame] = {}
    alike: dict[tuple, list[str]] = {}
    for name, (matrix, only) in variants.items():
        alike.setdefault((only, matrix.label, matrix.key), []).append(name)
    # Variants of the same rows share one split, which holds the columns of all of them and is deleted after the last.
    for (only, label, key), names in alike.items():
        part = df if only is None else df.filter(F.col(source) == only)
        facts = part.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(f"`{label}`")).alias("k")).first()
        reason = "not_enough_rows" if facts["n"] < 4 else "single_class_dataset" if facts["k"] < 2 else None
        trained = [name for name in names if reason is None and variants[name][0].size]
        done |= {name: _skipped(df.sparkSession, name, reason or "no_features") for name in names if name not in trained}
        if not trained:
            continue
        with passing(df.sparkSession):
            parts = [variants[name][0] for name in trained]
            every = Matrix(list(dict.fromkeys(c for m in parts for c in m.numeric)), list(dict.fromkeys(c for m in parts for c in m.categorical)), label, key)
            train, test = two_way(part, every, settings.seed, lies_spread(part), keyed=False)
            for name, matrix in zip(trained, parts):
                done[name] = score(model, train, test, matrix, None, settings).select(F.lit(name).alias("name"), F.lit("ok").alias("status"), F.lit(matrix.size).alias("feature_count"), "accuracy", "macro_f1", "weighted_f1")
    rows = None
    for name in variants:
        rows = done[name] if rows is None else rows.unionByName(done[name], allowMissingColumns=True)
    return rows


def transfer(df: DataFrame, matrix: Matrix, sources: Sequence[str], settings: Settings = Settings(), model: str = "logistic_regression", source: str = "label_source") -> DataFrame:
    """Train on one source, test on another, for every ordered pair, with a reading of the score."""
    rows = None
    for a in sources:
        for b in sources:
            if a == b:
                continue
            train = stored(prepared(df.filter(F.col(source) == a), matrix), "train")
            test = prepared(df.filter(F.col(source) == b), matrix)
            row = score(model, train, test, matrix, None, settings).withColumn("name", F.lit(f"train_{a}_validate_{b}"))
            rows = row if rows is None else rows.unionByName(row)
    comment = (
        F.when((F.col("macro_f1") >= 0.98) & (F.col("accuracy") >= 0.98), "very_high_score_check_for_synthetic_simplicity_or_leakage")
        .when(F.col("macro_f1") < 0.65, "weak_generalization").otherwise("acceptable")
    )
    return rows.select("name", "rows", "accuracy", "macro_f1", comment.alias("comment"))


def vector_names(model: PipelineModel, matrix: Matrix) -> list[str]:
    """Names of the vector positions: numbers first, then feature=category."""
    names = list(matrix.numeric)
    indexers = [s for s in model.stages[1:] if hasattr(s, "labels")]
    for feature, indexer in zip(matrix.categorical, indexers):
        names += [f"{feature}={value}" for value in indexer.labels]
    return names


def top_coefficients(spark: SparkSession, model: PipelineModel, matrix: Matrix, k: int) -> DataFrame:
    """The k largest and smallest coefficients per class of a logistic model; the matrix of weights is tiny."""
    weights = model.stages[-1].coefficientMatrix.toArray()
    names, labels = vector_names(model, matrix), labels_of(model)
    rows = [(labels[i] if len(weights) > 1 else labels[-1], names[j], float(weights[i, j])) for i in range(len(weights)) for j in range(len(names))]
    from pyspark.sql import Window

    table = spark.createDataFrame(rows, "label string, feature string, coefficient double").withColumn("coefficient", half_even(F.col("coefficient"), 6))
    high = Window.partitionBy("label").orderBy(F.desc("coefficient"), "feature")
    low = Window.partitionBy("label").orderBy("coefficient", "feature")
    ranked = table.withColumns({"top_positive": F.row_number().over(high), "top_negative": F.row_number().over(low)})
    return ranked.filter((F.col("top_positive") <= k) | (F.col("top_negative") <= k))


def importances(spark: SparkSession, model: PipelineModel, matrix: Matrix, k: int) -> DataFrame:
    """Features of a forest by importance."""
    values = model.stages[-1].featureImportances.toArray()
    table = spark.createDataFrame([(n, float(v)) for n, v in zip(vector_names(model, matrix), values)], "feature string, importance double")
    return table.withColumn("importance", half_even(F.col("importance"), 8)).orderBy(F.desc("importance"), "feature").limit(k)
