"""Learning jobs on Spark ML with group-safe folds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_md5
from ..session import stage
from .boosting import BoostSettings, CellBoosting
from .forest import MOST_CELLS, CellForest, Growth, grid_of, grown_trees
from .metrics import metrics_over_folds, one_row, regression_metrics
from .ranking import global_rank

PREDICTION = "prediction"
#: Trees that a forest grows at a time: at least so many, and more while rows times trees stay below this. Spark keeps a number for each.
TREES_AT_ONCE, KEPT_DRAWS = 10, 32_000_000
#: Rows from which a forest grows on cells.
CELL_ROWS = 1 << 16


class ForestOfGroups(Model):
    """Forests over the same columns as one: the mean over all their trees."""

    def __init__(self, groups: Sequence[Model], prediction: str):
        super().__init__()
        self.groups, self.prediction = list(groups), prediction

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = [f"_group_{i}" for i in range(len(self.groups))]
        out = reduce(lambda rows, at: at[1].setPredictionCol(at[0]).transform(rows), zip(names, self.groups, strict=True), dataset)
        total = reduce(lambda a, b: a + b, [F.col(c) * g.getNumTrees for c, g in zip(names, self.groups, strict=True)])
        return out.withColumn(self.prediction, total / sum(g.getNumTrees for g in self.groups)).drop(*names)


class GroupedForest(RandomForestRegressor):
    """Spark's forest, grown a few trees at a time: what a fit keeps of the rows does not grow with the number of trees.

    Spark looks at every row at every level of every tree. From ``CELL_ROWS`` rows on the same trees grow on cells instead, if those are few enough.
    """

    def _fit(self, dataset: DataFrame) -> Model:
        trees, rows = self.getNumTrees(), dataset.count()
        if rows >= CELL_ROWS and (model := self._on_cells(dataset)):
            return model
        at_once = max(TREES_AT_ONCE, KEPT_DRAWS // max(1, rows))
        count = max(1, -(-trees // at_once))
        count = min(count, max(1, trees // 2))  # no group of one tree: Spark draws no rows for it
        sizes = [trees // count + (i < trees % count) for i in range(count)]
        groups = [RandomForestRegressor._fit(self.copy({self.numTrees: n, self.seed: self.getSeed() + i}), dataset) for i, n in enumerate(sizes)]
        return ForestOfGroups(groups, self.getPredictionCol()) if count > 1 else groups[0]

    def _on_cells(self, dataset: DataFrame) -> Model | None:
        """The forest on cells; None where it is not one: other settings than these, values that Spark refuses, too many cells."""
        plain = {self.subsamplingRate: 1.0, self.bootstrap: True, self.featureSubsetStrategy: "auto", self.minWeightFractionPerNode: 0.0, self.leafCol: ""}
        if any(self.getOrDefault(p) != v for p, v in plain.items()) or (self.isDefined(self.weightCol) and self.getWeightCol()):
            return None
        if "nominal" in dataset.schema[self.getFeaturesCol()].metadata.get("ml_attr", {}).get("attrs", {}):
            return None
        vector = F.col(self.getFeaturesCol())
        found = dataset.select(vector_to_array(vector).alias("_x"), F.col(self.getLabelCol()).cast("double").alias("_y"))
        features = found.select(F.max(F.size("_x"))).first()[0]
        grid = grid_of(found, features, self.getMaxBins()) if features and features > 0 else None
        if grid is None or grid.cells > MOST_CELLS:
            return None
        growth = Growth(self.getMaxDepth(), self.getMinInstancesPerNode(), self.getMinInfoGain())
        return CellForest(grid, grown_trees(found, grid, self.getNumTrees(), self.getSeed(), growth), self.getFeaturesCol(), self.getPredictionCol())


def model_registry(
    features: Sequence[str], target: str, rows: int, seed: int = 42, trees: int = 300, rounds: int = 500
) -> dict[str, Pipeline | CellBoosting]:
    """Named models over plain columns: scaled ridge, forest, boosted trees.

    The ridge penalty of 1 on summed squares is ``1 / rows`` in Spark's averaged loss.
    """
    assemble = VectorAssembler(inputCols=list(features), outputCol="_vector", handleInvalid="error")
    scale = StandardScaler(inputCol="_vector", outputCol="_scaled", withMean=True, withStd=True)
    ridge = LinearRegression(
        featuresCol="_scaled", labelCol=target, elasticNetParam=0.0, regParam=1.0 / max(1, rows), standardization=False
    )
    forest = GroupedForest(featuresCol="_vector", labelCol=target, seed=seed, maxDepth=6, numTrees=trees)
    return {
        "ridge": Pipeline(stages=[assemble, scale, ridge]),
        "forest": Pipeline(stages=[assemble, forest]),
        "boosting": CellBoosting(tuple(features), target, BoostSettings(rounds=rounds, step=0.05, leaves=0, depth=6, min_rows=1)),
    }


def least_squares(features: Sequence[str], target: str) -> Pipeline:
    """Unpenalised linear regression over plain columns."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="_vector", handleInvalid="error")
    return Pipeline(stages=[assemble, LinearRegression(featuresCol="_vector", labelCol=target, solver="normal")])


def out_of_fold(
    df: DataFrame, estimator: Estimator | CellBoosting, fold: str, folds: int | Sequence[int],
    prepare: Callable[[DataFrame, int], DataFrame] | None = None, parallelism: int = 4,
) -> DataFrame:
    """Predict each row by a model that was fitted without its fold.

    ``prepare(rows, f)`` may preprocess the rows for the model of fold ``f``. Several folds are fitted at a time.
    """
    numbers = list(range(folds)) if isinstance(folds, int) else list(folds)
    if isinstance(estimator, CellBoosting):
        return estimator.held_out(df, fold, numbers)

    def one(f: int) -> DataFrame:
        rows = df if prepare is None else prepare(df, f)
        model = estimator.fit(rows.filter(F.col(fold) != f))
        return model.transform(rows.filter(F.col(fold) == f)).select(*df.columns, PREDICTION)

    with ThreadPool(max(1, min(parallelism, len(numbers)))) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(one), numbers, 1)
    return reduce(DataFrame.unionByName, parts)


def fold_scores(df: DataFrame, estimator: Estimator, target: str, fold: str, folds: int) -> DataFrame:
    return regression_metrics(out_of_fold(df, estimator, fold, folds), target, PREDICTION, [fold])


def cross_validated(df: DataFrame, estimators: Mapping[str, Estimator], target: str, fold: str, folds: int) -> DataFrame:
    """Mean and spread of the metrics over the folds, one row per named estimator."""
    out = None
    for name, estimator in estimators.items():
        row = metrics_over_folds(fold_scores(df, estimator, target, fold, folds)).withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(
    df: DataFrame, estimators: Mapping[str, Estimator | CellBoosting], target: str, fold: str, folds: int, split: str
) -> tuple[DataFrame, str]:
    """Cross-validated and holdout metrics side by side, and the model with the best CV R²."""
    cv = cross_validated(df, estimators, target, fold, folds)
    sides = df.withColumn("_side", F.when(F.col(split) == "test", 0).when(F.col(split) == "train", 1))
    held = None
    for name, estimator in estimators.items():
        scored = out_of_fold(sides, estimator, "_side", [0])  # the test side is the fold that is held out
        row = regression_metrics(scored, target, PREDICTION).select(
            F.lit(name).alias("model"), F.col("mae").alias("holdout_mae"),
            F.col("rmse").alias("holdout_rmse"), F.col("r2").alias("holdout_r2"),
        )
        held = row if held is None else held.unionByName(row)
    table = stage(cv.join(held, "model"), "model-comparison")
    best = table.orderBy(F.desc("r2_mean"), "model").select("model").first()["model"]
    return table, best


def grid_search(
    df: DataFrame, factory: Callable[..., Estimator], grid: Mapping[str, Sequence], target: str,
    search_fold: str, search_folds: int, score_fold: str, score_folds: int, parallelism: int = 4,
) -> tuple[DataFrame, dict]:
    """Try every combination on the search folds, several at a time, then score the best again on the other folds."""
    spark = df.sparkSession

    def tried(values: tuple) -> tuple:
        score = metrics_over_folds(fold_scores(df, factory(**dict(zip(grid, values))), target, search_fold, search_folds)).first()
        return (*[float(v) for v in values], score["r2_mean"], score["r2_std"])

    with ThreadPool(parallelism) as pool:
        rows = pool.map(inheritable_thread_target(spark)(tried), list(product(*grid.values())), 1)
    best = max(range(len(rows)), key=lambda i: (rows[i][-2], -i))
    chosen = dict(zip(grid, list(product(*grid.values()))[best]))
    honest = metrics_over_folds(fold_scores(df, factory(**chosen), target, score_fold, score_folds)).first()
    schema = ", ".join(f"{k} double" for k in grid) + ", cv_r2_mean double, cv_r2_std double"
    table = spark.createDataFrame(rows, schema)
    return table, {**chosen, "r2_mean": honest["r2_mean"], "r2_std": honest["r2_std"]}


def cross_validator(
    estimator: Pipeline, stage_estimator: Estimator, grid: Mapping[str, Sequence], target: str, fold: str,
    folds: int, parallelism: int = 4,
) -> CrossValidator:
    """The same search as one Spark ML estimator with user-given folds, run in parallel."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage_estimator.getParam(name), list(values))
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=builder.build(),
        evaluator=RegressionEvaluator(labelCol=target, metricName="r2"),
        numFolds=folds, foldCol=fold, parallelism=parallelism,
    )


def score_scopes(
    df: DataFrame, scopes: Mapping[str, Sequence[str]], make: Callable[[Sequence[str]], Estimator],
    target: str, fold: str, folds: int,
) -> DataFrame:
    """Cross-validated scores of one kind of model on several column sets.

    Serves scope ladders, leakage on/off, ablations and any other "same model, other columns".
    """
    out = None
    for name, features in scopes.items():
        row = metrics_over_folds(fold_scores(df, make(features), target, fold, folds)).withColumns(
            {"scope": F.lit(name), "n_features": F.lit(len(features))}
        )
        out = row if out is None else out.unionByName(row)
    return out


def score_subsets(
    subsets: Mapping[str, DataFrame], estimator: Estimator, target: str, fold: str, folds: int
) -> DataFrame:
    """Cross-validated scores of one model on several row sets."""
    out = None
    for name, rows in subsets.items():
        per_fold = fold_scores(rows, estimator, target, fold, folds)
        row = one_row(metrics_over_folds(per_fold), per_fold.agg(F.sum("n").alias("n_rows"))).withColumn(
            "subset", F.lit(name)
        )
        out = row if out is None else out.unionByName(row)
    return out


def linear_attribution(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Mean absolute contribution ``|w · (x - mean)|`` per column of a linear model, largest first."""
    means = df.agg(*[F.avg(c).alias(c) for c in weights]).first()
    wide = df.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(means[c])))).alias(c) for c, w in weights.items()])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean_abs_contribution")) for c in weights]
    return wide.select(F.inline(F.array(*rows))).orderBy(F.desc("mean_abs_contribution"), "feature")


def in_random_order(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``df`` with each row's place ``_rank`` in a hash order."""
    return global_rank(df.withColumn("_o", seeded_md5(seed, F.col(key))), ["_o", key], "_rank").drop("_o")


def permuted(df: DataFrame, ordered: DataFrame, key: str, column: str, seed: int = 42) -> DataFrame:
    """One column shuffled among the rows: a second hash order of its values, joined on the rank."""
    values = global_rank(
        df.select(F.col(key).alias("_key"), F.col(column).alias("_value")).withColumn(
            "_o", seeded_md5(f"{seed}|{column}", F.col("_key"))
        ),
        ["_o", "_key"],
        "_rank",
    )
    return ordered.join(values.select("_rank", "_value"), "_rank").withColumn(column, F.col("_value")).select(*df.columns)


def permutation_importance(
    df: DataFrame, model: Model, features: Sequence[str], target: str, key: str, seed: int = 42
) -> DataFrame:
    """Rise of the mean squared error when one column is shuffled, per column, largest first."""

    def error(rows: DataFrame, name: str) -> DataFrame:
        scored = model.transform(rows)
        return scored.agg(F.avg(F.pow(F.col(target) - F.col(PREDICTION), F.lit(2.0))).alias(name))

    base = error(df, "mse").first()["mse"]
    ordered = in_random_order(df, key, seed)
    out = None
    for c in features:
        row = error(permuted(df, ordered, key, c, seed), "mse").select(
            F.lit(c).alias("feature"), (F.col("mse") - F.lit(base)).alias("mse_increase")
        )
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("mse_increase"), "feature")


def refit_and_rescore(df: DataFrame, estimator: Estimator, candidates: DataFrame) -> DataFrame:
    """Fit on all rows and score the candidates again."""
    return estimator.fit(df).transform(candidates)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
