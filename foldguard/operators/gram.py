"""Linear models of any columns, folds and row sets from one scan.

A Gram matrix holds the sums of products of all columns, with a column of ones in front. It is additive over rows, so one matrix per fold is
all that cross-validation needs: "all folds but mine" is the total less mine, a column set is a submatrix, another
assignment of rows to folds is another set of matrices from the same scan, and a row set is an assignment that
leaves rows out. Fits are solves of the size of the column set, and squared errors on the held-out fold follow
from its matrix, so neither fits nor R² read the rows again. Absolute errors need one more scan, for all models at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import regression_metrics

_PARTIAL = "label int, fold int, i int, j int, value double"


@dataclass(frozen=True)
class FoldGrams:
    """Per label and fold the matrix of ``1, columns``; its first entry is the number of rows."""

    columns: tuple[str, ...]
    matrices: Mapping[tuple[str, int], np.ndarray]

    def folds(self, label: str) -> list[int]:
        return sorted(f for name, f in self.matrices if name == label)

    def of(self, label: str, fold: int) -> np.ndarray:
        size = len(self.columns) + 1
        return self.matrices.get((label, fold), np.zeros((size, size)))

    def without(self, label: str, fold: int | None) -> np.ndarray:
        """The rows of all folds but one; ``None`` leaves none out."""
        size = len(self.columns) + 1
        return sum((m for (name, f), m in self.matrices.items() if name == label and f != fold), np.zeros((size, size)))

    def at(self, names: Sequence[str]) -> list[int]:
        return [self.columns.index(c) + 1 for c in names]


def fold_grams(df: DataFrame, columns: Sequence[str], labels: Mapping[str, Column]) -> FoldGrams:
    """One scan. ``labels`` gives each row its fold under each assignment; NULL leaves the row out of it.

    Rows with a NULL in one of the columns are left out of all. The driver sees a matrix per assignment and fold.
    """
    names = list(labels)
    used = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)], *[labels[n].cast("int").alias(f"f{i}") for i, n in enumerate(names)])
    size = len(columns) + 1
    upper = np.triu_indices(size)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *[c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[: len(columns)]]], axis=1)
            known = ~np.isnan(x).any(axis=1)
            for label in range(len(names)):
                column = batch.column(len(columns) + label)
                has = known & ~column.is_null().to_numpy(zero_copy_only=False)
                fold = column.fill_null(0).to_numpy(zero_copy_only=False)
                for f in np.unique(fold[has]):
                    rows = x[has & (fold == f)]
                    key = (label, int(f))
                    sums[key] = sums.get(key, 0.0) + rows.T @ rows
        n = len(upper[0])
        for (label, f), m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, label, np.int32)), pa.array(np.full(n, f, np.int32)), *[pa.array(u.astype(np.int32)) for u in upper], pa.array(m[upper])],
                ["label", "fold", "i", "j", "value"],
            )

    summed = used.mapInArrow(partial, _PARTIAL).groupBy("label", "fold", "i", "j").agg(F.sum("value").alias("value")).collect()
    matrices: dict[tuple[str, int], np.ndarray] = {}
    for r in summed:
        m = matrices.setdefault((names[r.label], r.fold), np.zeros((size, size)))
        m[r.i, r.j] = m[r.j, r.i] = r.value
    return FoldGrams(tuple(columns), matrices)


def solved(matrix: np.ndarray, x: Sequence[int], y: int, penalty: float = 0.0) -> np.ndarray:
    """Intercept and weights of ``y`` on the columns ``x``; columns that add nothing get the least weights.

    ``penalty`` is that of a ridge on columns scaled to mean 0 and standard deviation 1.
    """
    n = matrix[0, 0]
    if n == 0:
        return np.zeros(len(x) + 1)
    mean = matrix[0] / n
    spread = matrix - n * np.outer(mean, mean)
    s = spread[np.ix_(x, x)]
    scale = np.sqrt(np.maximum(np.diag(s), 0) / n)
    scale[scale <= 1e-12 * np.maximum(np.abs(mean[x]), 1e-300)] = 0.0
    usable = np.where(scale > 0, scale, 1.0)
    z = s / np.outer(usable, usable) + penalty * np.eye(len(x))
    target = np.where(scale > 0, spread[x, y] / usable, 0.0)
    w = np.linalg.lstsq(z, target, rcond=1e-12)[0] / usable
    return np.concatenate([[mean[y] - w @ mean[x]], w])


def errors(matrix: np.ndarray, x: Sequence[int], y: int, weights: np.ndarray) -> dict[str, float]:
    """``n, rmse, r2`` of a linear model on the rows of a matrix."""
    n = matrix[0, 0]
    if n == 0:
        return {"n": 0, "rmse": None, "r2": None}
    at = [0, *x, y]
    v = np.append(weights, -1.0)
    sse = max(float(v @ matrix[np.ix_(at, at)] @ v), 0.0)
    total = float(matrix[y, y] - matrix[0, y] ** 2 / n)
    return {"n": int(n), "rmse": float(np.sqrt(sse / n)), "r2": 1 - sse / total if total > 0 else None}


@dataclass(frozen=True)
class LinearModel:
    """One model: its columns, the assignment whose folds it is held out from, and the ridge penalty."""

    features: tuple[str, ...]
    label: str
    penalty: float = 0.0


def held_out_weights(grams: FoldGrams, model: LinearModel, target: str, folds: Sequence[int]) -> dict[int, np.ndarray]:
    x, (y,) = grams.at(model.features), grams.at([target])
    return {f: solved(grams.without(model.label, f), x, y, model.penalty) for f in folds}


def fold_scores(spark, grams: FoldGrams, models: Mapping[str, LinearModel], target: str, folds: Sequence[int]) -> DataFrame:
    """``name, fold, n, rmse, r2``: each model on each fold, fitted without it. Reads no rows."""
    (y,) = grams.at([target])
    out = []
    for name, model in models.items():
        x = grams.at(model.features)
        for f, w in held_out_weights(grams, model, target, folds).items():
            e = errors(grams.of(model.label, f), x, y, w)
            out.append((name, int(f), e["n"], e["rmse"], e["r2"]))
    return spark.createDataFrame(out, "name string, fold int, n bigint, rmse double, r2 double")


def spread_over_folds(scores: DataFrame) -> DataFrame:
    """Per name the mean and population standard deviation of what is measured per fold, and the rows in all."""
    measured = [c for c in ("mae", "rmse", "r2") if c in scores.columns]
    return scores.groupBy("name").agg(
        F.sum("n").alias("n_rows"), *[f(c).alias(f"{c}_{s}") for c in measured for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    )


def linear(weights: Mapping[int, np.ndarray], features: Sequence[str], fold: Column) -> Column:
    """A row's prediction by the weights of its fold; NULL where there are none for it."""
    folds = sorted(weights)
    place = F.array_position(F.lit([int(f) for f in folds]), fold.cast("int")).cast("int")

    def weight(i: int) -> Column:
        return F.get(F.lit([float(weights[f][i]) for f in folds]), place - 1)

    out = weight(0)
    for i, c in enumerate(features, 1):
        out = out + weight(i) * F.col(c)
    return out


def row_scores(
    df: DataFrame, grams: FoldGrams, models: Mapping[str, LinearModel], labels: Mapping[str, Column], target: str, folds: Mapping[str, Sequence[int]]
) -> DataFrame:
    """``name, fold, n, mae, rmse, r2`` from the rows: one scan for all models. ``folds`` says which folds of a label are scored."""
    parts = []
    for name, model in models.items():
        label = labels[model.label]
        p = linear(held_out_weights(grams, model, target, folds[model.label]), model.features, label)
        parts.append(F.struct(F.lit(name).alias("name"), label.cast("int").alias("fold"), p.alias("p")))
    rows = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*parts)).alias("m")).select("y", "m.*")
    return regression_metrics(rows.filter("p IS NOT NULL"), "y", "p", ["name", "fold"])


def split_inflation(scores: DataFrame, random: str, group: str) -> DataFrame:
    """How much better a model looks where rows of a group are on both sides: mean R² of ``random`` less that of ``group``."""
    means = scores.groupBy().agg(
        *[f(F.when(F.col("name") == n, F.col("r2"))).alias(f"{k}_r2_{s}") for k, n in (("random", random), ("group", group)) for f, s in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    )
    return means.withColumn("inflation", F.col("random_r2_mean") - F.col("group_r2_mean"))
