"""Boosted regression trees on cells: many fits, settings and folds, over one aggregate of the rows.

Trees cut features at bin edges, so rows with the same bins always end in the same leaf, and for squared errors their number and sum
of targets say all that a tree can learn from them. One aggregate by fold and bins replaces the rows; "all folds but mine" is
the total less the fold. Each fit (settings, held-out fold) is a group of cells that Spark deals to a task, and all fits run at once.

An ensemble of 400 rounds begins with the one of 200, so settings that differ in rounds only are one fit that is scored at both.
Squared errors need no second look at the rows either: they follow from each cell's count, sum and sum of squares.

The number of cells is counted first. Up to ``MOST_CELLS`` of them a fit takes a few megabytes whatever the rows; beyond that, where many
wide features leave cells of one row each, ``CellBoosting`` goes over to Spark's own boosting on the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable, stage
from .ranking import value_positions

MOST_CELLS = 1 << 20
BINS = 32


@dataclass(frozen=True)
class BoostSettings:
    """Least squares boosting that starts from the mean; trees take the split that lowers the squared error most, wherever it is."""

    rounds: int = 100
    step: float = 0.1
    leaves: int = 31  # 0: no limit but the depth
    depth: int = 0  # 0: no limit but the leaves
    min_rows: int = 20
    l2: float = 0.0  # added to the rows of a leaf, which pulls its value towards 0


class TooManyCells(ValueError):
    """The features' bins meet in more combinations than a fit may hold."""


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Inner edges of each feature: the values at every ``1 / bins`` of all rows, each once. A bin starts at its edge.

    Values are counted before they are put in order, and of the order only the rows that hold an edge come to the driver.
    """
    pairs = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in features]
    placed = value_positions(df.select(F.inline(F.array(*pairs))), ["_column"], "_value")
    last = F.greatest(F.col("total") - 1, F.lit(1))
    first = F.greatest(F.ceil(F.col("before") * bins / last), F.lit(1))
    end = F.least(F.ceil((F.col("before") + F.col("n")) * bins / last), F.lit(bins))  # places from the first to before this one
    found = placed.filter(first < end).select("_column", "_value").collect()
    return {c: sorted(r["_value"] for r in found if r["_column"] == c) for c in features}


def binned(df: DataFrame, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """Append ``bin_<feature>``; NULL has a bin of its own, the lowest."""
    return df.withColumns({f"bin_{c}": F.when(F.col(c).isNull(), 0).otherwise(1 + _bin(F.col(c), e)) for c, e in edges.items()})


def _bin(value: Column, edges: Sequence[float]) -> Column:
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.lit([float(e) for e in edges]), lambda e: e <= value.cast("double")))


def cell_table(df: DataFrame, edges: Mapping[str, Sequence[float]], target: str, fold: str) -> DataFrame:
    """``fold, bin_…, n, s, ss``: rows, sum and sum of squares of the target; written once. Rows without target or fold are left out."""
    y = F.col(target).cast("double")
    known = binned(df.filter(F.col(target).isNotNull() & F.col(fold).isNotNull()), edges)
    keys = [f"bin_{c}" for c in edges]
    cells = known.groupBy(F.col(fold).cast("int").alias("fold"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss"))
    return stage(cells, "boost-cells")


def _tree(codes: np.ndarray, width: int, n: np.ndarray, r: np.ndarray, setting: BoostSettings) -> np.ndarray:
    """The leaf values of one tree at every cell, grown best split first; ``r`` are sums of residuals.

    ``codes`` has a row per feature, its bins counted on from ``width`` times its number. Ties go to the first feature, then the lowest edge.
    """
    features, cells = codes.shape
    least = 1e-12 * max(1.0, float(np.abs(r).sum()))

    def histogram(at: np.ndarray) -> np.ndarray:
        flat = codes[:, at].ravel()
        both = [np.bincount(flat, np.broadcast_to(w[at], (features, len(at))).ravel(), features * width) for w in (n, r)]
        return np.stack(both).reshape(2, features, width)

    def best(hist: np.ndarray, depth: int) -> tuple[float, int, int] | None:
        if width < 2 or (setting.depth and depth >= setting.depth):
            return None
        left_n, left_r = hist.cumsum(axis=2)[:, :, :-1]
        all_n, all_r = hist[:, 0].sum(axis=1)
        right_n, right_r = all_n - left_n, all_r - left_r
        enough = max(setting.min_rows, 1) - 1e-9
        allowed = (left_n >= enough) & (right_n >= enough)
        gain = left_r**2 / np.where(allowed, left_n + setting.l2, 1) + right_r**2 / np.where(allowed, right_n + setting.l2, 1)
        gain = np.where(allowed, gain - all_r**2 / max(all_n + setting.l2, 1e-300), -np.inf).ravel()
        top = int(gain.argmax())
        return (float(gain[top]), top // (width - 1), top % (width - 1)) if gain[top] > least else None

    whole = np.arange(cells)
    start = histogram(whole)
    done, waiting, count = [], [], 1
    split = best(start, 0)
    (waiting if split else done).append((split, whole, start, 0) if split else (whole, start))
    while waiting and (not setting.leaves or count < setting.leaves):
        k = max(range(len(waiting)), key=lambda i: (waiting[i][0][0], -i))
        (_, feature, edge), at, hist, depth = waiting.pop(k)
        goes_right = codes[feature, at] - feature * width > edge
        sides = [at[~goes_right], at[goes_right]]
        small = int(len(sides[1]) < len(sides[0]))
        hists = [None, None]
        hists[small] = histogram(sides[small])
        hists[1 - small] = hist - hists[small]
        count += 1
        for side, h in zip(sides, hists, strict=True):
            split = best(h, depth + 1)
            (waiting if split else done).append((split, side, h, depth + 1) if split else (side, h))
    value = np.empty(cells)
    for at, hist in [*done, *[(w[1], w[2]) for w in waiting]]:
        rows, total = hist[:, 0].sum(axis=1)
        value[at] = total / (rows + setting.l2) if rows > 0.5 else 0.0
    return value


def boosted_cells(
    bins: np.ndarray, n: np.ndarray, s: np.ndarray, settings: BoostSettings, at_rounds: Sequence[int]
) -> list[np.ndarray]:
    """Predictions at every cell after each number of rounds in ``at_rounds``. Cells with ``n`` 0 are predicted, not learned from."""
    width = int(bins.max()) + 1
    codes = bins + width * np.arange(len(bins))[:, None]
    total = n.sum()
    value = np.full(len(n), s.sum() / total if total else 0.0)
    out, wanted = {0: value}, set(at_rounds)
    for k in range(1, max(at_rounds, default=0) + 1):
        value = value + settings.step * _tree(codes, width, n, s - n * value, settings)
        if k in wanted:
            out[k] = value
    return [out[k] for k in at_rounds]


def fold_predictions(cells: DataFrame, features: Sequence[str], settings: Mapping[str, BoostSettings], folds: Sequence[int]) -> DataFrame:
    """``name, held, bin_…, prediction``: what each setting, fitted without the fold ``held``, answers in every cell of the table.

    A fold that no row has, such as -1, holds nothing out. Settings that are equal but for ``rounds`` are one fit.
    """
    keys = [f"bin_{c}" for c in features]
    whole = cells.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    whole = stage(whole, "boost-totals")
    n_cells = whole.count()
    if n_cells > MOST_CELLS:
        raise TooManyCells(f"{n_cells} cells; at most {MOST_CELLS} may go to one fit")
    alike: dict[BoostSettings, dict[str, int]] = {}
    for name, setting in settings.items():
        alike.setdefault(replace(setting, rounds=0), {})[name] = setting.rounds
    fits = [(i, int(f)) for i in range(len(alike)) for f in folds]
    table = list(alike.items())
    jobs = cells.sparkSession.createDataFrame(fits, "fit int, held int")
    each = whole.select("*", F.explode(F.lit([f for f in folds])).alias("held"))
    own = cells.select(F.col("fold").alias("own_fold"), *[F.col(k).alias(f"own_{k}") for k in keys], F.col("n").alias("own_n"), F.col("s").alias("own_s"))
    same = [F.col("held") == F.col("own_fold"), *[F.col(k) == F.col(f"own_{k}") for k in keys]]
    zero = F.lit(0)
    train = each.join(own, same, "left").select(
        "held", *keys, (F.col("all_n") - F.coalesce("own_n", zero)).cast("double").alias("n"), (F.col("all_s") - F.coalesce("own_s", zero)).alias("s")
    )
    dealt = importable(train).join(F.broadcast(jobs), "held")  # a row per fit

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        setting, names = table[int(pdf["fit"].iloc[0])]
        pdf = pdf.sort_values(keys)  # sums of doubles in one order, whatever the shuffle
        columns = np.stack([pdf[k].to_numpy(np.int64) for k in keys])
        n = pdf["n"].to_numpy(float)
        rounds = sorted(set(names.values()))
        found = dict(zip(rounds, boosted_cells(columns, n, np.where(n > 0, pdf["s"].to_numpy(float), 0.0), setting, rounds), strict=True))
        parts = [pdf[["held", *keys]].assign(name=name, prediction=found[r]) for name, r in names.items()]
        return pd.concat(parts)[["name", "held", *keys, "prediction"]]

    schema = "name string, held int, " + ", ".join(f"{k} int" for k in keys) + ", prediction double"
    return stage(dealt.groupBy("fit", "held").applyInPandas(fit, schema), "boost-predictions")


def fold_errors(cells: DataFrame, predictions: DataFrame, features: Sequence[str]) -> DataFrame:
    """``name, fold, n, rmse, r2`` of each fold under the fit that held it out, from the cells alone."""
    keys = [f"bin_{c}" for c in features]
    p = F.col("prediction")
    met = cells.join(predictions.withColumnRenamed("held", "fold"), ["fold", *keys])
    sums = met.groupBy("name", "fold").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("ss") - 2 * p * F.col("s") + p * p * F.col("n")).alias("sse")
    )
    spread = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return sums.select("name", "fold", "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (1 - F.try_divide("sse", spread)).alias("r2"))


def boosted_grid(
    df: DataFrame, features: Sequence[str], target: str, settings: Mapping[str, BoostSettings], search_fold: str, search_folds: int,
    score_fold: str, score_folds: int, bins: int = BINS,
) -> tuple[DataFrame, dict]:
    """Every setting's mean R² over the search folds, and the best one's over the other folds.

    The table has a row per setting: its values, ``cv_r2_mean, cv_r2_std``. Equal scores: the first setting wins.
    """
    edges = bin_edges(df, features, bins)
    cells = cell_table(df, edges, target, search_fold)
    predicted = fold_predictions(cells, features, settings, range(search_folds))
    scores = fold_errors(cells, predicted, features).groupBy("name").agg(F.avg("r2").alias("cv_r2_mean"), F.stddev_pop("r2").alias("cv_r2_std"))
    found = {r.name: r for r in scores.collect()}  # one row per setting
    names = list(settings)
    best = max(names, key=lambda n: (found[n].cv_r2_mean, -names.index(n)))
    honest_cells = cell_table(df, edges, target, score_fold)
    honest = fold_errors(honest_cells, fold_predictions(honest_cells, features, {best: settings[best]}, range(score_folds)), features)
    row = honest.agg(F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std")).first()
    table = df.sparkSession.createDataFrame(
        [(n, s.rounds, s.step, s.leaves, s.depth, s.min_rows, s.l2, found[n].cv_r2_mean, found[n].cv_r2_std) for n, s in settings.items()],
        "name string, rounds int, step double, leaves int, depth int, min_rows int, l2 double, cv_r2_mean double, cv_r2_std double",
    )
    return table, {"name": best, **asdict(settings[best]), "r2_mean": row.r2_mean, "r2_std": row.r2_std}


def boosted_rows(df: DataFrame, features: Sequence[str], target: str, setting: BoostSettings, fold: str, folds: Sequence[int], bins: int = BINS) -> DataFrame:
    """``df`` with ``prediction``, each row's by the fit that held its fold out; edges come from all rows' features, never from targets."""
    edges = bin_edges(df, features, bins)
    cells = cell_table(df, edges, target, fold)
    keys = [f"bin_{c}" for c in features]
    answers = fold_predictions(cells, features, {"one": setting}, folds).select(F.col("held").alias("_held"), *[F.col(k).alias(f"_{k}") for k in keys], "prediction")
    same = [F.col(fold) == F.col("_held"), *[F.col(k) == F.col(f"_{k}") for k in keys]]
    return binned(df, edges).join(answers, same).select(*df.columns, "prediction")


@dataclass(frozen=True)
class CellBoosting:
    """Boosted trees on some columns as a model that is scored on held-out folds."""

    features: tuple[str, ...]
    target: str
    settings: BoostSettings = BoostSettings()
    bins: int = BINS

    def held_out(self, df: DataFrame, fold: str, folds: Sequence[int]) -> DataFrame:
        """The rows of ``folds`` with the prediction of the fit that held their fold out."""
        try:
            return boosted_rows(df, self.features, self.target, self.settings, fold, folds, self.bins)
        except TooManyCells:
            return self._on_rows(df, fold, folds)

    def _on_rows(self, df: DataFrame, fold: str, folds: Sequence[int]) -> DataFrame:
        s = self.settings
        vector = VectorAssembler(inputCols=list(self.features), outputCol="_vector", handleInvalid="keep")
        depth = s.depth or max(1, (s.leaves - 1).bit_length())
        trees = GBTRegressor(
            featuresCol="_vector", labelCol=self.target, seed=42, maxDepth=depth, maxIter=s.rounds, stepSize=s.step, minInstancesPerNode=max(1, s.min_rows), maxBins=self.bins
        )
        vectors = stage(vector.transform(df), "boost-vectors")  # read by every round
        parts = [trees.fit(vectors.filter(F.col(fold) != f)).transform(vectors.filter(F.col(fold) == f)).select(*df.columns, "prediction") for f in folds]
        return reduce(DataFrame.unionByName, parts)
