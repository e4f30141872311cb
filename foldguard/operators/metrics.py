"""Prediction quality: per fold, per group, against baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles


def abs_error(y: str, p: str) -> Column:
    return F.abs(F.col(y) - F.col(p))


def signed_error(y: str, p: str) -> Column:
    return F.col(p) - F.col(y)


def metric_columns(y: str, p: str, where: Column | None = None) -> list[Column]:
    """``n``, ``mae``, ``rmse`` and ``r2`` as aggregates, optionally over a row mask."""

    def only(c: Column) -> Column:
        return c if where is None else F.when(where, c)

    square = F.pow(F.col(y) - F.col(p), F.lit(2.0))
    return [
        F.count(only(F.col(y))).alias("n"),
        F.avg(only(abs_error(y, p))).alias("mae"),
        F.sqrt(F.avg(only(square))).alias("rmse"),
        (1 - F.try_divide(F.avg(only(square)), F.var_pop(only(F.col(y))))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One row of metrics per ``by`` group (one row in all without it); one pass."""
    return df.groupBy(*by).agg(*metric_columns(y, p))


def metrics_over_folds(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population standard deviation of each metric over the folds."""
    out = []
    for m in ("mae", "rmse", "r2"):
        out += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return per_fold.groupBy(*by).agg(*out)


def tolerance_shares(df: DataFrame, y: str, p: str, limits: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose error is at most each limit."""
    err = abs_error(y, p)
    return df.groupBy(*by).agg(
        *[F.avg((err <= t).cast("double")).alias(f"share_within_{t:g}".replace(".", "_")) for t in limits]
    )


def leave_one_out(per_fold: DataFrame, fold: str, cols: Sequence[str]) -> DataFrame:
    """For each fold the sum of ``cols`` over the other folds (one row per fold in and out)."""
    packed = per_fold.agg(F.collect_list(F.struct(fold, *cols)).alias("_all"))  # one entry per fold

    def others(c: str) -> Column:
        rest = F.filter("_all", lambda x: ~x[fold].eqNullSafe(F.col(f"_f.{fold}")))
        return F.aggregate(rest, F.lit(0.0), lambda acc, x: acc + x[c])

    return packed.select(F.explode("_all").alias("_f"), "_all").select(
        F.col(f"_f.{fold}").alias(fold), *[others(c).alias(c) for c in cols]
    )


def with_training_mean(df: DataFrame, y: str, fold: str, out: str = "baseline") -> DataFrame:
    """Append the mean target of all rows outside the row's fold (total minus fold)."""
    sums = df.groupBy(fold).agg(
        F.sum(y).alias("_s"), F.count(y).cast("double").alias("_n")
    )
    means = leave_one_out(sums, fold, ["_s", "_n"]).select(fold, F.try_divide("_s", "_n").alias(out))
    means = means.withColumnRenamed(fold, "_fold")  # one row per fold; rows without one are a fold of their own
    return df.join(F.broadcast(means), F.col(fold).eqNullSafe(F.col("_fold")), "left").drop("_fold")


def mean_baseline(df: DataFrame, y: str, fold: str) -> DataFrame:
    """Metrics per fold of the predictor that always answers the training mean."""
    return regression_metrics(with_training_mean(df, y, fold), y, "baseline", [fold])


def train_test_gap(df: DataFrame, y: str, p: str, split: str, train: str = "train", test: str = "test") -> DataFrame:
    """Metrics of both sides in one row, and how much better the training side looks."""
    out = []
    for side in (train, test):
        out += [c.alias(f"{side}_{name}") for c, name in zip(
            metric_columns(y, p, F.col(split) == side), ("n", "mae", "rmse", "r2"))]
    return df.agg(*out).withColumn("r2_gap", F.col(f"{train}_r2") - F.col(f"{test}_r2"))


def macro_errors(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Row-weighted error next to the mean and median of the group errors."""
    per_group = df.groupBy(group).agg(
        F.avg(abs_error(y, p)).alias("group_mae"),
        F.sum(abs_error(y, p)).alias("_sum"),
        F.count(F.lit(1)).alias("_n"),
    )
    middle = exact_quantiles(per_group, ["group_mae"], [0.5]).withColumnRenamed("group_mae_p50", "median_group_mae")
    totals = per_group.agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.sum("_sum") / F.sum("_n")).alias("row_mae"),
        F.avg("group_mae").alias("macro_mae"),
    )
    return one_row(totals, middle)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row results with distinct columns side by side, without a join."""
    stacked = frames[0]
    for other in frames[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Append the values of a one-row table as constants (that one row goes through the driver)."""
    row = scalars.first()
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in scalars.schema})


def split_strategy_gap(df: DataFrame, y: str, p_random: str, p_group: str, random_fold: str, group_fold: str) -> DataFrame:
    """Mean fold R² under random and under group folds, and the difference."""
    out = None
    for label, p, fold in (("random", p_random, random_fold), ("group", p_group, group_fold)):
        row = metrics_over_folds(regression_metrics(df, y, p, [fold])).select(
            F.col("r2_mean").alias(f"{label}_r2_mean"), F.col("r2_std").alias(f"{label}_r2_std")
        )
        out = row if out is None else one_row(out, row)
    return out.withColumn("inflation", F.col("random_r2_mean") - F.col("group_r2_mean"))


def metrics_by_mask(df: DataFrame, y: str, p: str, masks: dict[str, Column]) -> DataFrame:
    """Count and mean absolute error of several row sets, one pass, one row per set."""
    parts = []
    for name, mask in masks.items():
        parts += [F.count_if(mask).alias(f"n_{name}"), F.avg(F.when(mask, abs_error(y, p))).alias(f"mae_{name}")]
    wide = df.agg(*parts)
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("mask"), F.col(f"n_{n}").alias("n"), F.col(f"mae_{n}").alias("mae"))
                    for n in masks
                ]
            )
        )
    )


def prediction_envelope(df: DataFrame, y: str, p: str) -> DataFrame:
    """Range and mean of predictions next to the top of the observed target."""
    top = exact_quantiles(df, [y], [0.99]).withColumnRenamed(f"{y}_p99", "target_p99")
    return one_row(
        df.agg(
            F.max(p).alias("pred_max"), F.min(p).alias("pred_min"), F.avg(p).alias("pred_mean"),
            F.max(y).alias("target_max"),
        ),
        top,
    )


def paired_model_difference(df: DataFrame, y: str, p_first: str, p_second: str, group: str) -> DataFrame:
    """Paired comparison of two models over groups: mean error difference, its spread and t."""
    per_group = df.groupBy(group).agg((F.avg(abs_error(y, p_first)) - F.avg(abs_error(y, p_second))).alias("diff"))
    stats = per_group.agg(
        F.count("diff").alias("n_groups"),
        F.avg("diff").alias("mean_diff"),
        F.stddev_samp("diff").alias("std_diff"),
    )
    return stats.withColumn("t", F.try_divide(F.col("mean_diff") * F.sqrt("n_groups"), F.col("std_diff")))
