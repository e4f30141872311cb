"""Split-conformal intervals, marginal and per prediction bin."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import abs_error
from .ranking import _at, exact_quantiles, quantile_bins, value_positions

BIN_PROBS = (0.25, 0.5, 0.75)


def conformal_rank(n: Column, coverage: str | float) -> Column:
    """``min(ceil((n + 1) * coverage), n)`` in exact integer arithmetic."""
    ratio = Decimal(str(coverage)).as_integer_ratio()
    up = F.expr("(({n} + 1) * {a} + {b} - 1) div {b}".format(n="total", a=ratio[0], b=ratio[1]))
    return F.least(up, n)


def half_widths(calibration: DataFrame, error: str, coverages: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The conformal quantile of the calibration errors per coverage (and bin): one sort for all."""
    placed = value_positions(calibration, list(by), error)
    wide = placed.groupBy(*by).agg(
        F.max("total").alias("n_calibration"),
        *[
            _at(conformal_rank(F.col("total"), c) - 1, error).alias(f"_q{i}")
            for i, c in enumerate(coverages)
        ],
    )
    rows = [
        F.struct(F.lit(float(c)).alias("target_coverage"), F.col(f"_q{i}").alias("half_width"))
        for i, c in enumerate(coverages)
    ]
    return wide.select(*by, "n_calibration", F.inline(F.array(*rows)))


def marginal_intervals(
    calibration: DataFrame, test: DataFrame, y: str, p: str, coverages: Sequence[str]
) -> DataFrame:
    """Half-width per target coverage and the share of test rows it really covers."""
    widths = half_widths(calibration.withColumn("_e", abs_error(y, p)), "_e", coverages).collect()  # len(coverages) rows
    err = abs_error(y, p)
    wide = test.agg(
        F.count(F.lit(1)).alias("n_test"),
        *[F.avg((err <= w["half_width"]).cast("double")).alias(f"_c{i}") for i, w in enumerate(widths)],
    )
    rows = [
        F.struct(
            F.lit("marginal").alias("method"),
            F.lit(w["target_coverage"]).alias("target_coverage"),
            F.lit(w["n_calibration"]).cast("bigint").alias("n_calibration"),
            F.col("n_test"),
            F.lit(w["half_width"]).alias("half_width"),
            F.lit(2 * w["half_width"]).alias("width"),
            F.col(f"_c{i}").alias("coverage"),
        )
        for i, w in enumerate(widths)
    ]
    return wide.select(F.inline(F.array(*rows)))


def prediction_edges(calibration: DataFrame, p: str, probs: Sequence[float] = BIN_PROBS) -> list[float]:
    """Inner bin edges: quantiles of the calibration predictions."""
    return list(exact_quantiles(calibration, [p], probs).first())


def binned_half_widths(calibration: DataFrame, y: str, p: str, edges: Sequence[float], coverage: str) -> DataFrame:
    binned = calibration.select(quantile_bins(F.col(p), edges).alias("bin"), abs_error(y, p).alias("_e"))
    return half_widths(binned, "_e", [coverage], ["bin"])


def binned_intervals(calibration: DataFrame, test: DataFrame, y: str, p: str, coverage: str = "0.90") -> DataFrame:
    """Interval per prediction quartile: half-width, test rows and coverage of each bin.

    Test rows in a bin without calibration rows, or without a prediction, take the half-width of all calibration rows;
    ``n_calibration`` is 0 there. Rows without an error count in ``n_test`` and not in the coverage.
    """
    edges = prediction_edges(calibration, p)
    widths = binned_half_widths(calibration, y, p, edges, coverage)
    scored = test.select(quantile_bins(F.col(p), edges).alias("bin"), abs_error(y, p).alias("_e")).join(
        F.broadcast(widths.select("bin", "n_calibration", "half_width")), "bin", "left"  # one row per bin
    )
    whole = half_widths(calibration.select(abs_error(y, p).alias("_e")), "_e", [coverage]).first()  # one row
    if whole is not None:
        scored = scored.withColumns(
            {
                "n_calibration": F.coalesce("n_calibration", F.lit(0).cast("bigint")),
                "half_width": F.coalesce("half_width", F.lit(whole["half_width"])),
            }
        )
    return scored.groupBy("bin", "n_calibration", "half_width").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.avg((F.col("_e") <= F.col("half_width")).cast("double")).alias("coverage"),
    )


def binned_summary(per_bin: DataFrame, coverage: str = "0.90") -> DataFrame:
    """Overall coverage and mean width of the binned intervals, in the shape of the marginal rows."""
    n = F.sum("n_test")
    return per_bin.agg(
        F.lit("binned").alias("method"),
        F.lit(float(coverage)).alias("target_coverage"),
        F.sum("n_calibration").alias("n_calibration"),
        n.alias("n_test"),
        (F.sum(F.col("half_width") * F.col("n_test")) / n).alias("half_width"),
        (2 * F.sum(F.col("half_width") * F.col("n_test")) / n).alias("width"),
        (F.sum(F.col("coverage") * F.col("n_test")) / n).alias("coverage"),
    )


def coverage_table(calibration: DataFrame, test: DataFrame, y: str, p: str, coverages: Sequence[str]) -> DataFrame:
    """Target next to observed coverage for all methods."""
    marginal = marginal_intervals(calibration, test, y, p, coverages)
    return marginal.unionByName(binned_summary(binned_intervals(calibration, test, y, p, coverages[0]), coverages[0]))


def with_interval(df: DataFrame, p: str, half_width: float, name: str) -> DataFrame:
    return df.withColumns(
        {f"{name}_low": F.col(p) - F.lit(half_width), f"{name}_high": F.col(p) + F.lit(half_width)}
    )


def inside_interval(df: DataFrame, y: str, p: str, half_width: float, out: str = "inside") -> DataFrame:
    return df.withColumn(out, abs_error(y, p) <= F.lit(half_width))
