"""A cartesian space of candidate recipes, encoded as model inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import lookup_or_default
from .ranking import global_rank

Axis = Sequence | DataFrame


def axis_sizes(axes: Mapping[str, Axis]) -> dict[str, int]:
    return {name: axis.count() if isinstance(axis, DataFrame) else len(axis) for name, axis in axes.items()}


def expected_count(axes: Mapping[str, Axis]) -> int:
    return prod(axis_sizes(axes).values())


def enumerate_space(spark: SparkSession, axes: Mapping[str, Axis]) -> DataFrame:
    """All combinations of the axis levels; an axis is a list, or a table of any length from :func:`axis_from`.

    Combination ``i`` is read off the digits of ``i`` in the mixed radix of the axis sizes, so the space is a
    partitioned range. Levels of lists are literals, those of tables are looked up by their digit.
    """
    sizes = axis_sizes(axes)
    below = prod(sizes.values())
    out = spark.range(below).withColumnRenamed("id", "candidate_id")
    for name, axis in axes.items():
        size = max(sizes[name], 1)  # an axis without levels leaves an empty space
        below //= size
        digit = F.expr(f"candidate_id div {max(below, 1)} % {size}")
        if isinstance(axis, DataFrame):
            levels = axis.select(F.col("digit").alias("_of"), F.col("level").alias(name))
            out = out.withColumn("_digit", digit).join(levels, F.col("_digit") == F.col("_of")).drop("_digit", "_of")
        else:
            out = out.withColumn(name, F.element_at(F.lit(list(axis)), (digit + 1).cast("int")))
    return out


def axis_from(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column as an axis: ``level``, and its place ``digit`` in sorted order, from 0."""
    levels = df.select(F.col(column).alias("level")).filter(F.col("level").isNotNull()).distinct()
    return global_rank(levels, ["level"], "_place").select("level", (F.col("_place") - 1).alias("digit"))


def encode_space(
    space: DataFrame,
    axes: Mapping[str, Mapping[str, Mapping[str, float]] | DataFrame],
    features: Sequence[str],
    context: Mapping[str, float],
) -> DataFrame:
    """Model inputs of the candidates in model order; columns the model lacks are left out.

    What the levels of an axis set is a mapping, or rows ``level, feature, value``; candidates look it up by level. Where
    several axes set a feature the last one counts, what none sets is 0.
    """
    wanted = [f for f in features if f not in context]
    found: dict[str, list[Column]] = {f: [] for f in wanted}
    out = space
    for i, (axis, cells) in enumerate(axes.items() if wanted else ()):
        if not isinstance(cells, DataFrame):
            rows = [(str(level), f, float(v)) for level, own in cells.items() for f, v in own.items()]
            cells = space.sparkSession.createDataFrame(rows, "level string, feature string, value double")
        per_level = cells.groupBy(F.col("level").cast("string").alias(f"_level{i}")).agg(
            *[F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"_{i}_{j}") for j, f in enumerate(wanted)]
        )
        out = out.join(per_level, F.col(axis).cast("string") == F.col(f"_level{i}"), "left")
        for j, f in enumerate(wanted):
            found[f].insert(0, F.col(f"_{i}_{j}"))
    encoded = [
        F.lit(float(context[f])).alias(f) if f in context else F.coalesce(*found[f], F.lit(0.0)).alias(f) for f in features
    ]
    return out.select("candidate_id", *axes, *encoded)


def check_count(space: DataFrame, axes: Mapping[str, Axis]) -> int:
    n, expected = space.count(), expected_count(axes)
    if n != expected:
        raise ValueError(f"{n} candidates instead of {expected}")
    return n


def with_support(candidates: DataFrame, support: DataFrame, dims: Sequence[str], count: str = "n_rows") -> DataFrame:
    """Attach the number of supporting rows, 0 where the combination was never seen."""
    return lookup_or_default(candidates, support.select(*dims, count), dims, {count: 0})


def support_counts(candidates: DataFrame, count: str, thresholds: Sequence[int]) -> DataFrame:
    """Candidates that reach each support threshold, one pass."""
    wide = candidates.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(count) >= t).alias(f"_t{t}") for t in thresholds]
    )
    rows = [
        F.struct(F.lit(t).alias("threshold"), F.col(f"_t{t}").alias("n_supported"), F.col("_n").alias("n_candidates"))
        for t in thresholds
    ]
    return wide.select(F.inline(F.array(*rows)))
