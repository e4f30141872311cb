"""Does ranking by prediction find the rows worth having?  Enrichment and gains."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank


def top_count(fraction: str | float, n: int) -> int:
    """``max(1, int(fraction * n))`` without binary rounding of the fraction."""
    return max(1, math.floor(Decimal(str(fraction)) * n))


def ranked_by_prediction(df: DataFrame, y: str, p: str, key: Sequence[str]) -> DataFrame:
    """(y, rank) with rank 1 for the highest prediction; the key makes the order total."""
    return global_rank(df.select(*dict.fromkeys([y, p, *key])), [F.desc(p), *key])


def enrichment_table(
    df: DataFrame, y: str, p: str, key: Sequence[str], thresholds: Sequence[float], fractions: Sequence[str]
) -> DataFrame:
    """Base rate, hit rate among the top k and their ratio, per threshold and top fraction.

    One ranking and one aggregate serve all pairs.
    """
    ranked = ranked_by_prediction(df, y, p, key)
    n = ranked.count()
    depth = {f: top_count(f, n) for f in fractions}
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        good = F.col(y) >= t
        aggregates.append(F.count_if(good).alias(f"_b{i}"))
        aggregates += [F.count_if(good & (F.col("rank") <= k)).alias(f"_h{i}_{j}") for j, k in enumerate(depth.values())]
    rows = []
    for i, t in enumerate(thresholds):
        base = F.col(f"_b{i}") / F.col("_n")
        for j, (f, k) in enumerate(depth.items()):
            hit = F.col(f"_h{i}_{j}") / F.lit(k)
            rows.append(
                F.struct(
                    F.lit(float(t)).alias("threshold"), F.lit(float(f)).alias("fraction"),
                    F.lit(k).cast("bigint").alias("k"), base.alias("base_rate"), hit.alias("precision_at_k"),
                    F.try_divide(hit, base).alias("lift"),
                )
            )
    return ranked.agg(*aggregates).select(F.inline(F.array(*rows)))


def gains_curve(df: DataFrame, y: str, p: str, key: Sequence[str], threshold: float, points: int = 50) -> DataFrame:
    """Share of all good rows found among the first 1/points, 2/points, … of the ranking."""
    ranked = ranked_by_prediction(df, y, p, key)
    n = ranked.count()
    good = F.col(y) >= threshold
    depth = [max(1, j * n // points) for j in range(1, points + 1)]
    wide = ranked.agg(
        F.count_if(good).alias("_all"),
        *[F.count_if(good & (F.col("rank") <= k)).alias(f"_c{j}") for j, k in enumerate(depth)],
    )
    total = F.greatest(F.lit(1), F.col("_all"))
    rows = [
        F.struct(
            F.lit(j + 1).alias("point"), F.lit(k).cast("bigint").alias("k"),
            (F.col(f"_c{j}") / total).alias("captured"),
        )
        for j, k in enumerate(depth)
    ]
    return wide.select(F.inline(F.array(*rows)))
