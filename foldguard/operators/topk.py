"""Best rows, examples, diverse lists and comparisons of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .audit import spearman
from .metrics import one_row
from .ranking import exact_quantiles


def top_k(df: DataFrame, score: str, key: Sequence[str], k: int) -> DataFrame:
    """The ``k`` highest scores; equal scores are ordered by the key."""
    return df.orderBy(F.desc(score), *key).limit(k)


def best_per_key(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str]) -> DataFrame:
    """The best row of each key set.  Spark drops all but the best before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    return df.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") == 1).drop("_place")


def diverse_top(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], k: int) -> DataFrame:
    """The ``k`` best rows with no key set taken twice."""
    return top_k(best_per_key(df, keys, score, tie), score, tie, k)


def stratified_examples(df: DataFrame, error: str, key: Sequence[str], n: int) -> DataFrame:
    """The ``n`` closest, most median-like and worst rows, labelled; three bounded sorts."""
    middle = exact_quantiles(df, [error], [0.5]).first()[0]
    picks = {
        "close": [F.asc(error)],
        "typical": [F.asc(F.abs(F.col(error) - F.lit(middle)))],
        "far": [F.desc(error)],
    }
    out = None
    for label, order in picks.items():
        part = df.orderBy(*order, *key).limit(n).withColumn("kind", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def top_by_threshold(
    df: DataFrame, support: str, thresholds: Sequence[int], score: str, key: Sequence[str], k: int
) -> DataFrame:
    """The ``k`` best rows among those with enough support, for several thresholds in one pass."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(support) >= t)
    order = Window.partitionBy("threshold").orderBy(F.desc(score), *key)
    return (
        df.withColumn("threshold", F.explode(passed))
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k)
    )


def threshold_sensitivity(
    df: DataFrame, support: str, thresholds: Sequence[int], base: int, score: str, key: Sequence[str], k: int
) -> DataFrame:
    """Per threshold: supported rows, highest score, median of the top list, overlap with the base list."""
    passed = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(support) >= t)
    counts = (
        df.select(score, F.explode(passed).alias("threshold"))
        .groupBy("threshold").agg(F.count(F.lit(1)).alias("n_supported"), F.max(score).alias("ceiling"))
    )
    tops = top_by_threshold(df, support, thresholds, score, key, k)
    in_base = tops.filter(F.col("threshold") == base).select(*key, F.lit(1).alias("_base"))
    lists = (
        tops.join(in_base, list(key), "left")
        .groupBy("threshold").agg(F.expr(f"percentile(`{score}`, 0.5D)").alias("top_median"),  # k values
                                  F.count("_base").alias("overlap_base"))
    )
    return counts.join(lists, "threshold", "left")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Size of the intersection of two lists (one row)."""
    return left.select(*keys).intersect(right.select(*keys)).agg(F.count(F.lit(1)).alias("n_common"))


def set_difference_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, with copies, that only one of two tables has; both zero for equal tables."""
    a, b = left.select(*keys), right.select(*keys)
    return one_row(
        a.exceptAll(b).agg(F.count(F.lit(1)).alias("n_only_left")),
        b.exceptAll(a).agg(F.count(F.lit(1)).alias("n_only_right")),
    )


def rank_stability(
    df: DataFrame, old: str, new: str, key: Sequence[str], diverse_keys: Sequence[str], k: int = 30
) -> DataFrame:
    """How two scorings of the same rows agree: rank correlation, list overlaps, ceilings, mean gap."""
    common = overlap(top_k(df, old, key, k), top_k(df, new, key, k), key)
    diverse = overlap(diverse_top(df, diverse_keys, old, key, k), diverse_top(df, diverse_keys, new, key, k), key)
    return one_row(
        spearman(df, old, new),
        df.agg(
            F.max(old).alias("ceiling_old"),
            F.max(new).alias("ceiling_new"),
            F.avg(F.abs(F.col(new) - F.col(old))).alias("mean_abs_diff"),
        ),
        common.withColumnRenamed("n_common", "overlap_top"),
        diverse.withColumnRenamed("n_common", "overlap_diverse"),
    )
