"""Audits of group keys, split leakage, support and within-group effects."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEY_URL_PREFIX, normalize_key, strip_space
from ..session import stage
from .joins import HOT_ROWS, lookup_by_key
from .metrics import metrics_by_mask, one_row
from .ranking import average_ranks, exact_quantiles, group_positions

MOST_EXACT = 50  # differences up to which the signed-rank distribution is exact

# --- support of dimension tuples -----------------------------------------------------------


def cooccurrence(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows per combination of the dimensions."""
    return df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n_rows"))


def tuple_support(df: DataFrame, dims: Sequence[str], group: str) -> DataFrame:
    """Rows, groups and the largest single-group share per observed combination.

    Counted per (combination, group) first, so a dominant group is one partial count.
    """
    per_group = df.groupBy(*dims, group).agg(F.count(F.lit(1)).alias("_n"))
    return per_group.groupBy(*dims).agg(
        F.sum("_n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.max("_n") / F.sum("_n")).alias("max_group_share"),
    )


def support_of(space: DataFrame, df: DataFrame, dims: Sequence[str], group: str) -> DataFrame:
    """Support of every combination of a space; unseen ones have 0 rows and no share."""
    joined = space.join(tuple_support(df, dims, group), list(dims), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_rows", "n_groups")})


# --- within-group effect of a flag ---------------------------------------------------------


def any_all_by_group(df: DataFrame, group: str, flag: str) -> DataFrame:
    return df.groupBy(group).agg(F.bool_or(flag).alias("any_flag"), F.bool_and(flag).alias("all_flag"))


def paired_differences(df: DataFrame, group: str, flag: str, value: str) -> DataFrame:
    """median(flagged) - median(others) for the groups that hold both kinds of rows."""
    medians = exact_quantiles(df, [value], [0.5], [group, flag])
    sides = medians.groupBy(group).agg(
        F.max(F.when(F.col(flag), F.col(f"{value}_p50"))).alias("_on"),
        F.max(F.when(~F.col(flag), F.col(f"{value}_p50"))).alias("_off"),
    )
    return sides.filter(F.col("_on").isNotNull() & F.col("_off").isNotNull()).select(
        group, (F.col("_on") - F.col("_off")).alias("diff")
    )


def paired_summary(differences: DataFrame) -> DataFrame:
    """Mixed groups, median and quartiles of their differences, and the share below zero."""
    return one_row(
        differences.agg(
            F.count("diff").alias("n_groups"), F.avg((F.col("diff") < 0).cast("double")).alias("negative_share")
        ),
        exact_quantiles(differences, ["diff"], [0.25, 0.5, 0.75]),
    )


def signed_rank(df: DataFrame, diff: str) -> DataFrame:
    """Wilcoxon signed-rank statistic of a column of differences.

    Zeros are dropped and tied magnitudes share their average rank.  Ranks are computed
    on distinct magnitudes with counts; nothing is joined back to the rows.
    """
    d = F.col(diff)
    sized = (
        df.filter(d != 0).select(F.abs(d).alias("_abs"), (d > 0).alias("_up"))
        .groupBy("_abs").agg(F.count_if("_up").alias("_pos"), F.count(F.lit(1)).alias("n"))
    )
    placed = group_positions(sized, [], ["_abs"], "n")
    rank = F.col("before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = placed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_used"),
        F.sum(rank * F.col("_pos")).alias("w_plus"),
        F.sum(rank * (F.col("n") - F.col("_pos"))).alias("w_minus"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    m = F.col("n_used").cast("double")
    mean = m * (m + 1) / 4
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48
    return sums.select(
        "n_used", "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"),
        F.try_divide(F.least("w_plus", "w_minus") - mean, F.sqrt(var)).alias("z"),
    )


def signed_rank_p(result: DataFrame) -> float | None:
    """Two-sided normal p value of a :func:`signed_rank` result (one row)."""
    z = result.first()["z"]
    return None if z is None else math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_distribution(most: int = MOST_EXACT) -> list[tuple[int, int, float]]:
    """``(n, w, p)``: the two-sided p value of each smaller rank sum ``w`` of ``n`` untied differences, for all ``n`` up to ``most``.

    The number of sign patterns with a rank sum grows by one rank at a time: rank ``n`` is in the sum or not.
    """
    out, ways = [], [1]
    for n in range(1, most + 1):
        longer = ways + [0] * n
        for w, c in enumerate(ways):
            longer[w + n] += c
        ways, below = longer, 0
        for w in range(n * (n + 1) // 4 + 1):
            below += ways[w]
            out.append((n, w, min(1.0, 2 * below / (1 << n))))
    return out


def signed_rank_by(df: DataFrame, diff: str, by: Sequence[str], most: int = MOST_EXACT) -> DataFrame:
    """The signed-rank test of every group: ``n_used, n_zero, w_plus, w_minus, w, z, p_exact``.

    ``p_exact`` is two-sided and there for up to ``most`` differences without zeros and ties; ``z`` has the tie correction and serves
    the other groups (:func:`normal_p`). NULL differences are left out; a group without any other has no row.
    """
    d = F.col(diff)
    sized = df.filter(d.isNotNull()).groupBy(*by, F.abs(d).alias("_abs")).agg(F.count_if(d > 0).alias("_pos"), F.count(F.lit(1)).alias("n"))
    sized = stage(sized, "signed-rank")
    zeros = sized.filter("_abs = 0").select(*[F.col(c).alias(f"_z{i}") for i, c in enumerate(by)], F.col("n").alias("n_zero"))
    placed = group_positions(sized.filter("_abs > 0"), list(by), ["_abs"], "n")
    rank = F.col("before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = placed.groupBy(*by).agg(
        F.sum("n").alias("n_used"), F.sum(rank * F.col("_pos")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("_pos"))).alias("w_minus"),
        F.sum(n * n * n - n).alias("_ties"),
    )
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_z{i}")) for i, c in enumerate(by)], F.lit(True))
    known = sums.join(zeros, same, "left").withColumns({"n_zero": F.coalesce("n_zero", F.lit(0)), "w": F.least("w_plus", "w_minus")})
    m = F.col("n_used").cast("double")
    var = m * (m + 1) * (2 * m + 1) / 24 - F.col("_ties") / 48
    table = df.sparkSession.createDataFrame(signed_rank_distribution(most), "_n bigint, _w bigint, p_exact double")
    plain = (F.col("_ties") == 0) & (F.col("n_zero") == 0)
    met = known.join(F.broadcast(table), plain & (F.col("n_used") == F.col("_n")) & (F.col("w").cast("bigint") == F.col("_w")), "left")  # its size is fixed
    return met.select(*by, "n_used", "n_zero", "w_plus", "w_minus", "w", F.try_divide(F.col("w") - m * (m + 1) / 4, F.sqrt(var)).alias("z"), "p_exact")


def normal_p(z: Column) -> Column:
    """Two-sided normal p value, by the error function's continued approximation (absolute error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1 / (1 + x / 2)
    #: Coefficients of the rational approximation of erfc.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    inner = F.lit(0.0)
    for c in reversed(terms):
        inner = inner * t + c
    return t * F.exp(inner - x * x)


def spearman(df: DataFrame, x: str, y: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank correlation with average ranks for ties, over rows where both are present."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    counted = stage(pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_copies")), "rank-pairs")
    copies = F.sum("_copies")
    ranked = lookup_by_key(counted, average_ranks(counted, "_x", "_rx", copies), ["_x"], "n", hot_rows)
    ranked = lookup_by_key(ranked, average_ranks(counted, "_y", "_ry", copies), ["_y"], "n", hot_rows)
    w, rx, ry = F.col("_copies").cast("double"), F.col("_rx"), F.col("_ry")
    # Mean rank is (n + 1) / 2 for both, whatever the ties: centre before squaring.
    n = counted.agg(F.coalesce(F.sum("_copies"), F.lit(0))).first()[0]
    cx, cy = rx - (n + 1) / 2, ry - (n + 1) / 2
    return ranked.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n"),
        F.try_divide(F.sum(w * cx * cy), F.sqrt(F.sum(w * cx * cx) * F.sum(w * cy * cy))).alias("rho"),
    )


# --- key normalisation ---------------------------------------------------------------------


def key_variants(df: DataFrame, raw_key: str, extra: Sequence = ()) -> DataFrame:
    """(raw key, normalised key, rows) with further aggregates; one row per raw spelling."""
    return (
        df.filter(F.col(raw_key).isNotNull())
        .groupBy(raw_key).agg(F.count(F.lit(1)).alias("n_rows"), *extra)
        .withColumn("norm_key", normalize_key(F.col(raw_key)))
    )


def collisions(df: DataFrame, raw_key: str) -> DataFrame:
    """Normalised keys with more than one raw spelling, their rows and how the spellings differ."""
    raw = F.col(raw_key)
    tight = strip_space(raw)
    variants = key_variants(df, raw_key)
    return (
        variants.groupBy("norm_key").agg(
            F.count(F.lit(1)).alias("n_variants"),
            F.sum("n_rows").alias("n_rows"),
            F.bool_or(raw != tight).alias("by_space"),
            (F.count_distinct(F.lower(raw)) < F.count(F.lit(1))).alias("by_case"),
            F.bool_or(F.lower(raw).rlike(KEY_URL_PREFIX)).alias("by_url"),
            F.bool_or(F.lower(tight).rlike("^doi:")).alias("by_scheme"),
        )
        .filter(F.col("n_variants") > 1)
    )


def collision_kinds(found: DataFrame) -> DataFrame:
    """How many collisions involve each kind of difference."""
    kinds = ("by_space", "by_case", "by_url", "by_scheme")
    wide = found.agg(*[F.count_if(F.col(k)).alias(k) for k in kinds])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n_collisions")) for k in kinds]))
    )


def key_sides(df: DataFrame, raw_key: str, side: str) -> DataFrame:
    """Per normalised key: spellings, rows, and on how many sides of a split (or folds) they lie."""
    sides = key_variants(df, raw_key, [F.collect_set(side).alias("_sides")])  # a few sides per key
    return sides.groupBy("norm_key").agg(
        F.count(F.lit(1)).alias("n_variants"),
        F.sum("n_rows").alias("n_rows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_sides")))).alias("n_sides"),
    )


def crossing_keys(df: DataFrame, raw_key: str, side: str) -> DataFrame:
    """Colliding keys whose spellings lie on more than one side of a split or in several folds."""
    return key_sides(df, raw_key, side).filter((F.col("n_variants") > 1) & (F.col("n_sides") > 1))


def crossing_summary(df: DataFrame, raw_key: str, side: str) -> DataFrame:
    counted = crossing_keys(df, raw_key, side).agg(
        F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    )
    total = df.agg(F.count(F.lit(1)).alias("n_all"))
    return one_row(counted, total).withColumn("pct_rows", F.col("n_rows") * 100.0 / F.col("n_all"))


def contamination(
    df: DataFrame, raw_key: str, split: str, y: str, p: str, test: str = "test", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Errors of test rows whose key also sits, spelled differently, in training; against the rest."""
    crosses = (F.col("n_variants") > 1) & (F.col("n_sides") > 1)
    # All keys are in the table, so that a heavy key is known as such even when it is clean.
    crossing = key_sides(df, raw_key, split).select("norm_key", F.col("n_rows").alias("_size"), crosses.alias("_x"))
    keyed = df.withColumn("norm_key", normalize_key(F.col(raw_key)))
    marked = lookup_by_key(keyed, crossing, ["norm_key"], "_size", hot_rows)
    hit, on_test = F.coalesce("_x", F.lit(False)), F.col(split) == test
    return metrics_by_mask(
        marked, y, p,
        {"contaminated_test": hit & on_test, "clean_test": ~hit & on_test, "train_side": hit & ~on_test},
    )


# --- group means ---------------------------------------------------------------------------


def group_residuals(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Append the group mean and the row's distance from it (aggregate and look up, no window)."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("group_mean"), F.count(F.lit(1)).alias("_size"))
    out = lookup_by_key(df, means, keys, "_size", hot_rows)
    return out.withColumn("residual", F.col(value) - F.col("group_mean"))
