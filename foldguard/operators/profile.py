"""Descriptive profiles: sizes, histograms, repeated-key noise, preprocessing stability."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from ..functions.text import numeric_or_null
from ..session import stage
from .metrics import one_row, with_scalars
from .ranking import _at, exact_quantiles, group_positions

SIZE_PROBS = (0.5, 0.75, 0.9, 0.95, 0.99)


def size_classes(df: DataFrame, group: str, include_null_group: bool = False) -> DataFrame:
    """Histogram of group sizes: (size, number of groups), at most ``sqrt(2 · rows)`` rows."""
    rows = df if include_null_group else df.filter(F.col(group).isNotNull())
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows"))
    return sizes.groupBy("group_rows").agg(F.count(F.lit(1)).alias("n_groups"))


def group_size_profile(df: DataFrame, group: str, include_null_group: bool = False) -> DataFrame:
    """Groups, mean and quantile sizes, singletons, and the row share of the largest 1 % of groups."""
    rows = F.col("group_rows") * F.col("n_groups")
    stats = size_classes(df, group, include_null_group).agg(
        F.sum(rows).alias("n_rows"),
        F.sum("n_groups").alias("n_groups"),
        F.max("group_rows").alias("max_size"),
        F.sum(F.when(F.col("group_rows") == 1, F.col("n_groups")).otherwise(0)).alias("n_singletons"),
        F.expr(f"percentile(group_rows, array({', '.join(f'{q}D' for q in SIZE_PROBS)}), n_groups)").alias("_sizes"),
        F.array_sort(F.collect_list(F.struct((-F.col("group_rows")).alias("neg"), "n_groups"))).alias("_classes"),
    )
    top = F.greatest(F.lit(1), F.floor(F.col("n_groups") / 100)).cast("bigint")

    def take(acc: Column, c: Column) -> Column:
        n = F.least(acc["left"], c["n_groups"])
        return F.struct((acc["left"] - n).alias("left"), (acc["rows"] - n * c["neg"]).alias("rows"))

    start = F.struct(top.alias("left"), F.lit(0).cast("bigint").alias("rows"))
    return stats.select(
        "n_rows", "n_groups",
        (F.col("n_rows") / F.col("n_groups")).alias("mean_size"),
        *[F.col("_sizes")[i].alias(f"size_p{q * 100:g}") for i, q in enumerate(SIZE_PROBS)],
        "max_size", "n_singletons",
        (F.aggregate("_classes", start, take)["rows"] / F.col("n_rows")).alias("top_share"),
    )


def noise_floor(
    df: DataFrame, target: str, group: str, key_sets: Mapping[str, Sequence[str]], decimals: int = 2
) -> DataFrame:
    """Target variance inside repeated keys that at least two groups report.

    One row per key definition: pooled variance, error floor and the R² ceiling it
    implies, with no join back to the rows: sums of squares come from per-key variances.
    """
    total = df.agg(F.var_samp(target).alias("_var_total"))
    out = None
    for label, keys in key_sets.items():
        present = df.filter(F.col(target).isNotNull())
        for k in keys:
            present = present.filter(F.col(k).isNotNull())
        whole = {f.name for f in df.schema if isinstance(f.dataType, IntegralType)}
        keyed = [F.col(k) if k in whole else F.bround(F.col(k), decimals).alias(k) for k in keys]
        rounded = present.select(*keyed, target, group)
        per_key = (
            rounded.groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("n"), F.var_samp(target).alias("var"),
                F.min(group).alias("_first"), F.max(group).alias("_last"),
            )
            .filter((F.col("n") >= 2) & (F.col("_first") != F.col("_last")))  # two groups at least
            .withColumn("std", F.sqrt("var"))
        )
        per_key = stage(per_key.select("n", "var", "std"), "repeated-keys")
        pooled = per_key.agg(
            F.count(F.lit(1)).alias("n_keys"),
            F.sum("n").alias("n_rows"),
            F.sum((F.col("n") - 1) * F.col("var")).alias("_ss"),
            F.avg("std").alias("std_mean"),
        )
        middle = exact_quantiles(per_key, ["std"], [0.5]).withColumnRenamed("std_p50", "std_median")
        row = one_row(pooled, middle).withColumn("definition", F.lit(label))
        out = row if out is None else out.unionByName(row)
    pooled_var = F.col("_ss") / F.greatest(F.lit(1), F.col("n_rows") - F.col("n_keys"))
    return (
        with_scalars(out, total)
        .withColumns(
            {
                "pooled_var": pooled_var,
                "rmse_floor": F.sqrt(F.try_divide("_ss", "n_rows")),
                "r2_ceiling": 1 - F.try_divide(pooled_var, F.col("_var_total")),
            }
        )
        .select(
            "definition", "n_keys", "n_rows", "std_median", "std_mean", "pooled_var", "rmse_floor", "r2_ceiling"
        )
    )


def observed_profile(
    df: DataFrame, value: str, missing_flag: str, probs: Sequence[float], windows: Mapping[str, tuple]
) -> DataFrame:
    """Quantiles, mean, spread and range shares of the values that were really observed.

    ``windows`` maps a name to (low, high), either end None for open; ends are inclusive.
    """
    observed = df.filter(F.col(missing_flag) == 0)
    v = F.col(value)
    shares = []
    for name, (low, high) in windows.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        if high is not None:
            inside = inside & (v <= high)
        shares.append(F.avg(inside.cast("double")).alias(f"share_{name}"))
    return one_row(
        observed.agg(
            F.count(v).alias("n_observed"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), *shares
        ),
        exact_quantiles(observed, [value], probs),
    )


def outlier_audit(
    df: DataFrame, value: str, bounds: tuple[float, float], limits: Sequence[float],
    flags: Sequence[str], measure: str, group: str,
) -> DataFrame:
    """Rows above each limit, and what the rows above the first limit look like."""
    v = numeric_or_null(F.col(value))
    valid = df.withColumn("_v", v).filter(F.col("_v").between(*bounds))
    above = F.col("_v") > limits[0]
    counts = [F.count_if(F.col("_v") > x).alias(f"n_gt_{x:g}") for x in limits]
    on = [
        F.count_if(above & (F.upper(F.col(f).cast("string")) == "TRUE")).alias(f"n_{f}_true") for f in flags
    ]
    summary = valid.agg(
        F.count(F.lit(1)).alias("n_valid"),
        F.max("_v").alias("max_value"),
        *counts,
        (F.count_if(above) * 100.0 / F.count(F.lit(1))).alias("pct_gt_first"),
        *on,
        F.count_distinct(F.when(above, F.col(group))).alias("n_groups_gt"),
    )
    high = valid.filter(above).withColumn("_m", numeric_or_null(F.col(measure)))
    middle = exact_quantiles(high, ["_m"], [0.5]).withColumnRenamed("_m_p50", f"median_{measure}")
    return one_row(summary, middle)


def fold_value_counts(df: DataFrame, fold: str, folds: int, value: str) -> DataFrame:
    """(fold, value, n): how often a value occurs in the training part of each fold.

    Training count = total minus the fold's own count, from one aggregate; rows are not
    copied per fold.  Values that do not occur in a training part are left out.
    """
    per_fold = [F.count_if(F.col(fold) == f).alias(f"_n{f}") for f in range(folds)]
    wide = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_all"), *per_fold)
    entries = [
        F.struct(F.lit(f).alias("fold"), (F.col("_all") - F.col(f"_n{f}")).alias("n")) for f in range(folds)
    ]
    return wide.select(F.col(value), F.inline(F.array(*entries))).filter(F.col("n") > 0)


def top_values(counts: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values per group; equal counts are ordered by the value.

    Spark keeps only the best ``n`` of each group before it shuffles.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc(value))
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def fold_median_shift(df: DataFrame, fold: str, folds: int, value: str) -> DataFrame:
    """Training median per fold and its distance from the median of all rows."""
    counts = fold_value_counts(df, fold, folds, value)
    everything = (
        df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
        .select(value, F.lit(-1).alias("fold"), "n")
    )
    placed = group_positions(counts.unionByName(everything), ["fold"], [value], "n")
    h = (F.col("total") - 1) * F.lit(0.5)
    medians = placed.groupBy("fold").agg(
        ((_at(F.floor(h), value) + _at(F.ceil(h), value)) / 2.0).alias("train_median")
    )
    overall = medians.filter(F.col("fold") == -1).select(F.col("train_median").alias("_global"))
    return with_scalars(medians.filter(F.col("fold") >= 0), overall).select(
        "fold", "train_median", (F.col("train_median") - F.col("_global")).alias("delta_vs_global")
    )


def fold_top_overlap(
    df: DataFrame, fold: str, folds: int, category: str, top_n: int, missing: str = "unknown"
) -> DataFrame:
    """How many of the overall top-N categories are also top-N in each training part."""
    named = df.select(fold, F.coalesce(F.col(category), F.lit(missing)).alias("_c"))
    per_fold = top_values(fold_value_counts(named, fold, folds, "_c"), ["fold"], "_c", top_n)
    counts = named.groupBy("_c").agg(F.count(F.lit(1)).alias("n"))
    overall = counts.orderBy(F.desc("n"), "_c").limit(top_n).select("_c")
    return (
        per_fold.join(overall.withColumn("_hit", F.lit(1)), "_c", "left")
        .groupBy("fold").agg(F.count("_hit").alias("overlap"))
    )


def missing_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of imputed rows per flag column, one row per column."""
    wide = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in flags])
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_rate")) for c in flags]))
    )


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts in equal bins, each closed on the left, the last one on both sides."""
    high = low + width * bins
    v = F.col(value)
    b = F.least(F.floor((v - low) / width), F.lit(bins - 1)).cast("int")
    return (
        df.filter(v.between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin_low", F.lit(low) + F.col("bin") * F.lit(width))
    )


def binned_mean(
    df: DataFrame, by: str, target: str, low: float, width: float, bins: int, min_count: int = 30
) -> DataFrame:
    """Mean target in right-closed bins that hold at least ``min_count`` rows."""
    x = F.col(by)
    b = (F.ceil((x - low) / width) - 1).cast("int")
    return (
        df.filter((x > low) & (x <= low + width * bins)).groupBy(b.alias("bin"))
        .agg(F.avg(target).alias("mean"), F.count(target).alias("n"))
        .filter(F.col("n") >= min_count)
        .withColumn("center", F.lit(low) + (F.col("bin") + 0.5) * F.lit(width))
    )


def category_shares(
    df: DataFrame, category: str, top: int = 5, rest: str = "other", missing: str = "Unknown"
) -> DataFrame:
    """The most frequent categories and one row for all others (a lone other keeps its name)."""
    counts = (
        df.select(F.coalesce(F.col(category), F.lit(missing)).alias("category"))
        .groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.orderBy(F.desc("n"), "category").limit(top).select("category", F.lit(1).alias("_top"))
    marked = counts.join(best, "category", "left")
    rest_rows = marked.filter(F.col("_top").isNull()).agg(
        F.count(F.lit(1)).alias("_k"), F.sum("n").alias("n"), F.max("category").alias("_name")
    )
    bucket = rest_rows.filter(F.col("_k") > 0).select(
        F.when(F.col("_k") == 1, F.col("_name")).otherwise(F.lit(rest)).alias("category"), "n"
    )
    return marked.filter(F.col("_top") == 1).select("category", "n").unionByName(bucket)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, as a table (value, n); NULL is a value like any other."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def clean_summary(raw: DataFrame, clean: DataFrame, target: str, group: str) -> DataFrame:
    """Rows in and out with the main statistics of the cleaned target."""
    stats = clean.agg(
        F.count(F.lit(1)).alias("n_clean"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"), F.count_distinct(group).alias("n_groups"),
    )
    middle = exact_quantiles(clean, [target], [0.5]).withColumnRenamed(f"{target}_p50", "median")
    both = one_row(raw.agg(F.count(F.lit(1)).alias("n_raw")), stats, middle)
    return both.withColumn("n_removed", F.col("n_raw") - F.col("n_clean"))


def key_completeness(df: DataFrame, key: str, sentinel: str = "unknown") -> DataFrame:
    """NULL, blank and distinct keys, and the size of the sentinel group they make."""
    k = F.col(key)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(k.isNull()).alias("n_null"),
        F.count_if(F.trim(k) == "").alias("n_blank"),
        F.count_distinct(k).alias("n_distinct"),
        F.count_if(F.coalesce(k, F.lit(sentinel)) == sentinel).alias("n_sentinel"),
    )
