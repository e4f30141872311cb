"""The model-ready matrix: imputed numbers with flags, binaries, top-N one-hot columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import family, safe_name, safe_names
from ..functions.descriptors import (
    SITE_RADII, octahedral_factor, tau_factor, tolerance_factor, weighted_reference,
)
from ..functions.text import flag_text, max_number, numeric_or_null
from ..session import stage
from .profile import fold_value_counts, top_values
from .ranking import _at, exact_quantiles, group_positions

UNKNOWN = "unknown"  # fixed value: the category that stands for NULL


@dataclass(frozen=True)
class FeatureSpec:
    """Which raw columns become which features (output name: raw column)."""

    target: str
    group: str
    numeric: Mapping[str, str] = field(default_factory=dict)
    number_text: Mapping[str, str] = field(default_factory=dict)
    flags: Mapping[str, str] = field(default_factory=dict)
    categories: Mapping[str, str] = field(default_factory=dict)
    top_n: int = 15
    descriptors: bool = False
    share_prefixes: Sequence[str] = ("A", "B", "X")

    @property
    def imputed(self) -> list[str]:
        return [*self.numeric, *self.number_text]


def named_category(column: str, missing: str = UNKNOWN) -> Column:
    """NULL becomes a category of its own; letter case is left alone."""
    return F.coalesce(F.col(column).cast("string"), F.lit(missing))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of several columns from one sort (one row comes to the driver)."""
    if not columns:
        return {}
    row = exact_quantiles(df, columns, [0.5]).first()
    return {c: row[f"{c}_p50"] for c in columns}


def impute(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    """Append a 0/1 ``_missing`` flag per column, then fill its NULLs."""
    flagged = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in fills})
    return flagged.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def median_impute(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return impute(df, medians(df, columns))


def top_categories(df: DataFrame, columns: Sequence[str], n: int) -> dict[str, tuple[list[str], bool]]:
    """Per column the ``n`` most frequent categories and whether there are others; one shuffle for all."""
    pairs = [F.struct(F.lit(c).alias("column"), named_category(c).alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*pairs))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = top_values(counts, ["column"], "value", n + 1).collect()  # at most (n + 1) rows per column
    out = {}
    for c in columns:
        ordered = [r["value"] for r in sorted((r for r in best if r["column"] == c), key=lambda r: r["place"])]
        out[c] = (ordered[:n], len(ordered) > n)
    return out


def bucket_rare(column: str, kept: Sequence[str], rare: str) -> Column:
    value = named_category(column)
    return F.when(value.isin(*kept), value).otherwise(F.lit(rare)) if kept else F.lit(rare)


def one_hot(column: str, prefix: str, kept: Sequence[str], has_rare: bool) -> dict[str, Column]:
    """0/1 columns ``prefix_value``; the rare bucket's value is itself ``prefix_other``."""
    rare = f"{prefix}_other"
    bucket = bucket_rare(column, kept, rare)
    values = sorted([*kept, rare] if has_rare and rare not in kept else kept)
    names = safe_names([f"{prefix}_{v}" for v in values])
    return {name: (bucket == v).cast("int") for name, v in zip(names, values)}


def add_descriptors(
    df: DataFrame, radii: Mapping[str, Mapping[str, float]] = SITE_RADII, sites: Sequence[str] = ("A", "B", "X")
) -> DataFrame:
    """Append three ratio descriptors with median fill and one shared missing flag."""
    a, b, x = (weighted_reference(s, radii[s], df.columns) for s in sites)
    names = ["tolerance_factor", "octahedral_factor", "tau_factor"]
    raw = df.withColumns({"_ra": a, "_rb": b, "_rx": x})
    ra, rb, rx = F.col("_ra"), F.col("_rb"), F.col("_rx")
    raw = raw.withColumns(
        dict(zip(names, (tolerance_factor(ra, rb, rx), octahedral_factor(rb, rx), tau_factor(ra, rb, rx))))
    ).drop("_ra", "_rb", "_rx")
    gone = F.lit(False)
    for n in names:
        gone = gone | F.col(n).isNull()
    flagged = raw.withColumn("descriptor_missing", gone.cast("int"))
    fills = medians(raw, names)
    return flagged.withColumns({n: F.coalesce(F.col(n), F.lit(fills[n])) for n in names})


def raw_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The matrix before anything is learned from data: NULLs and category texts are kept."""
    shares = family(df.columns, spec.share_prefixes)
    numbers = {n: numeric_or_null(F.col(c)) for n, c in spec.numeric.items()}
    numbers |= {n: max_number(F.col(c)) for n, c in spec.number_text.items()}
    return df.select(
        *shares,
        *[c.alias(n) for n, c in numbers.items()],
        *[c.isNull().cast("int").alias(f"{n}_missing") for n, c in numbers.items()],
        *[flag_text(F.col(c)).alias(n) for n, c in spec.flags.items()],
        *[named_category(c).alias(f"{n}_category") for n, c in spec.categories.items()],
        spec.target,
        spec.group,
    )


def build_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """The full matrix: only share, numeric and 0/1 columns, the target and the group key.

    The parsed columns are staged once, because three passes need them: medians, top
    categories, and the matrix itself, which is one projection.
    """
    raw = stage(raw_features(df, spec), "raw-features")
    fills = medians(raw, spec.imputed)
    kept = top_categories(raw, [f"{n}_category" for n in spec.categories], spec.top_n) if spec.categories else {}
    hot: dict[str, Column] = {}
    for n in spec.categories:
        values, has_rare = kept[f"{n}_category"]
        hot |= one_hot(f"{n}_category", n, values, has_rare)
    out = raw.select(
        *family(raw.columns, spec.share_prefixes),
        *[F.coalesce(F.col(n), F.lit(fills[n])).alias(n) for n in spec.imputed],
        *[f"{n}_missing" for n in spec.imputed],
        *spec.flags,
        *[c.alias(n) for n, c in hot.items()],
        spec.target,
        spec.group,
    )
    if spec.descriptors:
        out = add_descriptors(out)
    return out.toDF(*[safe_name(c) for c in _collision_checked(out.columns)])


def _collision_checked(columns: Sequence[str]) -> Sequence[str]:
    safe_names(columns)
    return columns


def fold_local_fills(df: DataFrame, fold: str, folds: int, columns: Sequence[str]) -> DataFrame:
    """Per fold the exact medians of the other folds, one row per fold, from counts per value."""
    long = None
    for c in columns:
        part = fold_value_counts(df.select(fold, F.col(c).cast("double").alias("_v")), fold, folds, "_v").withColumn(
            "_column", F.lit(c)
        )
        long = part if long is None else long.unionByName(part)
    placed = group_positions(long, ["_column", "fold"], ["_v"], "n")
    h = (F.col("total") - 1) * F.lit(0.5)
    middle = placed.groupBy("fold", "_column").agg(
        ((_at(F.floor(h), "_v") + _at(F.ceil(h), "_v")) / 2.0).alias("_m")
    )
    return middle.groupBy("fold").agg(
        *[F.max(F.when(F.col("_column") == c, F.col("_m"))).alias(f"{c}_median") for c in columns]
    )


def fold_local_table(
    df: DataFrame, fold: str, folds: int, numeric: Sequence[str], categories: Sequence[str], top_n: int
) -> DataFrame:
    """What each training part (all folds but one) knows: one row per fold with medians and top lists.

    Everything comes from totals minus the fold, so rows are never copied per fold.
    """
    table = fold_local_fills(df, fold, folds, numeric)
    for c in categories:
        counts = fold_value_counts(df.select(fold, named_category(c).alias("_v")), fold, folds, "_v")
        lists = top_values(counts, ["fold"], "_v", top_n).groupBy("fold").agg(F.collect_set("_v").alias(f"_top_{c}"))
        table = table.join(lists, "fold", "left")
    return table


def fold_local_features(
    df: DataFrame, fold: str, folds: int, numeric: Sequence[str], categories: Sequence[str], top_n: int
) -> DataFrame:
    """Impute and bucket every row with what the training part of its own fold knows.

    This is the held-out side of a fold-local preprocessing; categories that are rare or
    unseen in a training part become ``<column>_other``.
    """
    table = fold_local_table(df, fold, folds, numeric, categories, top_n)
    joined = df.join(F.broadcast(table.withColumnRenamed("fold", fold)), fold, "left")  # one row per fold
    return _preprocessed(joined, numeric, categories).drop(
        *[f"{c}_median" for c in numeric], *[f"_top_{c}" for c in categories]
    )


def _preprocessed(df: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    flagged = df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in numeric})
    kept = {c: F.array_contains(f"_top_{c}", named_category(c)) for c in categories}
    return flagged.withColumns(
        {c: F.coalesce(F.col(c), F.col(f"{c}_median")) for c in numeric}
        | {c: F.when(kept[c], named_category(c)).otherwise(F.lit(f"{c}_other")) for c in categories}
    )


def preprocessed_for_fold(
    df: DataFrame, table: DataFrame, f: int, numeric: Sequence[str], categories: Sequence[str] = ()
) -> DataFrame:
    """All rows, preprocessed with what the training part of fold ``f`` knows (for that fold's model)."""
    row = table.filter(F.col("fold") == f).first()
    known = {f"{c}_median": F.lit(row[f"{c}_median"]) for c in numeric}
    known |= {f"_top_{c}": F.lit(list(row[f"_top_{c}"])) for c in categories}
    return _preprocessed(df.withColumns(known), numeric, categories).drop(*known)


def scale_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column (1 where a column is constant)."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardize(df: DataFrame, parameters: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in parameters.items()})


def vector_scale_parameters(df: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per position of an array column."""
    rows = (
        df.select(F.posexplode(vector).alias("i", "v"))
        .groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
        .orderBy("i").collect()  # one row per dimension
    )
    return [r["m"] for r in rows], [r["s"] or 1.0 for r in rows]


def standardize_vector(df: DataFrame, vector: str, means: Sequence[float], stds: Sequence[float]) -> DataFrame:
    moved = F.zip_with(F.col(vector).cast("array<double>"), F.lit(list(means)), lambda v, m: v - m)
    return df.withColumn(vector, F.zip_with(moved, F.lit(list(stds)), lambda v, s: v / s))


__all__ = [
    "FeatureSpec", "add_descriptors", "bucket_rare", "build_features", "fold_local_features", "fold_local_fills", "fold_local_table",
    "impute", "median_impute", "medians", "named_category", "one_hot", "preprocessed_for_fold", "raw_features",
    "scale_parameters", "standardize", "standardize_vector", "top_categories", "vector_scale_parameters",
]
