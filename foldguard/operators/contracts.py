"""Data contracts: hard violations raise, soft ones are reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import numeric_or_null

# Name prefixes of columns that are only known after the outcome.
LEAKAGE_PREFIXES = (
    "JV_", "EQE_", "Stabilised_", "Stabilized_", "Stability_",
    "Outdoor_", "MPP_", "Voc", "Jsc", "Encapsulation_", "Module_",
)
SHARE_SUM_RANGE = (0.98, 1.02)


class ContractError(ValueError):
    """A table breaks a contract that later steps rely on."""


def leaking_columns(columns: Sequence[str], prefixes: Sequence[str] = LEAKAGE_PREFIXES) -> list[str]:
    return [c for c in columns if c.startswith(tuple(prefixes))]


def clean_violations(df: DataFrame, target: str, lower: float, upper: float) -> DataFrame:
    """One row of counts over the whole table: rows, non-numeric and out-of-range targets."""
    value = numeric_or_null(F.col(target))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(value.isNull()).alias("n_not_numeric"),
        F.count_if(~value.between(lower, upper)).alias("n_out_of_range"),
    )


def check_clean(df: DataFrame, target: str, group: str, lower: float, upper: float) -> dict:
    """Raise unless the cleaned table is non-empty with a numeric target inside its bounds."""
    if target not in df.columns:
        raise ContractError(f"no target column {target}")
    found = clean_violations(df, target, lower, upper).first().asDict()
    if found["n_rows"] == 0:
        raise ContractError("the cleaned table is empty")
    if found["n_not_numeric"]:
        raise ContractError(f"{found['n_not_numeric']} targets are not numeric")
    if found["n_out_of_range"]:
        raise ContractError(f"{found['n_out_of_range']} targets lie outside [{lower}, {upper}]")
    warnings = [] if group in df.columns else [f"no group column {group}: group splits are impossible"]
    return {"n_rows": found["n_rows"], "warnings": warnings}


def share_sum_violations(df: DataFrame, sites: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows per site whose positive share sum is not about 1, all sites in one pass."""
    low, high = SHARE_SUM_RANGE
    counts = []
    for prefix, names in sites.items():
        columns = [c for c in [*(f"{prefix}_{n}" for n in names), f"{prefix}_other"] if c in df.columns]
        total = F.lit(0.0)
        for c in columns:
            total = total + F.coalesce(F.col(c), F.lit(0.0))
        counts.append(F.count_if((total > 0) & ~total.between(low, high)).alias(f"n_bad_{prefix}"))
    return df.agg(*counts)


def all_null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    filled = df.agg(*[F.count(c).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if filled[f"c{i}"] == 0]


def check_features(
    df: DataFrame, target: str, group: str, sites: Mapping[str, Sequence[str]],
    forbidden: Sequence[str] = LEAKAGE_PREFIXES,
) -> dict:
    """Raise on post-outcome columns before any job runs; report share sums and empty columns."""
    features = [c for c in df.columns if c not in (target, group)]
    leaked = leaking_columns(features, forbidden)
    if leaked:
        raise ContractError(f"post-outcome columns among the features: {leaked}")
    if target not in df.columns:
        raise ContractError(f"no target column {target}")
    found = share_sum_violations(df, sites).first().asDict()
    warnings = [f"{name[6:]}: {n} rows whose shares do not sum to 1" for name, n in found.items() if n]
    empty = all_null_columns(df, features)
    if empty:
        warnings.append(f"columns without any value: {empty}")
    return {"n_features": len(features), "warnings": warnings}
