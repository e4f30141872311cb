"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

HOT_ROWS = 1_000_000  # rows of one key that one shuffle key takes


def lookup_by_key(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    size_col: str,
    hot_rows: int = HOT_ROWS,
    null_is_key: bool = False,
) -> DataFrame:
    """Attach ``table`` (one row per key, ``size_col`` = rows with that key) to every row.

    A key is spread over ``ceil(size / hot_rows)`` shuffle keys and its table row is copied
    as often, so a shuffle key takes about ``hot_rows`` rows however large the key is.  Rows
    learn the number from the staged list of keys with more than one; its true size tells
    Spark how to join it.  Rows without a key match nothing and are spread, unless
    ``null_is_key``: then NULL keys match NULL keys.
    """
    keys = list(keys)
    table = stage(table, "lookup")  # read twice below, and usually the result of a full scan
    names = {k: f"_t{i}" for i, k in enumerate(keys)}
    same = F.lit(True)
    no_key = F.lit(False)
    for k, n in names.items():
        same = same & (F.col(k).eqNullSafe(F.col(n)) if null_is_key else F.col(k) == F.col(n))
        no_key = no_key | F.col(k).isNull()
    salts = F.greatest(F.ceil(F.col(size_col) / F.lit(hot_rows)), F.lit(1))
    wide = table.withColumnsRenamed(names).withColumn("_salts", salts)
    hot = stage(wide.filter("_salts > 1").select(*names.values(), "_salts"), "hot-keys")
    draw = F.xxhash64(*[F.col(c) for c in rows.columns])
    salt = F.pmod(draw, F.coalesce("_salts", F.lit(1)))
    if not null_is_key:
        salt = F.when(no_key, draw).otherwise(salt)
    spread = rows.join(hot, same, "left").withColumn("_salt", salt).drop("_salts", *names.values())
    copies = wide.withColumn("_table_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop(size_col, "_salts")
    return spread.join(copies, same & (F.col("_salt") == F.col("_table_salt")), "left").drop(
        "_salt", "_table_salt", *names.values()
    )


def lookup_or_default(rows: DataFrame, table: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Left equi-join; columns named in ``defaults`` get that value where nothing matched."""
    joined = rows.join(table, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def members(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(chosen, list(keys), "left_semi")


def non_members(rows: DataFrame, chosen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(chosen, list(keys), "left_anti")


def match_difference(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-6
) -> DataFrame:
    """Compare two versions of a column by key: matches, one-sided keys, far pairs, largest gap."""
    a = left.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = right.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    both = F.col("_in_a") & F.col("_in_b")
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(both).alias("n_matched"),
        F.count_if(F.col("_in_b").isNull()).alias("n_only_left"),
        F.count_if(F.col("_in_a").isNull()).alias("n_only_right"),
        F.count_if(both & (gap > tolerance)).alias("n_different"),
        F.max(gap).alias("max_abs_diff"),
    )
