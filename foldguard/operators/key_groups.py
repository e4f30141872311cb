"""Groups of keys that any of several normalisations ties together.

Two spellings belong together if one normalisation makes them equal, and so do spellings that are tied through others. A split by such a
group is safe under every one of the normalisations at once, and under any mix of them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..session import stage
from .joins import HOT_ROWS, lookup_by_key


def key_groups(df: DataFrame, key: str, ties: Mapping[str, Column]) -> DataFrame:
    """``key, key_group, n_keys`` for every distinct key that is not NULL; the group is named by its smallest key.

    ``ties`` are expressions over ``key``, or over columns that depend on it; where one is NULL it ties nothing. Rows that
    share a key are one. In a round, every key takes the smallest group among the keys that share one of its values, then its
    group's group; rounds go on until nothing changes, each written, so a lost executor repeats one.
    """
    names = [f"tie{i}" for i in range(len(ties))]
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("raw"), *[t.cast("string").alias(n) for n, t in zip(names, ties.values(), strict=True)]).distinct()
    long = rows.select("raw", F.explode(F.array(*[F.struct(F.lit(n).alias("tie"), F.col(n).alias("value")) for n in names])).alias("t")).select("raw", "t.*")
    edges = stage(long.filter("value IS NOT NULL").distinct(), "key-ties")
    groups = stage(rows.select("raw", F.col("raw").alias("grp")).distinct(), "key-groups")
    while True:
        of_value = edges.join(groups, "raw").groupBy("tie", "value").agg(F.min("grp").alias("least"), F.count(F.lit(1)).alias("size"))
        met = lookup_by_key(edges, of_value, ["tie", "value"], "size").groupBy(F.col("raw").alias("of")).agg(F.min("least").alias("least"))
        nearer = groups.join(met, F.col("raw") == F.col("of"), "left").select("raw", "grp", F.least("grp", "least").alias("new"))
        nearer = stage(nearer, "key-groups")
        jump = nearer.select(F.col("raw").alias("of"), F.col("new").alias("further"))
        moved = stage(nearer.join(jump, F.col("new") == F.col("of"), "left").select("raw", F.coalesce("further", "new").alias("grp"), F.col("grp").alias("old")), "key-groups")
        groups = moved.select("raw", "grp")
        if moved.filter("grp != old").isEmpty():
            break
    sizes = groups.groupBy(F.col("grp").alias("of")).agg(F.count(F.lit(1)).alias("n_keys")).withColumn("size", F.col("n_keys"))
    named = lookup_by_key(groups, sizes.withColumnRenamed("of", "grp"), ["grp"], "size")
    return named.select(F.col("raw").alias(key), F.col("grp").alias("key_group"), "n_keys")


def safe_folds(df: DataFrame, key: str, ties: Mapping[str, Column], folds: int, seed: int = 42, missing: str = "unknown", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``key_group`` and ``fold``: no two rows whose keys any tie joins are in different folds; rows without a key are one group."""
    table = key_groups(df, key, ties).drop("n_keys")
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    sized = table.join(counts, key)
    met = lookup_by_key(df, sized, [key], "_rows", hot_rows)
    group = F.coalesce(F.col("key_group").cast("string"), F.lit(missing))
    return met.withColumn("fold", F.pmod(md5_bucket(seed, group), F.lit(folds)).cast("int"))
