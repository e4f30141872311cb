"""Where two versions of a table differ, from a tree of fingerprints over the key.

Rows fall into ranges of the hash of their key; a range's fingerprint is the number of its rows and two sums of row hashes, which do not depend
on order. Sums add up, so the ranges of a level above need no second look at the rows, and a tree can be written once per version.
Two trees are compared from the root: only ranges that differ are opened, and only rows in the
smallest ranges that differ are read in full and matched by key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..session import stage

DEPTH, DIGIT_BITS = 4, 4  # 16 ranges below each, 65,536 at the lowest level
_SUMS = ["n", "h1", "h2"]


def _range(keys: Sequence[str], level: int, depth: int) -> Column:
    top = md5_bucket("range", *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])
    return F.shiftright(top, 32 - DIGIT_BITS * level)


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]
    return F.xxhash64(F.lit(seed), *[x for s in shown for x in (F.length(s), s)]).cast("decimal(20,0)")


def fingerprint_tree(df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, depth: int = DEPTH) -> DataFrame:
    """``level, place, n, h1, h2`` of every range that has rows, the root's level being 0; one scan, written."""
    columns = list(columns or sorted(df.columns))
    lowest = df.groupBy(_range(keys, depth, depth).alias("place")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(_row_hash(columns, s)).cast("decimal(38,0)").alias(f"h{s}") for s in (1, 2)]
    )
    lowest = stage(lowest, "fingerprints")
    levels = [lowest.select(F.lit(depth).alias("level"), "place", *_SUMS)]
    for level in range(depth - 1, -1, -1):
        above = F.shiftright("place", DIGIT_BITS * (depth - level))
        levels.append(lowest.groupBy(above.alias("place")).agg(*[F.sum(c).cast(lowest.schema[c].dataType).alias(c) for c in _SUMS]).select(F.lit(level).alias("level"), "place", *_SUMS))
    return stage(reduce(DataFrame.unionByName, levels), "fingerprint-tree")


def differing_ranges(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``place`` of the lowest ranges that differ, found from the root down; empty for equal tables."""
    open_ranges = None
    for level in range(depth + 1):
        sides = [t.filter(F.col("level") == level).select("place", *[F.col(c).alias(f"{c}_{s}") for c in _SUMS]) for t, s in ((a, "a"), (b, "b"))]
        if open_ranges is not None:
            parent = F.shiftright("place", DIGIT_BITS)
            sides = [s.join(open_ranges, parent == F.col("parent"), "left_semi") for s in sides]
        both = sides[0].join(sides[1], "place", "full_outer")
        unequal = reduce(lambda x, y: x | y, [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in _SUMS])
        found = stage(both.filter(unequal).select(F.col("place").cast("bigint").alias("parent")), "differing")
        if found.isEmpty():
            return found.select(F.col("parent").alias("place")).limit(0)
        open_ranges = found
    return open_ranges.select(F.col("parent").alias("place"))


def located_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """The rows that differ, and how many rows were read in full.

    The first table has the key columns, ``kind`` (``removed``, ``added``, ``changed``), ``n_a`` and ``n_b``: copies of the key on both sides. A key
    whose rows are the same on both sides, copies included, is not listed. NULL keys match NULL keys. The second has ``n_total, n_read`` over
    both sides. Both tables must have the same columns, in any order.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the versions have different columns")
    columns = sorted(a.columns)
    trees = [fingerprint_tree(t, keys, columns, depth) for t in (a, b)]
    places = stage(differing_ranges(*trees, depth), "differing-places")
    sides = []
    for t, s in ((a, "a"), (b, "b")):
        near = t.join(F.broadcast(places), _range(keys, depth, depth) == F.col("place"), "left_semi")  # at most 16 ** depth numbers
        sides.append(
            near.groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(
                F.count(F.lit(1)).alias(f"n_{s}"), *[F.sum(_row_hash(columns, x)).alias(f"h{x}_{s}") for x in (1, 2)]
            )
        )
    left = sides[0].withColumnsRenamed({f"k{i}": f"a{i}" for i in range(len(keys))})
    same = reduce(lambda x, y: x & y, [F.col(f"a{i}").eqNullSafe(F.col(f"k{i}")) for i in range(len(keys))])
    both = stage(left.join(sides[1], same, "full_outer"), "differing-keys")
    unequal = ~(F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("h1_a").eqNullSafe(F.col("h1_b")) & F.col("h2_a").eqNullSafe(F.col("h2_b")))
    kind = F.when(F.col("n_b").isNull(), "removed").when(F.col("n_a").isNull(), "added").otherwise("changed")
    zero = F.lit(0).cast("bigint")
    listed = both.filter(unequal).select(
        *[F.when(F.col("n_a").isNull(), F.col(f"k{i}")).otherwise(F.col(f"a{i}")).alias(k) for i, k in enumerate(keys)],
        kind.alias("kind"), F.coalesce("n_a", zero).alias("n_a"), F.coalesce("n_b", zero).alias("n_b"),
    )
    total = reduce(DataFrame.unionByName, trees).filter("level = 0").agg(F.coalesce(F.sum("n"), zero).alias("n_total"))
    read = both.agg((F.coalesce(F.sum("n_a"), zero) + F.coalesce(F.sum("n_b"), zero)).alias("n_read")).first().n_read
    return listed, total.withColumn("n_read", F.lit(read).cast("bigint"))
