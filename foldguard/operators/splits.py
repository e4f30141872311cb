"""Train/test splits and folds by group key: no group is ever on two sides.

The hash forms are plain expressions (no shuffle).  The exact forms shuffle the
distinct keys only; the rows never move for :func:`exact_holdout`.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS, md5_bucket, seeded_md5
from ..session import stage
from .joins import HOT_ROWS, lookup_by_key
from .ranking import global_rank, group_positions

TEST, TRAIN = "test", "train"


def hash_holdout(group: Column, test_fraction: float | str, seed: int = 42) -> Column:
    """Side of each row by group hash; the share of test groups is approximate."""
    cut = int(Decimal(str(test_fraction)) * BUCKETS)
    return F.when(md5_bucket(seed, group) < cut, F.lit(TEST)).otherwise(F.lit(TRAIN))


def hash_fold(key: Column, folds: int, seed: int = 42) -> Column:
    """Fold number by hash: of the group key (group folds) or of the row key (row folds)."""
    return F.pmod(md5_bucket(seed, key), F.lit(folds)).cast("int")


def exact_holdout(
    df: DataFrame, group: str, test_fraction: float | str, seed: int = 42, out: str = "split"
) -> DataFrame:
    """Exactly ``ceil(fraction * groups)`` whole groups on the test side.

    Groups are ordered by (hash, key); only the last test group's pair is fetched, and
    each row is then decided by comparing its own pair with it, without a join.
    """
    draw = seeded_md5(seed, F.col(group))
    groups = df.select(group).distinct().withColumn("_draw", draw)
    ranked = global_rank(groups, ["_draw", group])
    n = ranked.count()
    k = math.ceil(Decimal(str(test_fraction)) * n)
    if k == 0:
        return df.withColumn(out, F.lit(TRAIN))
    last = ranked.filter(F.col("rank") == k).select("_draw", group).first()
    key_type = df.schema[group].dataType
    drawn, key = F.lit(last["_draw"]), F.lit(last[group]).cast(key_type)
    is_test = (draw < drawn) | ((draw == drawn) & (F.col(group) <= key))
    return df.withColumn(out, F.when(is_test, F.lit(TEST)).otherwise(F.lit(TRAIN)))


def greedy_quota(size_counts: Iterable[tuple[int, int]], folds: int) -> list[tuple[int, list[int]]]:
    """How many groups of each size go to each fold when every group, largest first, goes to
    the lightest fold (lowest number first on a draw).

    Handing ``n`` groups of one size to the lightest fold one by one picks the ``n`` smallest
    loads among ``load_f, load_f + size, load_f + 2 size, …``; the level up to which all are
    taken is found by bisection, so a class costs O(folds · log) whatever its ``n``.
    """
    loads = [0] * folds
    plan = []
    for size, n in sorted(size_counts, reverse=True):

        def taken(level: int) -> list[int]:
            return [0 if level < load else (level - load) // size + 1 for load in loads]

        low, high = min(loads) - 1, max(loads) + size * n
        while high - low > 1:  # largest level whose picks do not exceed n
            middle = (low + high) // 2
            if sum(taken(middle)) <= n:
                low = middle
            else:
                high = middle
        quota = taken(low)
        left = n - sum(quota)
        for f in range(folds):
            if left and loads[f] + quota[f] * size == low + 1:
                quota[f] += 1
                left -= 1
        loads = [load + q * size for load, q in zip(loads, quota)]
        plan.append((size, quota))
    return plan


def balanced_group_folds(
    df: DataFrame, group: str, folds: int, seed: int = 42, out: str = "fold", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Group folds with equal numbers of rows: largest group first, to the lightest fold.

    The driver sees (size, number of groups) only, at most ``sqrt(2 · rows)`` pairs.
    Which groups of one size fill which fold is drawn by hash.
    """
    table = group_fold_table(df, group, folds, seed, out)
    return lookup_by_key(df, table, [group], "group_rows", hot_rows, null_is_key=True)


def group_fold_table(df: DataFrame, group: str, folds: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """One row per group: its number of rows and its fold."""
    spark = df.sparkSession
    groups = (
        df.groupBy(group)
        .agg(F.count(F.lit(1)).alias("group_rows"))
        .withColumns({"_draw": seeded_md5(seed, F.col(group)), "_one": F.lit(1).cast("bigint")})
    )
    placed = group_positions(groups, ["group_rows"], ["_draw", group], "_one")
    classes = placed.groupBy("group_rows").agg(F.count(F.lit(1)).alias("n")).collect()
    rows = []
    for size, quota in greedy_quota([(r["group_rows"], r["n"]) for r in classes], folds):
        ends, end = [], 0
        for q in quota:
            end += q
            ends.append(end)
        rows.append((size, ends))
    quotas = spark.createDataFrame(rows, "group_rows bigint, _ends array<bigint>")
    fold = F.size(F.filter("_ends", lambda e: e <= F.col("before")))
    return placed.join(quotas, "group_rows").select(group, "group_rows", fold.alias(out))


def largest_first(sizes: Sequence[int], folds: int) -> tuple[list[int], list[int]]:
    """The fold of each group, taken largest first to the lightest fold, and the folds' loads."""
    loads, out = [(0, f) for f in range(folds)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, f = heapq.heappop(loads)
        out[i] = f
        heapq.heappush(loads, (load + sizes[i], f))
    return out, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def filled_up(loads: Sequence[int], rows: int) -> list[float]:
    """How much of ``rows`` each fold gets so that all that get any end at one level."""
    order = sorted(loads)
    below, level = 0, float(order[0])
    for n, load in enumerate(order, 1):
        below += load
        level = (rows + below) / n
        if n == len(order) or level <= order[n]:
            break
    return [max(0.0, level - load) for load in loads]


def dealt_fold_table(df: DataFrame, group: str, folds: int, seed: int = 42, out: str = "fold", fineness: int = 1000) -> DataFrame:
    """One row per group: its number of rows and its fold, with even folds, without a list of group sizes on the driver.

    Groups of more than ``1 / (folds * fineness)`` of all rows are fewer than ``folds * fineness``: they go, largest first, to the lightest fold.
    All others stand in hash order, and the rows before a group say whose room it falls into: the rooms are what each fold lacks
    to the common level, one behind the other. A group that begins in a room belongs to it, so no fold misses the
    level by as much as one small group, that is by one ``fineness``-th of an even fold; only a fold
    that its large groups lift above the level stays above it. NULL is a group like any other.
    """
    groups = stage(
        df.groupBy(group).agg(F.count(F.lit(1)).alias("group_rows")).withColumn("_draw", seeded_md5(seed, F.col(group))), "group-sizes"
    )
    total = groups.agg(F.coalesce(F.sum("group_rows"), F.lit(0)).alias("n")).first().n
    most = total // (folds * fineness)
    large = groups.filter(F.col("group_rows") > most).select(group, "group_rows").orderBy(F.desc("group_rows"), "_draw", group).collect()
    chosen, loads = largest_first([r["group_rows"] for r in large], folds)
    rooms = filled_up(loads, total - sum(loads))
    ends = [sum(rooms[: f + 1]) for f in range(folds)]
    last = max(range(folds), key=lambda f: (rooms[f] > 0, f))  # what rounding leaves over
    small = group_positions(groups.filter(F.col("group_rows") <= most), [], ["_draw", group], "group_rows")
    room = F.least(F.size(F.filter(F.lit([float(e) for e in ends]), lambda e: e <= F.col("before"))), F.lit(last))
    placed = small.select(group, "group_rows", room.cast("int").alias(out))
    known = df.sparkSession.createDataFrame([(r[group], r["group_rows"], f) for r, f in zip(large, chosen, strict=True)], placed.schema)
    return placed.unionByName(known)


def dealt_group_folds(
    df: DataFrame, group: str, folds: int, seed: int = 42, out: str = "fold", fineness: int = 1000, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The rows with their group's fold of :func:`dealt_fold_table`."""
    table = dealt_fold_table(df, group, folds, seed, out, fineness)
    return lookup_by_key(df, table, [group], "group_rows", hot_rows, null_is_key=True)


def nested_holdout(df: DataFrame, group: str, fraction: float | str, seed: int = 7, out: str = "part") -> DataFrame:
    """Split a holdout once more by group: 'calibration' and 'test'."""
    side = hash_holdout(F.col(group), fraction, seed)
    return df.withColumn(out, F.when(side == TEST, F.lit("test")).otherwise(F.lit("calibration")))


def groups_on_two_sides(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups that break the split; empty for a valid one."""
    sides = df.groupBy(group).agg(F.count_distinct(side).alias("n_sides"), F.count(F.lit(1)).alias("n_rows"))
    return sides.filter(F.col("n_sides") > 1)


def assert_group_disjoint(df: DataFrame, group: str, side: str) -> None:
    """Raise with the number of broken groups; ``groups_on_two_sides`` has the groups themselves."""
    broken = groups_on_two_sides(df, group, side).count()
    if broken:
        raise ValueError(f"{broken} groups of {group} are on more than one side of {side}")


def split_report(df: DataFrame, group: str, side: str, sentinel: str = "unknown") -> DataFrame:
    """Rows, share and groups per side, and how many rows of the sentinel group it holds."""
    n = F.col("n_rows").cast("double")
    per_side = df.groupBy(side).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(group).alias("n_groups"),
        F.count_if(F.col(group).cast("string") == sentinel).alias("n_sentinel"),
    )
    packed = per_side.agg(F.sum("n_rows").alias("_all"), F.collect_list(F.struct("*")).alias("_sides"))
    return packed.select("_all", F.inline("_sides")).withColumn("row_share", n / F.col("_all")).drop("_all")


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same ``n`` rows on every run (a sampling operator: the limit is its purpose)."""
    return df.orderBy(seeded_md5(seed, F.col(key)), key).limit(n)
