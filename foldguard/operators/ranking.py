"""Global and per-group order without sorting any group in one task.

Everything that needs an order over a whole table (ranks, exact quantiles, order
statistics, top fractions) goes through the two operators below.  Both range-partition
the rows by the full sort key, stage the result once, and then add what lies in the
partitions before: one number per partition.  A group that fills a third of the table
is spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stage

_LOCAL_BITS = 33  # Spark puts the partition number above the lowest 33 bits of its row ids
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def global_rank(df: DataFrame, order_by: Sequence[str | Column], rank_col: str = "rank") -> DataFrame:
    """Append the 1-based position of each row in the order ``order_by``.

    The order must be total (end it with a unique key).  One range shuffle, one staged
    table; the per-partition row counts are the only thing the driver sees.
    """
    order = [_as_column(c) for c in order_by]
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    )
    staged = stage(placed, "rank")
    part = F.shiftright("_row", _LOCAL_BITS).cast("int")
    sizes = sorted(staged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, ahead = [], 0
    for row in sizes:
        offsets.append((row["part"], ahead))
        ahead += row["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, _ahead bigint")
    return (
        staged.withColumn("_part", part)
        .join(F.broadcast(table), "_part")  # one row per partition
        .withColumn(rank_col, F.col("_ahead") + F.col("_row").bitwiseAND(F.lit(_LOCAL_MASK)) + 1)
        .drop("_row", "_part", "_ahead")
    )


def group_positions(
    df: DataFrame,
    group_cols: Sequence[str],
    order_by: Sequence[str | Column],
    weight: str,
    before_col: str = "before",
    total_col: str = "total",
) -> DataFrame:
    """Append the weight that lies before each row in its group, and the weight of the group.

    NULL keys are groups like any other; ``group_cols`` may be empty (the whole table is the group).
    A group is cut into pieces by the range partitions; running sums stay inside a
    piece, and only groups with more than one piece need a carry.  There are fewer of
    those than partitions, so the carry table is small whatever the data.
    """
    order = [_as_column(c) for c in order_by]
    keys = ["_part", *group_cols]
    placed = df.repartitionByRange(*[F.col(c) for c in group_cols], *order).withColumn(
        "_part", F.spark_partition_id()
    )
    staged = stage(placed, "positions")

    pieces = staged.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    cut = (
        pieces.groupBy(*group_cols)
        .agg(F.array_sort(F.collect_list(F.struct("_part", "_w"))).alias("_pieces"))  # <= one per partition
        .filter(F.size("_pieces") > 1)
    )
    carry = cut.select(*group_cols, F.explode("_pieces").alias("_p"), "_pieces").select(
        F.col("_p._part").alias("_part"),
        *group_cols,
        F.aggregate(
            F.filter("_pieces", lambda q: q["_part"] < F.col("_p._part")),
            F.lit(0).cast("bigint"),
            lambda acc, q: acc + q["_w"],
        ).alias("_carry"),
        F.aggregate("_pieces", F.lit(0).cast("bigint"), lambda acc, q: acc + q["_w"]).alias("_all"),
    )

    carry = carry.withColumnsRenamed({k: f"_c{i}" for i, k in enumerate(keys)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)])
    piece = Window.partitionBy(*keys)
    inside = piece.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = staged.withColumns(
        {"_upto": F.sum(weight).over(inside), "_piece": F.sum(weight).over(piece)}
    )
    return (
        running.join(F.broadcast(carry), same, "left")  # at most two rows per partition
        .withColumns(
            {
                before_col: F.col("_upto") - F.col(weight) + F.coalesce("_carry", F.lit(0)),
                total_col: F.coalesce("_all", "_piece"),
            }
        )
        .drop("_part", "_upto", "_piece", "_carry", "_all", *[f"_c{i}" for i in range(len(keys))])
    )


def value_positions(
    df: DataFrame, group_cols: Sequence[str], value: str, copies: Column | None = None
) -> DataFrame:
    """Distinct non-null values per group with ``n`` (copies), ``before`` and ``total``.

    Copies are counted before the shuffle, so one value held by a third of the rows is
    one row here.  ``copies`` is the aggregate to count with where rows stand for several.
    """
    copies = F.count(F.lit(1)) if copies is None else copies
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group_cols, value).agg(copies.alias("n"))
    return group_positions(counts, group_cols, [value], "n")


def _at(position: Column, value: str) -> Column:
    inside = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
    return F.max(F.when(inside, F.col(value)))


def quantile_name(column: str, prob: float) -> str:
    text = f"{prob * 100:g}".replace(".", "_")
    return f"{column}_p{text}"


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], group_cols: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns in one pass.

    The columns are stacked first, so any number of them costs one sort.  One row per
    group; columns ``<column>_p<percent>``, NULL where a group has no value.
    """
    groups = list(group_cols)
    pairs = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]
    long = df.select(*groups, F.explode(F.array(*pairs)).alias("_s")).select(*groups, "_s.*")
    placed = value_positions(long, [*groups, "_column"], "_value")
    ends = []
    for i, q in enumerate(probs):
        h = (F.col("total") - 1) * F.lit(float(q))
        ends += [
            _at(F.floor(h), "_value").alias(f"_lo{i}"),
            _at(F.ceil(h), "_value").alias(f"_hi{i}"),
            F.max(h - F.floor(h)).alias(f"_f{i}"),
        ]
    found = placed.groupBy(*groups, "_column").agg(*ends)
    exact = found.select(
        *groups,
        "_column",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"_q{i}")
            for i in range(len(probs))
        ],
    )
    return exact.groupBy(*groups).agg(
        *[
            F.max(F.when(F.col("_column") == c, F.col(f"_q{i}"))).alias(quantile_name(c, q))
            for c in columns
            for i, q in enumerate(probs)
        ]
    )


def order_statistic(df: DataFrame, value: str, rank: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """The ``rank``-th smallest value per group (1-based); ``rank`` may use ``total``."""
    placed = value_positions(df, list(group_cols), value)
    return placed.groupBy(*group_cols).agg(
        _at(rank - 1, value).alias(value), F.max("total").alias("n")
    )


def average_ranks(df: DataFrame, value: str, rank_col: str, copies: Column | None = None) -> DataFrame:
    """Distinct values with their tie-averaged rank and number of copies ``n``."""
    return value_positions(df, [], value, copies).select(
        value, (F.col("before") + (F.col("n") + 1) / 2).alias(rank_col), "n"
    )


def quantile_bins(value: Column, inner_edges: Sequence[float]) -> Column:
    """Bin number 0…len(edges): how many inner edges the value has reached."""
    out = F.lit(0)
    for edge in inner_edges:
        out = out + (value >= F.lit(float(edge))).cast("int")
    return out
