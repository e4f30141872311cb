"""Exact quantiles of many groups by radix counting.

A double becomes a 64-bit key in the same order. The first digits of a group's order statistic follow from a histogram of the
keys' first digits; only rows that begin so are counted in the next pass, by their next digits, until the key is known in full. Histograms
are sums, combined before the shuffle, so no pass moves rows, whatever a group holds, and nothing is sorted but
the digits of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import importable, stage
from .ranking import quantile_name

DIGIT_BITS = 16
_PASSES = 64 // DIGIT_BITS


def _ordered(values: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles; both zeros are one number, NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def _doubles(keys: np.ndarray) -> np.ndarray:
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _arrow(change, names: Sequence[str], column: str, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            changed = change(batch.column(at).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(changed, kind) if i == at else c for i, c in enumerate(batch.columns)], list(names))

    return run


def _digits(key: Column, turn: int) -> Column:
    """The first ``turn`` digits of a key; the sign stays in front, so their order is the keys'."""
    return F.shiftright(key, 64 - DIGIT_BITS * turn) if turn else F.lit(0).cast("bigint")


def selected(df: DataFrame, value: str, positions: Sequence[Column], group_cols: Sequence[str] = ()) -> DataFrame:
    """``group_cols, total, s0, s1, …``: per group the values at these places (from 0, whole numbers; they may use ``total``).

    NULL values are left out, NULL keys are groups like any other. Four passes over the staged keys, each shuffles histograms only.
    """
    groups = [f"g{i}" for i in range(len(group_cols))]
    plain = df.filter(F.col(value).isNotNull()).select(*[F.col(c).alias(g) for c, g in zip(group_cols, groups, strict=True)], F.col(value).cast("double").alias("key"))
    kinds = ", ".join(f"{f.name} {'bigint' if f.name == 'key' else f.dataType.simpleString()}" for f in plain.schema)
    keys = stage(importable(plain).mapInArrow(_arrow(_ordered, plain.columns, "key", pa.int64()), kinds), "selection-keys")

    def same(prefix: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"{prefix}{g}")) for g in groups], F.lit(True))

    totals = keys.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))
    places = F.array(*[F.struct(F.lit(i).alias("slot"), p.cast("bigint").alias("rest")) for i, p in enumerate(positions)])
    open_slots = totals.select(*groups, "total", F.lit(0).cast("bigint").alias("prefix"), F.explode(places).alias("s")).select(*groups, "total", "prefix", "s.*")
    open_slots = stage(open_slots, "selection-slots")
    for turn in range(1, _PASSES + 1):
        wanted = open_slots.select(*[F.col(g).alias(f"w_{g}") for g in groups], F.col("prefix").alias("w_prefix")).distinct()
        begun = keys if turn == 1 else keys.join(wanted, same("w_") & (_digits(F.col("key"), turn - 1) == F.col("w_prefix")), "left_semi")
        longer = _digits(F.col("key"), turn)
        counts = begun.groupBy(*groups, longer.alias("longer")).agg(F.count(F.lit(1)).alias("n"))
        upper = F.shiftright("longer", DIGIT_BITS) if turn > 1 else F.lit(0).cast("bigint")
        counts = counts.withColumn("upper", upper)
        along = Window.partitionBy(*groups, "upper").orderBy("longer").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** DIGIT_BITS rows
        ranked = counts.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
        renamed = ranked.select(*[F.col(g).alias(f"r_{g}") for g in groups], "upper", "longer", "before", "n")
        inside = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n"))
        met = open_slots.join(renamed, same("r_") & (F.col("prefix") == F.col("upper")) & inside)
        open_slots = stage(met.select(*groups, "total", F.col("longer").alias("prefix"), "slot", (F.col("rest") - F.col("before")).alias("rest")), "selection-slots")
    known = open_slots.select(*groups, "total", "slot", "prefix")
    kinds = ", ".join(f"{f.name} {'double' if f.name == 'prefix' else f.dataType.simpleString()}" for f in known.schema)
    values = known.mapInArrow(_arrow(_doubles, known.columns, "prefix", pa.float64()), kinds)
    out = values.groupBy(*groups).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("slot") == i, F.col("prefix"))).alias(f"s{i}") for i in range(len(positions))])
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, group_cols, strict=True)], "total", *[f"s{i}" for i in range(len(positions))])


def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], group_cols: Sequence[str]) -> DataFrame:
    """Exact linearly interpolated quantiles per group: ``group_cols, n_values`` and ``<value>_p<percent>``."""
    places, spans = [], []
    for q in probs:
        h = (F.col("total") - 1) * F.lit(float(q))
        spans.append(h)
        places += [F.floor(h), F.ceil(h)]
    found = selected(df, value, places, group_cols)
    between = [
        (F.col(f"s{2 * i}") + (F.col(f"s{2 * i + 1}") - F.col(f"s{2 * i}")) * (h - F.floor(h))).alias(quantile_name(value, q)) for i, (q, h) in enumerate(zip(probs, spans, strict=True))
    ]
    return found.select(*group_cols, F.col("total").alias("n_values"), *between)
