"""Linear models over a candidate space, axis by axis.

A linear score is a sum of one part per axis, as long as no feature is set by two axes. So a fitted model scores a space from a table of
parts per level, looked up by the digits of the candidate's number, and no candidate is ever encoded.

The best ``k`` candidates need no enumeration either. A level that ``k`` others of its axis beat cannot be in the list, whatever the
other axes hold, and a beginning that ``k`` beginnings beat cannot either. So Spark picks the ``k`` best levels of each axis, and
lists of ``k`` are merged from their best ends. Where only supported combinations of some axes count, those
combinations are one axis: the table of supported rows, scored by its parts.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .candidates import Axis, enumerate_space

#: Parts are exact decimals, so sums do not depend on their order and equal scores are ties.
PART = "decimal(28,9)"


def weight_map(weights: Sequence[float], features: Sequence[str]) -> tuple[float, dict[str, float]]:
    """Intercept and weight per feature from a solved model."""
    return float(weights[0]), {f: float(w) for f, w in zip(features, weights[1:], strict=True)}


def part_tables(cells: Mapping[str, DataFrame], weights: Mapping[str, float]) -> dict[str, DataFrame]:
    """Per axis ``level, part``: what each level adds to the score. ``cells`` hold ``level, feature, value`` rows, as for encoding.

    Features without a weight add nothing. A feature that several axes set has no parts and is an error.
    """
    known = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, float(w))]) if weights else F.lit(None).cast("map<string,double>")
    owners: dict[str, str] = {}
    out = {}
    for axis, rows in cells.items():
        met = rows.select(F.col("level").cast("string").alias("level"), "feature", F.col("value").cast("double").alias("value"), known[F.col("feature")].alias("weight"))
        for r in met.filter("weight IS NOT NULL").select("feature").distinct().collect():  # at most one row per weight
            if owners.setdefault(r.feature, axis) != axis:
                raise ValueError(f"{r.feature} is set by the axes {owners[r.feature]} and {axis}")
        out[axis] = met.groupBy("level").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).cast(PART).alias("part"))
    return out


def base_score(intercept: float, weights: Mapping[str, float], context: Mapping[str, float]) -> Decimal:
    """The score of a candidate whose axes add nothing."""
    return Decimal(repr(intercept + sum(weights.get(f, 0.0) * v for f, v in context.items()))).quantize(Decimal("1e-9"))


def _sum(base: Decimal, parts: Sequence[Column]) -> Column:
    total = F.lit(base).cast(PART)
    for p in parts:
        total = (total + p).cast(PART)
    return total


def score_space(spark: SparkSession, axes: Mapping[str, Axis], parts: Mapping[str, DataFrame], base: Decimal) -> DataFrame:
    """The enumerated space with ``score``; an axis without parts adds nothing."""
    out, found = enumerate_space(spark, axes), []
    for i, (axis, table) in enumerate(parts.items()):
        known = table.select(F.col("level").alias(f"_level{i}"), F.col("part").alias(f"_part{i}"))
        out = out.join(known, F.col(axis).cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
        found.append(F.coalesce(F.col(f"_part{i}"), F.lit(0).cast(PART)))
    return out.select("candidate_id", *axes, _sum(base, found).cast("double").alias("score"))


def axis_parts(levels: DataFrame, names: Sequence[str], parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of one or several axes (columns ``names``) with the sum of their parts; rows that repeat count once."""
    out, found = levels.select(*names).distinct(), []
    for i, name in enumerate(names):
        if name in parts:
            known = parts[name].select(F.col("level").alias(f"_level{i}"), F.col("part").alias(f"_part{i}"))
            out = out.join(known, F.col(name).cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
            found.append(F.coalesce(F.col(f"_part{i}"), F.lit(0).cast(PART)))
    return out.select(*names, _sum(Decimal(0), found).alias("part"))


def _merged(heads: list[tuple], axis: list[tuple], k: int) -> list[tuple]:
    """The ``k`` best sums of a beginning and a level; both lists come best first as ``(-score, key)``."""
    if not heads or not axis:
        return []
    join = lambda i, j: (heads[i][0] + axis[j][0], heads[i][1] + axis[j][1], i, j)
    waiting, out = [join(0, 0)], []
    while waiting and len(out) < k:
        score, key, i, j = heapq.heappop(waiting)
        out.append((score, key))
        if j + 1 < len(axis):
            heapq.heappush(waiting, join(i, j + 1))
        if j == 0 and i + 1 < len(heads):
            heapq.heappush(waiting, join(i + 1, 0))
    return out


def best_candidates(axes: Sequence[DataFrame], base: Decimal, k: int, distinct: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best combinations of rows of ``axes`` (columns of names, and ``part``), best first, with ``place`` and ``score``.

    Equal scores are ordered by the names, axis by axis. With ``distinct``, only the best of the combinations that agree in these names counts:
    an axis outside is its best row, an axis that is partly inside the best row for each of its names inside. The
    driver sees at most ``k`` rows of each axis. An axis without rows leaves no candidate.
    """
    spark = axes[0].sparkSession
    heads, names = [(-base, ())], []
    fields = []
    for axis in axes:
        own = [c for c in axis.columns if c != "part"]
        names += own
        fields += [axis.schema[c] for c in own]
        order = [F.col("part").desc(), *[F.col(c).asc() for c in own]]
        if distinct:
            inside = [c for c in own if c in distinct]
            if len(inside) < len(own):
                rank = F.struct(-F.col("part"), *own)
                axis = axis.groupBy(*inside).agg(F.min_by(F.struct(*own, "part"), rank).alias("best")).select("best.*")
                axis = axis.filter(F.col("part").isNotNull())
        rows = axis.orderBy(*order).limit(k).collect()
        heads = _merged(heads, [(-r["part"], tuple(r[c] for c in own)) for r in rows], k)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return spark.createDataFrame([(*key, float(-score), place) for place, (score, key) in enumerate(heads, 1)], f"{schema}, score double, place int")
