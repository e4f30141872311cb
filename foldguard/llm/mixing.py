"""Mixing of sources to target weights by Poisson replication.

The target weight of a source and the bytes that it holds give the mean number of times that each of its documents must
occur. Each document draws its number from a Poisson distribution with that mean, by inverting the distribution at a uniform
number hashed from the seed and the document's id, and is repeated that often. All rows are then put in one global order by
a second hash. No draw depends on another row, so a lost executor repeats the same draws.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import shuffle_parts

#: Means above this are drawn as sums of smaller Poisson numbers, which keeps exp(-mean) representable.
BLOCK_MEAN = 64.0
BLOCK_TERMS = 200  # the distribution function of a block is 1 to double precision from here on


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)


def source_rates(docs: DataFrame, weights: DataFrame | None = None, flatten: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``mix_source, n_docs, n_bytes, rate``: how often a document of each source occurs on average.

    ``weights`` has columns ``source, weight`` (any positive scale; sources that it lacks get weight 0). Without it the weight of a
    source is its size to the power ``flatten``: below 1, small sources gain. The mix holds ``epochs`` times the bytes of
    the input. A NULL source is a source like any other; sources without a byte count as one byte.
    """
    sizes = docs.select(F.col("source").cast("string").alias("mix_source"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes")).groupBy("mix_source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("bytes").cast("bigint")).alias("n_bytes")
    )
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.greatest("n_bytes", F.lit(1)).cast("double"), F.lit(float(flatten))))
    else:
        given = weights.select(F.col("source").cast("string").alias("w_source"), F.col("weight").cast("double").alias("weight"))
        joined = sizes.join(given, sizes.mix_source.eqNullSafe(given.w_source), "left").drop("w_source")
        weighted = joined.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    weighted = stage(weighted, "source-weights")  # one row per source
    total = weighted.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight")).first()
    share = F.col("weight") / F.lit(total.all_weight or 1.0)
    rate = share * F.lit(total.all_bytes or 0) * F.lit(float(epochs)) / F.greatest("n_bytes", F.lit(1))
    return weighted.select("mix_source", "n_docs", "n_bytes", rate.alias("rate"))


def poisson_copies(docs: DataFrame, rates: DataFrame, seed: int = 0) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, whatever their names), ``rate`` and ``copies``; no row is left out.

    Documents of a source that ``rates`` lacks get 0 copies.
    """
    mean = F.col("rate") / F.col("blocks")
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(BLOCK_TERMS)])
    tabled = (
        rates.select("mix_source", "rate", F.greatest(F.ceil(F.col("rate") / BLOCK_MEAN), F.lit(1)).cast("int").alias("blocks"))
        .withColumn("terms", F.when(F.col("rate") > 0, F.transform(logs, lambda log, k: F.exp(k * F.ln(mean) - mean - log))))
        .withColumn("below", F.transform("terms", lambda _, k: F.aggregate(F.slice("terms", F.lit(1), k + 1), F.lit(0.0), lambda a, x: a + x)))
        .drop("terms")
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(tabled, F.col("row.source").cast("string").eqNullSafe(F.col("mix_source")), "left")
    # One draw for each block, hashed before it is compared with the terms.
    draws = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: uniform(F.lit(seed), F.lit("copies"), F.col("row.doc_id"), j))
    number = F.aggregate(draws, F.lit(0), lambda a, u: a + F.size(F.filter("below", lambda c: c <= u)))
    return joined.select("row", F.coalesce("rate", F.lit(0.0)).alias("rate"), F.when(F.col("rate") > 0, number).otherwise(F.lit(0)).alias("copies"))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """The mixed corpus: each row as often as drawn, in a global random order, with ``mix_rate, mix_copy, mix_order``.

    Rows that repeat a ``doc_id`` share their draw. A null text is a document of no bytes; a NULL ``doc_id`` draws as an empty
    id. An empty table gives no rows. ``mix_copy`` counts from 0, ``mix_order`` is the key of the order. Columns of
    ``docs`` are kept under their names; one that is named like the three new ones is an error.
    """
    taken = [c for c in docs.columns if c in ("mix_rate", "mix_copy", "mix_order")]
    if taken:
        raise ValueError(f"columns that the mix adds are there already: {', '.join(taken)}")
    drawn = poisson_copies(docs, rates, seed).filter("copies > 0")
    copies = drawn.select("row", "rate", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    ordered = copies.withColumn("place", key).repartitionByRange(partitions or shuffle_parts(docs), "place").sortWithinPartitions("place")
    return ordered.select("row.*", F.col("rate").alias("mix_rate"), F.col("copy").alias("mix_copy"), F.col("place").alias("mix_order"))
