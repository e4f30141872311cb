"""Hashes that other SQL engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 1 << 32


def seeded_md5(seed: int | str, *cols: Column) -> Column:
    """md5 of ``seed|col|col…`` as hex text; a total order for ranking by chance."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def md5_bucket(seed: int | str, *cols: Column) -> Column:
    """The first 32 bits of :func:`seeded_md5` as a bigint in ``[0, 2**32)``."""
    number = F.conv(F.substring(seeded_md5(seed, *cols), 1, 8), 16, 10).cast("bigint")
    # Never NULL; saying so keeps the optimizer from hashing twice to filter NULLs before joins.
    return F.coalesce(number, F.lit(0).cast("bigint"))
