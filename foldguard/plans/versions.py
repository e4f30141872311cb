"""Queries that compare versions of a table, and that tie keys together."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..operators import key_groups, table_diff
from .base import SPELLED, query, spelled_orders, sql_bucket, table

_NEWER = """newer AS (
  SELECT CASE WHEN o_orderkey % 1009 = 5 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey,
         CASE WHEN o_orderkey % 1013 = 7 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice
  FROM orders WHERE o_orderkey % 1019 <> 11)"""


@query("S11 U4 J10 C13", f"""WITH {_NEWER}, older AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'removed' WHEN a.o_orderkey IS NULL THEN 'added' ELSE 'changed' END AS kind,
  CAST(a.o_orderkey IS NOT NULL AS BIGINT) AS n_a, CAST(b.o_orderkey IS NOT NULL AS BIGINT) AS n_b
FROM older a FULL JOIN newer b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_custkey <> b.o_custkey OR a.o_totalprice <> b.o_totalprice""")
def located_changes(spark, sf_dir):
    """Orders that were added, removed or changed in a newer version; only ranges whose fingerprints differ are read in full."""
    older = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    n = F.col("o_orderkey")
    newer = older.filter(F.pmod(n, F.lit(1019)) != 11).select(
        F.when(F.pmod(n, F.lit(1009)) == 5, n + 100_000_000).otherwise(n).alias("o_orderkey"), "o_custkey",
        F.when(F.pmod(n, F.lit(1013)) == 7, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_totalprice",
    )
    return table_diff.located_difference(older, newer, ["o_orderkey"])[0]


_GROUPS = f"""{SPELLED},
keys AS (SELECT DISTINCT raw_key, norm_key, CASE WHEN o_custkey % 10 IN (4, 5) THEN 'p' || o_custkey // 10 WHEN o_custkey % 10 IN (6, 7) THEN 'q' || o_custkey // 10 END AS pair,
  CASE WHEN o_custkey % 10 IN (5, 6) THEN 'r' || o_custkey // 10 END AS next FROM normed WHERE raw_key IS NOT NULL),
ties AS (SELECT DISTINCT a.raw_key AS x, b.raw_key AS y FROM keys a JOIN keys b ON a.norm_key = b.norm_key OR a.pair = b.pair OR a.next = b.next),
reach(x, y) AS (SELECT x, y FROM ties UNION SELECT r.x, t.y FROM reach r JOIN ties t ON t.x = r.y),
grp AS (SELECT x AS raw_key, min(y) AS key_group, count(*) AS n_keys FROM reach GROUP BY x)"""


def _ties():
    digit = F.pmod("o_custkey", F.lit(10))
    ten = F.floor(F.col("o_custkey") / 10).cast("string")
    return {
        "norm": normalize_key(F.col("raw_key")),
        "pair": F.when(digit.isin(4, 5), F.concat(F.lit("p"), ten)).when(digit.isin(6, 7), F.concat(F.lit("q"), ten)),
        "next": F.when(digit.isin(5, 6), F.concat(F.lit("r"), ten)),
    }


@query("A15 A17 P12", f"WITH RECURSIVE {_GROUPS} SELECT raw_key, key_group, n_keys FROM grp")
def tied_keys(spark, sf_dir):
    """Every spelling of a key with the group that normalising and two other ties put it in, directly or through others."""
    return key_groups.key_groups(spelled_orders(spark, sf_dir), "raw_key", _ties())


@query("G6 G3 G1", f"""WITH RECURSIVE {_GROUPS}
SELECT o_orderkey, key_group, CAST({sql_bucket(42, "coalesce(key_group, 'unknown')")} % 5 AS INTEGER) AS fold FROM normed LEFT JOIN grp USING (raw_key)""")
def tied_folds(spark, sf_dir):
    """Folds that keep every group of tied keys together."""
    return key_groups.safe_folds(spelled_orders(spark, sf_dir), "raw_key", _ties(), 5).select("o_orderkey", "key_group", "fold")
