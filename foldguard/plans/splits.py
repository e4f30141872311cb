"""Group-safe split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import key_or_sentinel, normalize_key
from ..operators import splits as sp
from .base import HALF_CUT, SPELLED, TEST_CUT, query, rounded, spelled_orders, sql_bucket, sql_draw, table

_KEYED = "keyed AS (SELECT o_orderkey, o_custkey, coalesce(CAST(nullif(o_custkey % 37, 0) AS VARCHAR), 'unknown') AS grp FROM orders)"


def keyed_orders(spark, sf_dir):
    """Orders with a text group key of which one value stands for NULL."""
    m = F.pmod("o_custkey", F.lit(37))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", key_or_sentinel(F.when(m != 0, m)).alias("grp")
    )


@query("G1 G2", f"""WITH {_KEYED}
SELECT o_orderkey, grp, CASE WHEN {sql_bucket(42, 'grp')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split FROM keyed""")
def holdout_hash(spark, sf_dir):
    return keyed_orders(spark, sf_dir).select(
        "o_orderkey", "grp", sp.hash_holdout(F.col("grp"), "0.2").alias("split")
    )


@query("G2", f"""
WITH g AS (SELECT o_custkey, row_number() OVER (ORDER BY {sql_draw(42, 'o_custkey')}, o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM orders))
SELECT o_orderkey, o_custkey, CASE WHEN r <= (SELECT ceil(0.2 * count(*)) FROM g) THEN 'test' ELSE 'train' END AS split
FROM orders JOIN g USING (o_custkey)""")
def holdout_exact(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sp.exact_holdout(o, "o_custkey", "0.2")


@query("G3 G4", f"""
SELECT o_orderkey, CAST({sql_bucket(42, 'o_custkey')} % 5 AS INTEGER) AS group_fold, CAST({sql_bucket(42, 'o_orderkey')} % 5 AS INTEGER) AS row_fold FROM orders""")
def kfold_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", sp.hash_fold(F.col("o_custkey"), 5).alias("group_fold"),
        sp.hash_fold(F.col("o_orderkey"), 5).alias("row_fold"),
    )


_GREEDY = f"""
WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey),
o AS (SELECT *, row_number() OVER (ORDER BY size DESC, o_custkey) AS i, row_number() OVER (PARTITION BY size ORDER BY {sql_draw(42, 'o_custkey')}, o_custkey) AS r FROM g),
walk(i, loads, fold) AS (
  SELECT CAST(0 AS BIGINT), [0, 0, 0, 0, 0]::BIGINT[], 0
  UNION ALL
  SELECT o.i, list_transform(w.loads, lambda x, j: CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN x + o.size ELSE x END),
         CAST(list_position(w.loads, list_min(w.loads)) - 1 AS INTEGER)
  FROM walk w JOIN o ON o.i = w.i + 1)"""


@query("G3", f"""{_GREEDY},
quota AS (SELECT size, fold, count(*) AS q FROM walk JOIN o USING (i) GROUP BY size, fold),
ends AS (SELECT size, fold, sum(q) OVER (PARTITION BY size ORDER BY fold) AS hi, sum(q) OVER (PARTITION BY size ORDER BY fold) - q AS lo FROM quota)
SELECT o_orderkey, orders.o_custkey, o.size AS group_rows, ends.fold
FROM orders JOIN o USING (o_custkey) JOIN ends ON ends.size = o.size AND o.r > ends.lo AND o.r <= ends.hi""")
def kfold_balanced(spark, sf_dir):
    """Each order's fold; the SQL hands out the groups one by one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folds = sp.group_fold_table(o, "o_custkey", 5)
    return sp.lookup_by_key(o, folds.withColumn("_size", F.col("group_rows")), ["o_custkey"], "_size")


@query("G3 G7", f"""{_GREEDY}
SELECT CAST(j AS INTEGER) AS fold, loads[j + 1] AS n_rows FROM (SELECT loads FROM walk ORDER BY i DESC LIMIT 1), range(5) t(j)""")
def kfold_balance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    folded = sp.balanced_group_folds(o, "o_custkey", 5)
    return folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("G3 G1", f"""
WITH g AS (SELECT CASE WHEN o_custkey % 37 > 0 THEN o_custkey END AS k, count(*) AS size FROM orders GROUP BY k),
t AS (SELECT sum(size) AS n FROM g), large AS (SELECT k, size FROM g, t WHERE size > n // 500),
p AS (SELECT k, size, sum(size) OVER (ORDER BY md5('42' || coalesce('|' || k, '')), k) - size AS before FROM g, t WHERE size <= n // 500),
r AS (SELECT (n - (SELECT coalesce(sum(size), 0) FROM large)) AS rest, coalesce((SELECT max(size) FROM large), 0) AS top FROM t),
-- At most one group is large here: it fills fold 0, and the others go up to one level.
lv AS (SELECT rest, top, greatest(0.0, (rest + top) / 5.0 - top) AS room0 FROM r),
e AS (SELECT *, (rest - room0) / CASE WHEN top > 0 THEN 4.0 ELSE 5.0 END AS room FROM lv)
SELECT k, size AS group_rows, CAST(least(4, (SELECT count(*) FROM range(5) f(i) WHERE (CASE WHEN top > 0 THEN room0 + i * room ELSE (i + 1) * room END) <= before)) AS INTEGER) AS fold FROM p, e
UNION ALL SELECT k, size, 0 FROM large""")
def kfold_dealt(spark, sf_dir):
    """Even folds of customers, a part of them under one NULL key, without a list of sizes on the driver."""
    o = table(spark, sf_dir, "orders").select(F.when(F.pmod("o_custkey", F.lit(37)) > 0, F.col("o_custkey")).alias("k"))
    return sp.dealt_fold_table(o, "k", 5, fineness=100)


@query("G5", f"""
SELECT o_orderkey, CASE WHEN {sql_bucket(7, 'o_custkey')} < {HALF_CUT} THEN 'test' ELSE 'calibration' END AS part
FROM orders WHERE {sql_bucket(42, 'o_custkey')} < {TEST_CUT}""")
def nested_holdout(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    held = o.filter(sp.hash_holdout(F.col("o_custkey"), "0.2") == sp.TEST)
    return sp.nested_holdout(held, "o_custkey", "0.5").select("o_orderkey", "part")


@query("G6 U3", f"""WITH {SPELLED},
s AS (SELECT norm_key, CAST({sql_bucket(42, 'raw_key')} % 5 AS INTEGER) AS fold FROM normed WHERE raw_key IS NOT NULL)
SELECT norm_key, count(DISTINCT fold) AS n_sides, count(*) AS n_rows FROM s GROUP BY norm_key HAVING count(DISTINCT fold) > 1""")
def leaking_groups(spark, sf_dir):
    """Folds drawn on raw spellings leak groups; the same check on their own key finds none."""
    o = spelled_orders(spark, sf_dir).filter(F.col("raw_key").isNotNull())
    folded = o.select(
        normalize_key(F.col("raw_key")).alias("norm_key"), "raw_key", sp.hash_fold(F.col("raw_key"), 5).alias("fold")
    )
    sp.assert_group_disjoint(folded, "raw_key", "fold")
    return sp.groups_on_two_sides(folded, "norm_key", "fold")


@query("G7", f"""WITH {_KEYED},
s AS (SELECT *, CASE WHEN {sql_bucket(42, 'grp')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split FROM keyed)
SELECT split, count(*) AS n_rows, count(DISTINCT grp) AS n_groups, count(*) FILTER (grp = 'unknown') AS n_sentinel,
       round(count(*) / (SELECT count(*) FROM s), 9) AS row_share FROM s GROUP BY split""")
def split_report(spark, sf_dir):
    k = keyed_orders(spark, sf_dir).withColumn("split", sp.hash_holdout(F.col("grp"), "0.2"))
    return rounded(sp.split_report(k, "grp", "split"), {"row_share": 9})


@query("G8", f"SELECT o_orderkey FROM orders ORDER BY {sql_draw(42, 'o_orderkey')}, o_orderkey LIMIT 300")
def exact_sample(spark, sf_dir):
    return sp.exact_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 300)
