"""Quantiles and interval widths of many groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.selection import grouped_quantiles, selected
from .base import PRED, predictions, query, rounded, table


@query("A9 A7", """
WITH k AS (SELECT CASE WHEN o_custkey % 37 > 0 THEN o_custkey END AS k, o_totalprice AS price FROM orders)
SELECT k, count(*) AS n_values, round(quantile_cont(price, 0.1), 4) AS price_p10, round(quantile_cont(price, 0.5), 4) AS price_p50, round(quantile_cont(price, 0.95), 4) AS price_p95 FROM k GROUP BY k""")
def customer_quantiles(spark, sf_dir):
    """Quantiles of the price for every customer, a part of them under one NULL key."""
    o = table(spark, sf_dir, "orders").select(F.when(F.pmod("o_custkey", F.lit(37)) > 0, F.col("o_custkey")).alias("k"), F.col("o_totalprice").alias("price"))
    return rounded(grouped_quantiles(o, "price", [0.1, 0.5, 0.95], ["k"]), {"price_p10": 4, "price_p50": 4, "price_p95": 4})


@query("E3 E4 R4", f"""WITH {PRED}, e AS (SELECT l_suppkey, l_linenumber AS kind, abs(y - p) AS e, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY abs(y - p)) AS r, count(*) OVER (PARTITION BY l_suppkey, l_linenumber) AS n
  FROM (SELECT pred.*, pred.l_linenumber FROM pred))
SELECT l_suppkey, kind, any_value(n) AS n, round(max(e) FILTER (r = ceil((n + 1) * 9 / 10.0)), 4) AS width_90, round(max(e) FILTER (r = ceil((n + 1) * 8 / 10.0)), 4) AS width_80 FROM e GROUP BY l_suppkey, kind""")
def conformal_groups(spark, sf_dir):
    """Half-widths of split conformal intervals for every supplier and line number; NULL where a group is too small for the level."""
    e = predictions(spark, sf_dir).select("l_suppkey", F.col("l_linenumber").alias("kind"), F.abs(F.col("y") - F.col("p")).alias("e"))
    rank = lambda tenths: F.ceil((F.col("total") + 1) * tenths / 10) - 1
    out = selected(e, "e", [rank(9), rank(8)], ["l_suppkey", "kind"])
    return rounded(out.select("l_suppkey", "kind", F.col("total").alias("n"), F.col("s0").alias("width_90"), F.col("s1").alias("width_80")), {"width_90": 4, "width_80": 4})
