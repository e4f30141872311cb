"""Rank, sort, top-k, set and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, joins, ranking, topk
from .aggregates import _PAIRED, order_pairs
from .base import LINE_KEY, PRED, predictions, query, rounded, table

LINE_KEY_SQL = ", ".join(LINE_KEY)

# Scores of parts: list price scaled by size (old) against the mean price it was sold for (new).
_SCORES = """
scores AS (
  SELECT p_partkey, p_brand, p_type, p_size, p_retailprice * p_size / 10 AS old, m AS new
  FROM part JOIN (SELECT l_partkey, CAST(round(avg(l_extendedprice) + 0.00137::DOUBLE, 2) AS DOUBLE) AS m FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"""


def part_scores(spark, sf_dir):
    # Means of cents often end in half a cent: moved off the rounding edge, here and in the SQL.
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.round(F.avg("l_extendedprice") + 0.00137, 2).alias("new")
    )
    part = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", (F.col("p_retailprice") * F.col("p_size") / 10).alias("old")
    )
    return part.join(sold, "p_partkey")


@query("R1", f"""WITH {PRED}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY p DESC, {LINE_KEY_SQL}) AS rank FROM pred""")
def global_rank(spark, sf_dir):
    ranked = ranking.global_rank(predictions(spark, sf_dir), [F.desc("p"), *LINE_KEY])
    return ranked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rank")


@query("R2", """
WITH x AS (SELECT CAST(p_size AS DOUBLE) AS a, p_retailprice AS b FROM part),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r""")
def spearman(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return rounded(audit.spearman(part, "a", "b"), {"rho": 9})


@query("R2", f"""WITH {PRED},
r AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ra, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rb FROM pred)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho FROM r""")
def spearman_predictions(spark, sf_dir):
    return rounded(audit.spearman(predictions(spark, sf_dir), "y", "p"), {"rho": 9})


@query("R3", f"""WITH {_PAIRED},
d AS (SELECT round(diff, 2) AS diff FROM diffs WHERE round(diff, 2) <> 0),
r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 AS r FROM d),
t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY abs(diff))),
s AS (SELECT count(*) AS n_used, coalesce(sum(r) FILTER (diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0)::DOUBLE AS w_minus FROM r)
SELECT n_used, w_plus, w_minus, least(w_plus, w_minus) AS w,
  round((least(w_plus, w_minus) - n_used * (n_used + 1) / 4.0::DOUBLE) / sqrt(n_used * (n_used + 1.0::DOUBLE) * (2 * n_used + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 8) AS z FROM s, t""")
def signed_rank(spark, sf_dir):
    diffs = rounded(order_pairs(spark, sf_dir), {"diff": 2})
    return rounded(audit.signed_rank(diffs, "diff"), {"z": 8})


@query("R3 A13", f"""WITH RECURSIVE {_PAIRED},
d AS (SELECT c_nationkey, round(diff, 2) AS diff FROM diffs JOIN customer ON c_custkey = o_custkey),
r AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY c_nationkey, abs(diff)) - 1) / 2.0 AS r FROM d WHERE diff <> 0),
t AS (SELECT c_nationkey, sum(n * n * n - n) AS ties FROM (SELECT c_nationkey, CAST(count(*) AS DOUBLE) AS n FROM d WHERE diff <> 0 GROUP BY c_nationkey, abs(diff)) GROUP BY c_nationkey),
z AS (SELECT c_nationkey, count(*) FILTER (diff = 0) AS n_zero FROM d GROUP BY c_nationkey),
s AS (SELECT c_nationkey, count(*) AS n_used, coalesce(sum(r) FILTER (diff > 0), 0)::DOUBLE AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0)::DOUBLE AS w_minus FROM r GROUP BY c_nationkey),
ways(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda w: coalesce(c[w + 1], 0) + CASE WHEN w > n THEN c[w - n] ELSE 0 END) FROM ways WHERE n < 50)
SELECT c_nationkey, n_used, n_zero, w_plus, w_minus, least(w_plus, w_minus) AS w,
  round((least(w_plus, w_minus) - n_used * (n_used + 1) / 4.0::DOUBLE) / sqrt(n_used * (n_used + 1.0::DOUBLE) * (2 * n_used + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE), 8) AS z,
  round(CASE WHEN ties = 0 AND n_zero = 0 AND n IS NOT NULL THEN least(1.0, 2 * list_sum(c[1:CAST(floor(least(w_plus, w_minus)) AS BIGINT) + 1]) / pow(2, n_used)) END, 9) AS p_exact
FROM s JOIN t USING (c_nationkey) JOIN z USING (c_nationkey) LEFT JOIN ways ON n = n_used""")
def signed_rank_groups(spark, sf_dir):
    """The test for each nation's customers; exact where they are few."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    diffs = rounded(order_pairs(spark, sf_dir), {"diff": 2}).join(nation, "o_custkey")
    return rounded(audit.signed_rank_by(diffs, "diff", ["c_nationkey"]), {"z": 8, "p_exact": 9})


@query("R4", f"""WITH {PRED},
e AS (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) AS q FROM pred)
SELECT (CASE WHEN p >= q[1] THEN 1 ELSE 0 END) + (CASE WHEN p >= q[2] THEN 1 ELSE 0 END) + (CASE WHEN p >= q[3] THEN 1 ELSE 0 END) AS bin, count(*) AS n
FROM pred, e GROUP BY bin""")
def quantile_bins(spark, sf_dir):
    df = predictions(spark, sf_dir)
    edges = ranking.exact_quantiles(df, ["p"], [0.25, 0.5, 0.75]).first()
    return df.groupBy(ranking.quantile_bins(F.col("p"), list(edges)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("R1 A9", f"""WITH {PRED}
SELECT round(quantile_cont(y, 0.01), 4) AS y_p1, round(quantile_cont(y, 0.5), 4) AS y_p50, round(quantile_cont(y, 0.999), 4) AS y_p99_9,
       round(quantile_cont(p, 0.01), 4) AS p_p1, round(quantile_cont(p, 0.5), 4) AS p_p50, round(quantile_cont(p, 0.999), 4) AS p_p99_9 FROM pred""")
def exact_quantiles(spark, sf_dir):
    out = ranking.exact_quantiles(predictions(spark, sf_dir), ["y", "p"], [0.01, 0.5, 0.999])
    return rounded(out, {c: 4 for c in out.columns})


@query("R5", f"""WITH {_SCORES},
r AS (SELECT *, rank() OVER (ORDER BY old) + (count(*) OVER (PARTITION BY old) - 1) / 2.0 AS ra, rank() OVER (ORDER BY new) + (count(*) OVER (PARTITION BY new) - 1) / 2.0 AS rb,
  row_number() OVER (ORDER BY old DESC, p_partkey) AS to_, row_number() OVER (ORDER BY new DESC, p_partkey) AS tn,
  row_number() OVER (PARTITION BY p_brand, p_type ORDER BY old DESC, p_partkey) AS bo, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY new DESC, p_partkey) AS bn FROM scores),
d_old AS (SELECT p_partkey FROM r WHERE bo = 1 ORDER BY old DESC, p_partkey LIMIT 30),
d_new AS (SELECT p_partkey FROM r WHERE bn = 1 ORDER BY new DESC, p_partkey LIMIT 30)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho, max(old) AS ceiling_old, max(new) AS ceiling_new, round(avg(abs(new - old)), 4) AS mean_abs_diff,
  count(*) FILTER (to_ <= 30 AND tn <= 30) AS overlap_top,
  (SELECT count(*) FROM d_old JOIN d_new USING (p_partkey)) AS overlap_diverse FROM r""")
def rank_stability(spark, sf_dir):
    out = topk.rank_stability(part_scores(spark, sf_dir), "old", "new", ["p_partkey"], ["p_brand", "p_type"])
    return rounded(out, {"rho": 9, "mean_abs_diff": 4})


@query("T1", """
SELECT p_brand, round(avg(p_retailprice), 6) AS score FROM part GROUP BY p_brand ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 1""")
def best_by_metric(spark, sf_dir):
    score = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("score"))
    return rounded(topk.top_k(score, "score", ["p_brand"], 1), {"score": 6})


@query("T2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def top_k(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return topk.top_k(o, "o_totalprice", ["o_orderkey"], 30)


@query("T3 U1 P16", f"""WITH {PRED}, e AS (SELECT *, round(abs(y - p), 4) AS err FROM pred)
SELECT {LINE_KEY_SQL}, err, 'close' AS kind FROM (SELECT * FROM e ORDER BY err, {LINE_KEY_SQL} LIMIT 4)
UNION ALL SELECT {LINE_KEY_SQL}, err, 'typical' FROM (SELECT * FROM e ORDER BY abs(err - (SELECT median(err) FROM e)), {LINE_KEY_SQL} LIMIT 4)
UNION ALL SELECT {LINE_KEY_SQL}, err, 'far' FROM (SELECT * FROM e ORDER BY err DESC, {LINE_KEY_SQL} LIMIT 4)""")
def examples(spark, sf_dir):
    e = predictions(spark, sf_dir).select(*LINE_KEY, F.round(F.abs(F.col("y") - F.col("p")), 4).alias("err"))
    return topk.stratified_examples(e, "err", LINE_KEY, 4)


_SUPPORTED = f"""{_SCORES},
sup AS (SELECT l_partkey, count(*) AS support FROM lineitem GROUP BY l_partkey),
sc AS (SELECT scores.*, support FROM scores JOIN sup ON l_partkey = p_partkey),
th AS (SELECT CAST(t AS INTEGER) AS threshold, p_partkey, new, row_number() OVER (PARTITION BY t ORDER BY new DESC, p_partkey) AS place
       FROM sc, (SELECT unnest([20, 25, 30, 35]) AS t) WHERE support >= t)"""


def supported_scores(spark, sf_dir):
    support = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count(F.lit(1)).alias("support")
    )
    return part_scores(spark, sf_dir).join(support, "p_partkey")


@query("T4", f"WITH {_SUPPORTED} SELECT threshold, p_partkey, new, CAST(place AS INTEGER) AS place FROM th WHERE place <= 30")
def top_by_threshold(spark, sf_dir):
    out = topk.top_by_threshold(supported_scores(spark, sf_dir), "support", [20, 25, 30, 35], "new", ["p_partkey"], 30)
    return out.select("threshold", "p_partkey", "new", "place")


@query("K6 T4", f"""WITH {_SUPPORTED}
SELECT threshold, count(*) AS n_supported, max(new) AS ceiling, round(median(new) FILTER (place <= 30), 6) AS top_median,
  count(*) FILTER (place <= 30 AND p_partkey IN (SELECT p_partkey FROM th WHERE threshold = 25 AND place <= 30)) AS overlap_base FROM th GROUP BY threshold""")
def threshold_sensitivity(spark, sf_dir):
    out = topk.threshold_sensitivity(
        supported_scores(spark, sf_dir), "support", [20, 25, 30, 35], 25, "new", ["p_partkey"], 30
    )
    return rounded(out, {"top_median": 6})


@query("D1", """
SELECT p_partkey, p_brand, p_type, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1
ORDER BY p_retailprice DESC, p_partkey LIMIT 30""")
def diverse_top(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return topk.diverse_top(p, ["p_brand", "p_type"], "p_retailprice", ["p_partkey"], 30)


@query("D2", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()


@query("J2 D1", """
WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000),
r AS (SELECT b.o_custkey, b.o_totalprice, c.o_orderkey, c.o_orderpriority, row_number() OVER (PARTITION BY b.o_custkey, b.o_totalprice ORDER BY c.o_orderkey) AS r
      FROM big b LEFT JOIN orders c ON b.o_custkey = c.o_custkey AND b.o_totalprice = c.o_totalprice)
SELECT o_custkey, o_totalprice, o_orderkey, o_orderpriority FROM r WHERE r = 1""")
def left_join_dedup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    big = o.filter(F.col("o_totalprice") > 400000).select("o_custkey", "o_totalprice")
    keys = ["o_custkey", "o_totalprice"]
    # One row per key on both sides before they meet, so that copies cannot multiply.
    right = topk.best_per_key(o.withColumn("_s", -F.col("o_orderkey")), keys, "_s", []).drop("_s")
    return big.distinct().join(right, keys, "left")


@query("J3 U2", """
WITH a AS (SELECT p_partkey, p_brand FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 200), b AS (SELECT p_partkey, p_brand FROM part ORDER BY p_size DESC, p_partkey LIMIT 200)
SELECT count(*) AS n_common FROM a JOIN b USING (p_partkey, p_brand)""")
def list_overlap(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return topk.overlap(
        topk.top_k(p, "p_retailprice", ["p_partkey"], 200), topk.top_k(p, "p_size", ["p_partkey"], 200), ["p_partkey", "p_brand"]
    )


@query("J4 J5", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return joins.members(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])


@query("J6", """
SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)""")
def anti_join(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") >= 49).select(F.col("l_partkey").alias("p_partkey"))
    return joins.non_members(table(spark, sf_dir, "part").select("p_partkey"), line, ["p_partkey"])


@query("J7 J1", """
SELECT p_partkey, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_discount >= 0.1 GROUP BY 1) ON l_partkey = p_partkey""")
def lookup_default(spark, sf_dir):
    n = (
        table(spark, sf_dir, "lineitem").filter(F.col("l_discount") >= 0.1)
        .groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    )
    return joins.lookup_or_default(table(spark, sf_dir, "part").select("p_partkey"), n, ["p_partkey"], {"n": 0})


@query("J9", "SELECT o_orderkey, o_totalprice * 2 AS doubled, o_custkey % 10 AS digit FROM orders")
def column_concat(spark, sf_dir):
    """Two feature tables of the same rows, put together on the row key."""
    o = table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", (F.col("o_totalprice") * 2).alias("doubled"))
    b = o.select("o_orderkey", F.pmod("o_custkey", F.lit(10)).alias("digit"))
    return a.join(b, "o_orderkey")


@query("U1", """
SELECT 'orders' AS origin, count(*) AS n FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem UNION ALL SELECT 'parts', count(*) FROM part""")
def stacked_counts(spark, sf_dir):
    out = None
    for label, name in (("orders", "orders"), ("lines", "lineitem"), ("parts", "part")):
        part = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).withColumn("origin", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


@query("U4 J6", """
SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part)) AS n_only_left,
       (SELECT count(*) FROM (SELECT p_partkey FROM part EXCEPT ALL SELECT l_partkey FROM lineitem)) AS n_only_right""")
def set_difference(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return topk.set_difference_report(line, part, ["k"])
