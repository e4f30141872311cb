"""Metric, profile and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import max_number
from ..operators import audit, metrics, profile
from ..operators.candidates import axis_from, enumerate_space
from ..operators.features import impute
from ..operators.ranking import exact_quantiles
from ..operators.splits import hash_fold, hash_holdout
from ..session import spread
from .base import (
    PRED, PRED_SPLIT, SPELLED, TEST_CUT, predictions, query, records, rounded, spelled_orders, sql_bucket, table,
)
from .features import HOLES, folded_parts, holes

METRICS = (
    "count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, "
    "round(1 - avg((y - p) * (y - p)) / var_pop(y), 8) AS r2"
)
DIGITS = {"mae": 4, "rmse": 4, "r2": 8}


def sided_predictions(spark, sf_dir):
    """Predictions with a supplier-safe side and fold."""
    g = F.col("l_suppkey")
    return predictions(spark, sf_dir).withColumns(
        {"split": hash_holdout(g, "0.2"), "fold": hash_fold(g, 5)}
    )


# --- prediction quality --------------------------------------------------------------------


@query("A1", f"WITH {PRED_SPLIT} SELECT fold, split, {METRICS} FROM sided GROUP BY fold, split")
def metrics_by_fold(spark, sf_dir):
    return rounded(metrics.regression_metrics(sided_predictions(spark, sf_dir), "y", "p", ["fold", "split"]), DIGITS)


@query("A2", f"""WITH {PRED_SPLIT},
f AS (SELECT fold, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM sided GROUP BY fold)
SELECT round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std,
       round(avg(r2), 8) AS r2_mean, round(stddev_pop(r2), 8) AS r2_std FROM f""")
def fold_metric_spread(spark, sf_dir):
    per_fold = metrics.regression_metrics(sided_predictions(spark, sf_dir), "y", "p", ["fold"])
    return rounded(
        metrics.metrics_over_folds(per_fold),
        {"mae_mean": 4, "mae_std": 4, "rmse_mean": 4, "rmse_std": 4, "r2_mean": 8, "r2_std": 8},
    )


@query("A3", f"""WITH {PRED}
SELECT round(avg(CASE WHEN abs(y - p) <= 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_within_1000,
       round(avg(CASE WHEN abs(y - p) <= 5000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_within_5000,
       round(avg(CASE WHEN abs(y - p) <= 20000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_within_20000 FROM pred""")
def tolerance_shares(spark, sf_dir):
    out = metrics.tolerance_shares(predictions(spark, sf_dir), "y", "p", [1000, 5000, 20000])
    return rounded(out, {c: 9 for c in out.columns})


@query("A4 S4 G1 G2 A1", f"""
WITH sided AS (SELECT l_extendedprice AS y, CAST({sql_bucket(42, 'l_suppkey')} % 5 AS INTEGER) AS fold FROM lineitem),
s AS (SELECT fold, sum(y) AS s, count(*) AS n FROM sided GROUP BY fold),
b AS (SELECT fold, ((SELECT sum(s) FROM s) - s) / ((SELECT sum(n) FROM s) - n) AS p FROM s)
SELECT fold, {METRICS} FROM sided JOIN b USING (fold) GROUP BY fold""")
def mean_baseline(spark, sf_dir):
    """Training-mean predictor per supplier-safe fold."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), hash_fold(F.col("l_suppkey"), 5).alias("fold")
    )
    return rounded(metrics.mean_baseline(line, "y", "fold"), DIGITS)


@query("A5", f"""WITH {PRED_SPLIT},
m AS (SELECT split, {METRICS.replace('round(1 -', '(1 -').replace(', 8) AS r2', ') AS r2')} FROM sided GROUP BY split)
SELECT t.n AS train_n, t.mae AS train_mae, t.rmse AS train_rmse, round(t.r2, 8) AS train_r2, h.n AS test_n, h.mae AS test_mae, h.rmse AS test_rmse, round(h.r2, 8) AS test_r2,
       round(t.r2 - h.r2, 8) AS r2_gap FROM m t, m h WHERE t.split = 'train' AND h.split = 'test'""")
def train_test_gap(spark, sf_dir):
    out = metrics.train_test_gap(sided_predictions(spark, sf_dir), "y", "p", "split")
    digits = {f"{s}_{m}": d for s in ("train", "test") for m, d in DIGITS.items()}
    return rounded(out, digits | {"r2_gap": 8})


@query("A6", f"""WITH {PRED}, g AS (SELECT l_suppkey, avg(abs(y - p)) AS m FROM pred GROUP BY l_suppkey)
SELECT (SELECT count(*) FROM pred) AS n_rows, count(*) AS n_groups, (SELECT round(avg(abs(y - p)), 4) FROM pred) AS row_mae,
       round(avg(m), 4) AS macro_mae, round(median(m), 4) AS median_group_mae FROM g""")
def macro_mae(spark, sf_dir):
    out = metrics.macro_errors(predictions(spark, sf_dir), "y", "p", "l_suppkey")
    return rounded(out, {"row_mae": 4, "macro_mae": 4, "median_group_mae": 4})


@query("A27", f"""WITH {PRED},
two AS (SELECT y, p, CAST({sql_bucket(42, "concat_ws('|', l_orderkey, l_linenumber, l_partkey)")} % 5 AS INTEGER) AS rf, CAST({sql_bucket(42, 'l_suppkey')} % 5 AS INTEGER) AS gf FROM pred),
r AS (SELECT 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM two GROUP BY rf),
g AS (SELECT 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM two GROUP BY gf)
SELECT (SELECT round(avg(r2), 8) FROM r) AS random_r2_mean, (SELECT round(stddev_pop(r2), 8) FROM r) AS random_r2_std,
       (SELECT round(avg(r2), 8) FROM g) AS group_r2_mean, (SELECT round(stddev_pop(r2), 8) FROM g) AS group_r2_std,
       round((SELECT avg(r2) FROM r) - (SELECT avg(r2) FROM g), 8) AS inflation""")
def split_strategy_gap(spark, sf_dir):
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")])
    two = predictions(spark, sf_dir).withColumns(
        {"rf": hash_fold(key, 5), "gf": hash_fold(F.col("l_suppkey"), 5)}
    )
    out = metrics.split_strategy_gap(two, "y", "p", "p", "rf", "gf")
    return rounded(out, {c: 8 for c in out.columns})


@query("A28", f"""WITH {PRED}
SELECT max(p) AS pred_max, min(p) AS pred_min, round(avg(p), 4) AS pred_mean, max(y) AS target_max, round(quantile_cont(y, 0.99), 4) AS target_p99 FROM pred""")
def prediction_envelope(spark, sf_dir):
    return rounded(metrics.prediction_envelope(predictions(spark, sf_dir), "y", "p"), {"pred_mean": 4, "target_p99": 4})


@query("A30", f"""WITH {PRED_SPLIT}
SELECT CASE WHEN split = 'test' AND y >= 50000 THEN 'test_high' WHEN split = 'test' THEN 'test_low' ELSE 'train' END AS mask,
       count(*) AS n, round(avg(abs(y - p)), 4) AS mae FROM sided GROUP BY 1""")
def metrics_by_mask(spark, sf_dir):
    test, high = F.col("split") == "test", F.col("y") >= 50000
    out = metrics.metrics_by_mask(
        sided_predictions(spark, sf_dir), "y", "p", {"test_high": test & high, "test_low": test & ~high, "train": ~test}
    )
    return rounded(out, {"mae": 4})


# --- profiles ------------------------------------------------------------------------------


@query("A7", """
WITH s AS (SELECT o_custkey, count(*) AS size FROM orders WHERE o_custkey % 37 <> 0 GROUP BY o_custkey),
r AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS place FROM s)
SELECT CAST(sum(size) AS BIGINT) AS n_rows, count(*) AS n_groups, round(avg(size), 8) AS mean_size, quantile_cont(size, 0.5) AS size_p50, quantile_cont(size, 0.75) AS size_p75,
  quantile_cont(size, 0.9) AS size_p90, quantile_cont(size, 0.95) AS size_p95, round(quantile_cont(size, 0.99), 8) AS size_p99, max(size) AS max_size,
  count(*) FILTER (size = 1) AS n_singletons,
  round((SELECT sum(size) FROM r WHERE place <= greatest(1, (SELECT count(*) FROM s) // 100)) / sum(size), 8) AS top_share FROM s""")
def group_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.when(F.pmod("o_custkey", F.lit(37)) != 0, F.col("o_custkey")).alias("k"))
    return rounded(profile.group_size_profile(o, "k"), {"mean_size": 8, "size_p99": 8, "top_share": 8})


@query("A24", """
SELECT group_rows, count(*) AS n_groups FROM (SELECT user_id, count(*) AS group_rows FROM events GROUP BY user_id) GROUP BY group_rows""")
def size_histogram(spark, sf_dir):
    return profile.size_classes(table(spark, sf_dir, "events"), "user_id")


def _floor_sql(label: str, keys: str) -> str:
    return f"""
SELECT '{label}' AS definition, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, round(median(s), 4) AS std_median, round(avg(s), 4) AS std_mean,
  round(sum((n - 1) * s * s) / greatest(1, sum(n) - count(*)) / 1e6, 6) AS pooled_var, round(sqrt(sum((n - 1) * s * s) / sum(n)), 4) AS rmse_floor,
  round(1 - sum((n - 1) * s * s) / greatest(1, sum(n) - count(*)) / (SELECT var_samp(l_extendedprice) FROM lineitem), 8) AS r2_ceiling
FROM (SELECT count(*) AS n, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY {keys} HAVING count(*) >= 2 AND count(DISTINCT l_suppkey) >= 2)"""


@query("A8", _floor_sql("part", "l_partkey") + " UNION ALL " + _floor_sql("part_quantity", "l_partkey, l_quantity")
       + " UNION ALL " + _floor_sql("part_quantity_discount", "l_partkey, l_quantity, l_discount"))
def noise_floor(spark, sf_dir):
    line = spread(table(spark, sf_dir, "lineitem")).select("l_partkey", "l_quantity", "l_discount", "l_suppkey", "l_extendedprice")
    keys = ["l_partkey", "l_quantity", "l_discount"]
    out = profile.noise_floor(
        line, "l_extendedprice", "l_suppkey",
        {"part": keys[:1], "part_quantity": keys[:2], "part_quantity_discount": keys},
    )
    out = out.withColumn("pooled_var", F.col("pooled_var") / 1e6)
    return rounded(out, {"std_median": 4, "std_mean": 4, "pooled_var": 6, "rmse_floor": 4, "r2_ceiling": 8})


@query("A9", f"""WITH {HOLES}
SELECT count(price) AS n_observed, round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std,
  round(avg(CASE WHEN price BETWEEN 100000 AND 200000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_window, round(avg(CASE WHEN price >= 300000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_wide,
  round(quantile_cont(price, 0.05), 4) AS price_p5, round(quantile_cont(price, 0.25), 4) AS price_p25, round(quantile_cont(price, 0.5), 4) AS price_p50,
  round(quantile_cont(price, 0.75), 4) AS price_p75, round(quantile_cont(price, 0.95), 4) AS price_p95 FROM holes WHERE price IS NOT NULL""")
def observed_profile(spark, sf_dir):
    filled = impute(holes(spark, sf_dir), {"price": 0.0})
    out = profile.observed_profile(
        filled, "price", "price_missing", [0.05, 0.25, 0.5, 0.75, 0.95],
        {"window": (100000, 200000), "wide": (300000, None)},
    )
    return rounded(out, {c: 9 if c.startswith("share") else 4 for c in out.columns if c != "n_observed"})


@query("A10", """
WITH v AS (SELECT *, value AS x FROM events WHERE value BETWEEN 0 AND 400)
SELECT count(*) AS n_valid, max(x) AS max_value, count(*) FILTER (x > 30) AS n_gt_30, count(*) FILTER (x > 27) AS n_gt_27,
  round(count(*) FILTER (x > 30) * 100.0::DOUBLE / count(*), 8) AS pct_gt_first, count(*) FILTER (x > 30 AND event_type = 'error') AS n_flag_true,
  count(DISTINCT user_id) FILTER (x > 30) AS n_groups_gt,
  round(median(CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE)) FILTER (x > 30), 6) AS median_k FROM v""")
def outlier_audit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "value", "user_id", F.when(F.col("event_type") == "error", F.lit("true")).otherwise(F.lit("FALSE")).alias("flag"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    out = profile.outlier_audit(e, "value", (0.0, 400.0), [30, 27], ["flag"], "k", "user_id")
    return rounded(out, {"pct_gt_first": 8, "median_k": 6})


@query("A19", f"""
WITH folded AS (SELECT CAST(p_size AS DOUBLE) AS size, CAST({sql_bucket(42, 'p_partkey')} % 5 AS INTEGER) AS fold FROM part WHERE p_partkey % 6 <> 0),
f AS (SELECT DISTINCT fold FROM folded)
SELECT f.fold, median(size) AS train_median, median(size) - (SELECT median(size) FROM folded) AS delta_vs_global
FROM f JOIN folded r ON r.fold <> f.fold GROUP BY f.fold""")
def fold_median_shift(spark, sf_dir):
    return profile.fold_median_shift(folded_parts(spark, sf_dir), "fold", 5, "size")


@query("A19 U2", f"""
WITH folded AS (SELECT p_brand AS brand, CAST({sql_bucket(42, 'p_partkey')} % 5 AS INTEGER) AS fold FROM part),
f AS (SELECT DISTINCT fold FROM folded),
g AS (SELECT brand FROM folded GROUP BY brand ORDER BY count(*) DESC, brand LIMIT 8),
t AS (SELECT fold, brand, row_number() OVER (PARTITION BY fold ORDER BY n DESC, brand) AS place
      FROM (SELECT f.fold, brand, count(*) AS n FROM f JOIN folded r ON r.fold <> f.fold GROUP BY f.fold, brand))
SELECT fold, count(*) FILTER (brand IN (SELECT brand FROM g)) AS overlap FROM t WHERE place <= 8 GROUP BY fold""")
def fold_top_overlap(spark, sf_dir):
    return profile.fold_top_overlap(folded_parts(spark, sf_dir), "fold", 5, "brand", 8)


@query("A21", """
SELECT CAST(least(floor((value - 0) / 12.5), 19) AS INTEGER) AS bin, count(*) AS n, CAST(least(floor(value / 12.5), 19) AS INTEGER) * 12.5::DOUBLE AS bin_low
FROM events WHERE value BETWEEN 0 AND 250 GROUP BY bin, bin_low""")
def histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "value", 0.0, 12.5, 20)


@query("A22", """
SELECT CAST(ceil((value - 0) / 25.0) - 1 AS INTEGER) AS bin, round(avg(user_id), 8) AS mean, count(user_id) AS n, (CAST(ceil(value / 25.0) - 1 AS INTEGER) + 0.5::DOUBLE) * 25.0::DOUBLE AS center
FROM events WHERE value > 0 AND value <= 500 GROUP BY bin, center HAVING count(user_id) >= 30""")
def binned_mean(spark, sf_dir):
    out = profile.binned_mean(table(spark, sf_dir, "events"), "value", "user_id", 0.0, 25.0, 20, 30)
    return rounded(out, {"mean": 8})


@query("A23", """
WITH c AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'Unknown' ELSE p_brand END AS category, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, category) AS place FROM c)
SELECT CASE WHEN place <= 5 THEN category ELSE 'other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def category_shares(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.when(F.pmod("p_partkey", F.lit(11)) != 0, F.col("p_brand")).alias("b"))
    return profile.category_shares(p, "b")


@query("A25", "SELECT o_orderpriority AS category, count(*) AS n FROM orders GROUP BY o_orderpriority")
def value_count_map(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority").withColumnRenamed("o_orderpriority", "category")


@query("A26", """
SELECT count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem""")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_orderkey").alias("n_orders"), F.count_distinct("l_partkey").alias("n_parts"),
        F.count_distinct("l_suppkey").alias("n_suppliers"),
    )


@query("A29", f"""WITH {SPELLED},
k AS (SELECT CASE WHEN o_custkey % 41 = 0 THEN '   ' ELSE raw_key END AS k FROM spelled)
SELECT count(*) AS n_rows, count(*) FILTER (k IS NULL) AS n_null, count(*) FILTER (trim(k) = '') AS n_blank, count(DISTINCT k) AS n_distinct,
       count(*) FILTER (k IS NULL) AS n_sentinel FROM k""")
def key_completeness(spark, sf_dir):
    o = spelled_orders(spark, sf_dir)
    k = F.when(F.pmod("o_custkey", F.lit(41)) == 0, F.lit("   ")).otherwise(F.col("raw_key"))
    return profile.key_completeness(o.select(k.alias("k")), "k")


# --- support, pairs, keys ------------------------------------------------------------------

DIMS = ["p_brand", "p_type", "p_size"]
_TRAIN_LINES = f"""
tl AS (SELECT p_brand, p_type, p_size, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {sql_bucket(42, 'l_suppkey')} >= {TEST_CUT}),
sup AS (SELECT p_brand, p_type, p_size, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, max(n) / sum(n) AS share
        FROM (SELECT p_brand, p_type, p_size, l_suppkey, count(*) AS n FROM tl GROUP BY ALL) GROUP BY p_brand, p_type, p_size)"""


def training_lines(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").filter(
        hash_holdout(F.col("l_suppkey"), "0.2") == "train"
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), *DIMS)
    return line.join(part, "l_partkey")


@query("A11 J1 J7 J8", f"""WITH {_TRAIN_LINES}
SELECT b.p_brand, t.p_type, s.p_size, coalesce(n_rows, 0) AS n_rows, coalesce(n_groups, 0) AS n_groups, round(share, 9) AS max_group_share
FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t CROSS JOIN (SELECT DISTINCT p_size FROM part) s
LEFT JOIN sup ON sup.p_brand = b.p_brand AND sup.p_type = t.p_type AND sup.p_size = s.p_size""")
def support_triples(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    space = enumerate_space(spark, {d: axis_from(part, d) for d in DIMS}).drop("candidate_id")
    out = audit.support_of(space, training_lines(spark, sf_dir), DIMS, "l_suppkey")
    return rounded(out, {"max_group_share": 9})


@query("A12", f"WITH {_TRAIN_LINES} SELECT p_brand, p_type, p_size, n_rows FROM sup")
def cooccurrence(spark, sf_dir):
    return audit.cooccurrence(training_lines(spark, sf_dir), DIMS)


_PAIRED = """
med AS (SELECT o_custkey, median(o_totalprice) FILTER (o_orderstatus = 'P') AS a, median(o_totalprice) FILTER (o_orderstatus <> 'P') AS b FROM orders GROUP BY o_custkey),
diffs AS (SELECT o_custkey, a - b AS diff FROM med WHERE a IS NOT NULL AND b IS NOT NULL)"""


def order_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", (F.col("o_orderstatus") == "P").alias("flag"), "o_totalprice"
    )
    return audit.paired_differences(o, "o_custkey", "flag", "o_totalprice")


@query("A13", f"WITH {_PAIRED} SELECT o_custkey, round(diff, 4) + 0.0 AS diff FROM diffs")
def paired_differences(spark, sf_dir):
    return rounded(order_pairs(spark, sf_dir), {"diff": 4})


@query("A13 A14", f"""WITH {_PAIRED}
SELECT count(*) AS n_groups, round(avg(CASE WHEN diff < 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS negative_share, round(quantile_cont(diff, 0.25), 4) AS diff_p25,
       round(quantile_cont(diff, 0.5), 4) AS diff_p50, round(quantile_cont(diff, 0.75), 4) AS diff_p75 FROM diffs""")
def paired_within_group(spark, sf_dir):
    out = audit.paired_summary(order_pairs(spark, sf_dir))
    return rounded(out, {"negative_share": 9, "diff_p25": 4, "diff_p50": 4, "diff_p75": 4})


@query("A14", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_flag, bool_and(o_orderstatus = 'P') AS all_flag FROM orders GROUP BY o_custkey")
def any_all_by_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderstatus") == "P").alias("f"))
    return audit.any_all_by_group(o, "o_custkey", "f")


_COLLIDING = f"""{SPELLED},
variants AS (SELECT raw_key, norm_key, count(*) AS n FROM normed WHERE raw_key IS NOT NULL GROUP BY raw_key, norm_key),
col AS (SELECT norm_key, count(*) AS n_variants, CAST(sum(n) AS BIGINT) AS n_rows, bool_or(raw_key <> trim(raw_key)) AS by_space,
  count(DISTINCT lower(raw_key)) < count(*) AS by_case, bool_or(regexp_matches(lower(raw_key), '^(https?://)?(dx\\.)?doi\\.org/')) AS by_url,
  bool_or(starts_with(lower(trim(raw_key)), 'doi:')) AS by_scheme FROM variants GROUP BY norm_key HAVING count(*) > 1)"""


@query("A15 A16 P12", f"WITH {_COLLIDING} SELECT * FROM col")
def key_collisions(spark, sf_dir):
    return audit.collisions(spelled_orders(spark, sf_dir), "raw_key")


@query("A16", f"""WITH {_COLLIDING}
SELECT 'by_space' AS kind, count(*) FILTER (by_space) AS n_collisions FROM col UNION ALL SELECT 'by_case', count(*) FILTER (by_case) FROM col
UNION ALL SELECT 'by_url', count(*) FILTER (by_url) FROM col UNION ALL SELECT 'by_scheme', count(*) FILTER (by_scheme) FROM col""")
def collision_kinds(spark, sf_dir):
    return audit.collision_kinds(audit.collisions(spelled_orders(spark, sf_dir), "raw_key"))


def spelled_split(spark, sf_dir):
    """Orders split and folded on the raw spelling, with a prediction to judge."""
    k = F.col("raw_key")
    return spelled_orders(spark, sf_dir).withColumns(
        {
            "split": hash_holdout(F.coalesce(k, F.lit("unknown")), "0.2"),
            "fold": hash_fold(F.coalesce(k, F.lit("unknown")), 5),
            "p": F.col("o_custkey") * 100.0,
        }
    )


_SPELLED_SPLIT = f"""{SPELLED},
sp AS (SELECT *, CASE WHEN {sql_bucket(42, "coalesce(raw_key, 'unknown')")} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split,
         CAST({sql_bucket(42, "coalesce(raw_key, 'unknown')")} % 5 AS INTEGER) AS fold FROM normed),
cross_keys AS (SELECT norm_key, count(DISTINCT raw_key) AS n_variants, count(*) AS n_rows, CAST(count(DISTINCT SIDE) AS INTEGER) AS n_sides
          FROM sp WHERE raw_key IS NOT NULL GROUP BY norm_key HAVING count(DISTINCT raw_key) > 1 AND count(DISTINCT SIDE) > 1)"""


@query("A17", f"WITH {_SPELLED_SPLIT.replace('SIDE', 'fold')} SELECT * FROM cross_keys")
def crossing_keys(spark, sf_dir):
    return audit.crossing_keys(spelled_split(spark, sf_dir), "raw_key", "fold")


@query("A17 G7", f"""WITH {_SPELLED_SPLIT.replace('SIDE', 'split')}
SELECT count(*) AS n_keys, CAST(sum(n_rows) AS BIGINT) AS n_rows, (SELECT count(*) FROM orders) AS n_all, round(sum(n_rows) * 100.0::DOUBLE / (SELECT count(*) FROM orders), 8) AS pct_rows FROM cross_keys""")
def crossing_summary(spark, sf_dir):
    return rounded(audit.crossing_summary(spelled_split(spark, sf_dir), "raw_key", "split"), {"pct_rows": 8})


@query("A18", f"""WITH {_SPELLED_SPLIT.replace('SIDE', 'split')},
m AS (SELECT CASE WHEN x.norm_key IS NOT NULL AND split = 'test' THEN 'contaminated_test' WHEN split = 'test' THEN 'clean_test' WHEN x.norm_key IS NOT NULL THEN 'train_side' END AS mask,
             abs(o_totalprice - o_custkey * 100.0::DOUBLE) AS e FROM sp LEFT JOIN cross_keys x ON x.norm_key = sp.norm_key)
SELECT mask, count(*) AS n, round(avg(e), 4) AS mae FROM m WHERE mask IS NOT NULL GROUP BY mask""")
def contaminated_test(spark, sf_dir):
    out = audit.contamination(spelled_split(spark, sf_dir), "raw_key", "split", "o_totalprice", "p")
    return rounded(out, {"mae": 4})


@query("W1", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(avg(l_extendedprice) OVER (PARTITION BY l_partkey) + 0.0000137::DOUBLE, 4) AS group_mean,
       round(l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey) + 0.0000137::DOUBLE, 4) + 0.0 AS residual FROM lineitem""")
def group_residuals(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    out = audit.group_residuals(line, ["l_partkey"], "l_extendedprice").drop("l_extendedprice")
    # Means of cents often end in a 5: moved off the rounding edge, here and in the SQL.
    out = out.withColumns({c: F.col(c) + 0.0000137 for c in ("group_mean", "residual")})
    return rounded(out, {"group_mean": 4, "residual": 4})


@query("P2 A9", r"""
SELECT l_suppkey, count(*) AS n, round(median(list_max(list_transform(regexp_extract_all(t, '(\d+\.?\d*)', 1), lambda x: TRY_CAST(x AS DOUBLE)))), 6) AS temp_p50
FROM (SELECT l_suppkey, CASE l_orderkey % 4 WHEN 0 THEN 'RT' WHEN 1 THEN CAST(l_quantity AS BIGINT) || '-150 C' ELSE CAST(l_quantity AS BIGINT) || ' | ' || l_linenumber END AS t FROM lineitem)
GROUP BY l_suppkey""")
def group_medians(spark, sf_dir):
    """Exact medians per group, however large a group is."""
    r = records(spark, sf_dir).select("l_suppkey", max_number(F.col("temperature")).alias("temp"))
    counts = r.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(rounded(exact_quantiles(r, ["temp"], [0.5], ["l_suppkey"]), {"temp_p50": 6}), "l_suppkey")

