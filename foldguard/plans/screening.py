"""Screening, uncertainty, neighbour and candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as cand
from ..operators import conformal, features, neighbours, screening, topk
from ..operators.audit import cooccurrence
from ..operators.splits import exact_sample
from .aggregates import DIMS, _TRAIN_LINES, training_lines
from .base import HELD, LINE_KEY, PRED, calibration_and_test, predictions, query, rounded, sql_draw, table
from .ordering import LINE_KEY_SQL

THRESHOLDS = [50000.0, 80000.0, 1000000.0]
FRACTIONS = ["0.05", "0.10", "0.20"]


@query("E1 R1", f"""WITH {PRED},
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {LINE_KEY_SQL}) AS rank FROM pred),
n AS (SELECT count(*) AS n FROM pred),
pairs AS (SELECT t, f, greatest(1, CAST(floor(f * n) AS BIGINT)) AS k FROM n, (SELECT unnest([50000, 80000, 1000000]) AS t), (SELECT unnest([0.05, 0.10, 0.20]) AS f)),
h AS (SELECT t, f, k, count(*) FILTER (y >= t) / any_value(n.n) AS base, count(*) FILTER (y >= t AND rank <= k) / k AS hit FROM pairs, r, n GROUP BY t, f, k)
SELECT CAST(t AS DOUBLE) AS threshold, CAST(f AS DOUBLE) AS fraction, k, round(base, 9) AS base_rate, round(hit, 9) AS precision_at_k,
       round(CASE WHEN base > 0 THEN hit / base END, 9) AS lift FROM h""")
def enrichment(spark, sf_dir):
    out = screening.enrichment_table(predictions(spark, sf_dir), "y", "p", LINE_KEY, THRESHOLDS, FRACTIONS)
    return rounded(out, {"base_rate": 9, "precision_at_k": 9, "lift": 9})


@query("E2 R1", f"""WITH {PRED},
r AS (SELECT y, row_number() OVER (ORDER BY p DESC, {LINE_KEY_SQL}) AS rank FROM pred),
pts AS (SELECT CAST(j AS INTEGER) AS point, greatest(1, j * (SELECT count(*) FROM pred) // 50) AS k FROM range(1, 51) t(j))
SELECT point, k, round(count(*) FILTER (rank <= k AND y >= 80000) / greatest(1, count(*) FILTER (y >= 80000)), 9) AS captured FROM pts, r GROUP BY point, k""")
def gains(spark, sf_dir):
    out = screening.gains_curve(predictions(spark, sf_dir), "y", "p", LINE_KEY, 80000.0)
    return rounded(out, {"captured": 9})


COVERAGES = ["0.90", "0.80"]

_MARGINAL = f"""{HELD},
c AS (SELECT unnest([0.90, 0.80]) AS cov),
ranked AS (SELECT e, row_number() OVER (ORDER BY e) AS r, count(*) OVER () AS n FROM cal),
q AS (SELECT CAST(cov AS DOUBLE) AS target_coverage, any_value(n) AS n_calibration, max(e) AS half_width FROM ranked, c WHERE r <= least(ceil((n + 1) * cov), n) GROUP BY cov)"""
_MARGINAL_ROWS = """
SELECT 'marginal' AS method, target_coverage, n_calibration, count(*) AS n_test, round(half_width, 4) AS half_width, round(2 * half_width, 4) AS width,
       round(avg(CASE WHEN e <= half_width THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS coverage FROM q, tst GROUP BY target_coverage, n_calibration, half_width"""
WIDTHS = {"half_width": 4, "width": 4, "coverage": 9}


@query("E3 G5", f"WITH {_MARGINAL} {_MARGINAL_ROWS}")
def conformal_marginal(spark, sf_dir):
    cal, test = calibration_and_test(spark, sf_dir)
    return rounded(conformal.marginal_intervals(cal, test, "y", "p", COVERAGES), WIDTHS)


_BIN = " + ".join(f"(CASE WHEN p >= g[{i}] THEN 1 ELSE 0 END)" for i in (1, 2, 3))
_BINNED = f"""
edges AS (SELECT quantile_cont(p, [0.25, 0.5, 0.75]) AS g FROM cal),
cb AS (SELECT {_BIN} AS bin, e, row_number() OVER (PARTITION BY {_BIN} ORDER BY e) AS r, count(*) OVER (PARTITION BY {_BIN}) AS n FROM cal, edges),
bq AS (SELECT bin, any_value(n) AS n_calibration, max(e) AS half_width FROM cb WHERE r <= least(ceil((n + 1) * 0.90), n) GROUP BY bin),
tb AS (SELECT {_BIN} AS bin, e FROM tst, edges),
per_bin AS (SELECT bin, n_calibration, half_width, count(*) AS n_test, avg(CASE WHEN e <= half_width THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS coverage
            FROM tb JOIN bq USING (bin) GROUP BY bin, n_calibration, half_width)"""


@query("E4 R4", f"""WITH {HELD}, {_BINNED}
SELECT bin, n_calibration, n_test, round(half_width, 4) AS half_width, round(coverage, 9) AS coverage FROM per_bin""")
def conformal_binned(spark, sf_dir):
    cal, test = calibration_and_test(spark, sf_dir)
    return rounded(conformal.binned_intervals(cal, test, "y", "p"), {"half_width": 4, "coverage": 9})


@query("E8", f"""WITH {_MARGINAL}, {_BINNED} {_MARGINAL_ROWS}
UNION ALL SELECT 'binned', 0.9, CAST(sum(n_calibration) AS BIGINT), CAST(sum(n_test) AS BIGINT), round(sum(half_width * n_test) / sum(n_test), 4),
  round(2 * sum(half_width * n_test) / sum(n_test), 4), round(sum(coverage * n_test) / sum(n_test), 9) FROM per_bin""")
def coverage_table(spark, sf_dir):
    cal, test = calibration_and_test(spark, sf_dir)
    return rounded(conformal.coverage_table(cal, test, "y", "p", COVERAGES), WIDTHS)


@query("E6 T2", f"""WITH {_MARGINAL}, {_BINNED},
top AS (SELECT p_partkey, CAST(p_retailprice * p_size AS DOUBLE) AS score FROM part ORDER BY p_retailprice * p_size DESC, p_partkey LIMIT 5)
SELECT p_partkey, round(score, 4) AS score, round(score - m.half_width, 4) AS marginal90_low, round(score + m.half_width, 4) AS marginal90_high,
       round(score - t.half_width, 4) AS binned_top_low, round(score + t.half_width, 4) AS binned_top_high
FROM top, (SELECT half_width FROM q WHERE target_coverage = 0.9) m, (SELECT half_width FROM bq WHERE bin = 3) t""")
def candidate_intervals(spark, sf_dir):
    cal, _ = calibration_and_test(spark, sf_dir)
    errors = cal.withColumn("_e", F.abs(F.col("y") - F.col("p")))
    marginal = conformal.half_widths(errors, "_e", ["0.90"]).first()["half_width"]
    edges = conformal.prediction_edges(cal, "p")
    top_bin = conformal.binned_half_widths(cal, "y", "p", edges, "0.90").filter(F.col("bin") == len(edges)).first()
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * F.col("p_size")).alias("score"))
    top = topk.top_k(parts, "score", ["p_partkey"], 5)
    out = conformal.with_interval(top, "score", marginal, "marginal90")
    out = conformal.with_interval(out, "score", top_bin["half_width"], "binned_top")
    return rounded(out, {c: 4 for c in out.columns if c != "p_partkey"})


@query("E7 G8", f"""WITH {_MARGINAL},
s AS (SELECT * FROM (SELECT *, concat_ws('|', {LINE_KEY_SQL.replace(', y', '')}, CAST(y AS DECIMAL(18,2))) AS k FROM tst) ORDER BY {sql_draw(42, 'k')}, k LIMIT 60)
SELECT k, e <= half_width AS inside FROM s, (SELECT half_width FROM q WHERE target_coverage = 0.9)""")
def interval_membership(spark, sf_dir):
    cal, test = calibration_and_test(spark, sf_dir)
    width = conformal.half_widths(cal.withColumn("_e", F.abs(F.col("y") - F.col("p"))), "_e", ["0.90"]).first()["half_width"]
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in LINE_KEY[:-1]], F.col("y").cast("decimal(18,2)").cast("string"))
    sample = exact_sample(test.withColumn("k", key), "k", 60)
    return conformal.inside_interval(sample, "y", "p", width).select("k", "inside")


# --- neighbours ----------------------------------------------------------------------------


@query("J11", """
WITH d AS (SELECT a.vec_id AS id, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, neighbour) AS place FROM d)
SELECT id, neighbour, round(distance, 6) AS distance, CAST(place AS INTEGER) AS place FROM r WHERE place <= 5""")
def knn_join(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(neighbours.knn_join(e, e, "vec_id", "embedding", 5, self_join=True), {"distance": 6})


_SCALED = """
flat AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)),
par AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM flat WHERE label >= 3 GROUP BY i),
scaled AS (SELECT vec_id, label, list((v - m) / s ORDER BY i) AS x FROM flat JOIN par USING (i) GROUP BY vec_id, label)"""


@query("E5 F8 J11", f"""WITH {_SCALED},
tr AS (SELECT * FROM scaled WHERE label >= 3), te AS (SELECT * FROM scaled WHERE label < 3),
dtr AS (SELECT a.vec_id AS id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r FROM tr a JOIN tr b ON a.vec_id <> b.vec_id),
thr AS (SELECT quantile_cont(m, 0.95) AS t FROM (SELECT id, avg(d) AS m FROM dtr WHERE r <= 5 GROUP BY id)),
dte AS (SELECT a.vec_id AS id, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x), b.vec_id) AS r FROM te a JOIN tr b ON true),
ad AS (SELECT id, avg(d) AS m FROM dte WHERE r <= 5 GROUP BY id),
err AS (SELECT vec_id AS id, abs(embedding[1]::DOUBLE * 10 - embedding[2]::DOUBLE * 10) AS e FROM embeddings)
SELECT m <= t AS inside, count(*) AS n, round(avg(e), 8) AS mae, round(avg(CASE WHEN e <= 1.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS coverage, round(any_value(t), 6) AS threshold
FROM ad JOIN err USING (id), thr GROUP BY 1""")
def applicability_domain(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", "label",
        (F.element_at("embedding", 1).cast("double") * 10).alias("y"), (F.element_at("embedding", 2).cast("double") * 10).alias("p"),
    )
    train = e.filter(F.col("label") >= 3)
    means, stds = features.vector_scale_parameters(train, "embedding")
    scaled = features.standardize_vector(e, "embedding", means, stds)
    out = neighbours.applicability_domain(
        scaled.filter(F.col("label") >= 3), scaled.filter(F.col("label") < 3), "vec_id", "embedding", "y", "p", 1.5
    )
    return rounded(out, {"mae": 8, "coverage": 9, "threshold": 6})


# --- candidates ----------------------------------------------------------------------------


def market_axes(spark, sf_dir):
    """Axis levels taken from the tables."""
    return {
        "region": cand.axis_from(table(spark, sf_dir, "region"), "r_name"),
        "segment": cand.axis_from(table(spark, sf_dir, "customer"), "c_mktsegment"),
        "type": cand.axis_from(table(spark, sf_dir, "part"), "p_type"),
        "priority": cand.axis_from(table(spark, sf_dir, "orders"), "o_orderpriority"),
    }


_SPACE = """
space AS (SELECT r_name AS region, c_mktsegment AS segment, p_type AS type, o_orderpriority AS priority
  FROM (SELECT DISTINCT r_name FROM region) CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) CROSS JOIN (SELECT DISTINCT p_type FROM part)
  CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders))"""


@query("K1 K3 J8", f"WITH {_SPACE} SELECT * FROM space")
def candidate_space(spark, sf_dir):
    axes = market_axes(spark, sf_dir)
    space = cand.enumerate_space(spark, axes)
    cand.check_count(space, axes)
    return space.drop("candidate_id")


@query("K2", f"""WITH {_SPACE}
SELECT region, segment, type, priority, CASE WHEN region = 'ASIA' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS region_ASIA, CASE WHEN type = 'PROMO' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS type_PROMO,
  CASE WHEN segment = 'BUILDING' THEN 0.75::DOUBLE ELSE 0.0::DOUBLE END AS share_B, round((SELECT median(p_retailprice) FROM part), 6) AS price, 0.0::DOUBLE AS unseen FROM space""")
def candidates_encoded(spark, sf_dir):
    axes = market_axes(spark, sf_dir)
    cells = {}
    for axis, levels in axes.items():
        own = levels.select("level", F.concat(F.lit(f"{axis}_"), "level").alias("feature"), F.lit(1.0).alias("value"))
        share = levels.filter("level = 'BUILDING'").select("level", F.lit("share_B").alias("feature"), F.lit(0.75).alias("value"))
        cells[axis] = own.unionByName(share)
    context = features.medians(table(spark, sf_dir, "part"), ["p_retailprice"])
    names = ["region_ASIA", "type_PROMO", "share_B", "price", "unseen"]
    out = cand.encode_space(
        cand.enumerate_space(spark, axes), cells, names, {"price": context["p_retailprice"]}
    )
    return rounded(out.drop("candidate_id"), {"price": 6})


_CANDIDATES = f"""{_TRAIN_LINES},
cnd AS (SELECT b.p_brand, t.p_type, s.p_size, coalesce(n_rows, 0) AS n_rows, CAST((s.p_size * 37 + length(b.p_brand) * 11 + length(t.p_type) * 101) % 997 AS DOUBLE) AS score
  FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_type FROM part) t CROSS JOIN (SELECT DISTINCT p_size FROM part) s
  LEFT JOIN sup ON sup.p_brand = b.p_brand AND sup.p_type = t.p_type AND sup.p_size = s.p_size)"""


def scored_candidates(spark, sf_dir):
    """Every brand × type × size with its training support and a fixed linear score."""
    part = table(spark, sf_dir, "part")
    space = cand.enumerate_space(spark, {d: cand.axis_from(part, d) for d in DIMS}).drop("candidate_id")
    supported = cand.with_support(space, cooccurrence(training_lines(spark, sf_dir), DIMS), DIMS)
    score = F.col("p_size") * 37 + F.length("p_brand") * 11 + F.length("p_type") * 101
    return supported.withColumn("score", F.pmod(score, F.lit(997)).cast("double"))


@query("K4 D1", f"""WITH {_CANDIDATES},
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY score DESC, p_brand, p_type, p_size) AS r FROM cnd)
SELECT p_brand, p_type, p_size, score FROM b WHERE r = 1 ORDER BY score DESC, p_brand, p_type, p_size LIMIT 30""")
def candidates_ranked(spark, sf_dir):
    out = topk.diverse_top(scored_candidates(spark, sf_dir), ["p_brand", "p_type"], "score", DIMS, 30)
    return out.select(*DIMS, "score")


@query("K5 A12 J1", f"""WITH {_CANDIDATES}
SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (n_rows >= t) AS n_supported, count(*) AS n_candidates FROM cnd, (SELECT unnest([1, 5, 10, 40]) AS t) GROUP BY t""")
def support_filter(spark, sf_dir):
    return cand.support_counts(scored_candidates(spark, sf_dir), "n_rows", [1, 5, 10, 40])


@query("K5 T2", f"""WITH {_CANDIDATES}
SELECT p_brand, p_type, p_size, n_rows, score FROM cnd WHERE n_rows >= 5 ORDER BY score DESC, p_brand, p_type, p_size LIMIT 30""")
def supported_top(spark, sf_dir):
    supported = scored_candidates(spark, sf_dir).filter(F.col("n_rows") >= 5)
    return topk.top_k(supported, "score", DIMS, 30)


@query("K6", f"""WITH {_CANDIDATES},
th AS (SELECT CAST(t AS INTEGER) AS threshold, p_brand, p_type, p_size, score, row_number() OVER (PARTITION BY t ORDER BY score DESC, p_brand, p_type, p_size) AS place
  FROM cnd, (SELECT unnest([1, 3, 5, 40]) AS t) WHERE n_rows >= t)
SELECT a.threshold, count(*) AS n_supported, max(score) AS ceiling, median(score) FILTER (place <= 30) AS top_median,
  count(*) FILTER (place <= 30 AND EXISTS (SELECT 1 FROM th b WHERE b.threshold = 5 AND b.place <= 30 AND b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.p_size = a.p_size)) AS overlap_base
FROM th a GROUP BY a.threshold""")
def support_sensitivity(spark, sf_dir):
    return topk.threshold_sensitivity(scored_candidates(spark, sf_dir), "n_rows", [1, 3, 5, 40], 5, "score", DIMS, 30)
