"""Candidate queries whose scores come from a fitted model.

A linear model of the price on the brand's number, the length of the type's name and the size is fitted on the training lines; each of the
three axes adds its part to the score of a candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import additive, gram, topk
from ..operators import candidates as cand
from ..operators.audit import cooccurrence
from ..operators.splits import hash_holdout
from ..session import spread, stage
from .aggregates import _TRAIN_LINES, DIMS, training_lines
from .base import TEST_CUT, query, rounded, sql_bucket, table

FEATURES = {"p_brand": "brand_number", "p_type": "type_length", "p_size": "size"}
K = 30


def feature_of(axis: str, level: str):
    c = F.col(level)
    return {"p_brand": F.regexp_extract(c, "([0-9]+)", 1), "p_type": F.length(c), "p_size": c}[axis].cast("double")


def model_lines(spark, sf_dir) -> DataFrame:
    line = spread(table(spark, sf_dir, "lineitem")).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("y"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), *[feature_of(a, a).alias(f) for a, f in FEATURES.items()])
    side = (hash_holdout(F.col("l_suppkey"), "0.2") == "train").cast("int")
    return line.join(part, "l_partkey").select(*FEATURES.values(), "y", side.alias("side"))


def fitted(spark, sf_dir, *families: tuple[str, ...]) -> list[tuple[float, dict[str, float]]]:
    """Intercept and weights on the training lines for each set of features, all from one scan."""
    grams = gram.fold_grams(model_lines(spark, sf_dir), [*FEATURES.values(), "y"], {"side": F.col("side")})
    (y,) = grams.at(["y"])
    return [additive.weight_map(gram.solved(grams.of("side", 1), grams.at(names), y), names) for names in families]


def axis_levels(spark, sf_dir) -> dict[str, DataFrame]:
    return {d: stage(cand.axis_from(table(spark, sf_dir, "part"), d), "axis") for d in DIMS}


def axis_cells(axes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {a: t.select("level", F.lit(FEATURES[a]).alias("feature"), feature_of(a, "level").alias("value")) for a, t in axes.items()}


def _fit_three(a: str, b: str, c: str, y: str) -> str:
    """Least squares on three columns by Cramer's rule."""
    x = [a, b, c]
    s = [[f"covar_pop({p}, {q})" for q in x] for p in x]
    v = [f"covar_pop({p}, {y})" for p in x]

    def det(m):
        minor = lambda i, j, k, l: f"({m[1][i]} * {m[2][j]} - {m[1][k]} * {m[2][l]})"  # noqa: E731, E741
        return f"({m[0][0]} * {minor(1, 2, 2, 1)} - {m[0][1]} * {minor(0, 2, 2, 0)} + {m[0][2]} * {minor(0, 1, 1, 0)})"

    whole = det(s)
    slopes = [f"{det([[v[i] if k == j else s[i][k] for k in range(3)] for i in range(3)])} / {whole}" for j in range(3)]
    out = [f"{w} AS b{j + 1}" for j, w in enumerate(slopes)]
    return ", ".join([*out, " - ".join([f"avg({y})", *[f"({w}) * avg({q})" for w, q in zip(slopes, x, strict=True)]]) + " AS b0"])


_BRAND, _TYPE, _SIZE = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS DOUBLE)", "CAST(length(p_type) AS DOUBLE)", "CAST(p_size AS DOUBLE)"
_MODEL = f"""{_TRAIN_LINES},
ml AS (SELECT l_extendedprice AS y, {_BRAND} AS f1, {_TYPE} AS f2, {_SIZE} AS f3 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {sql_bucket(42, 'l_suppkey')} >= {TEST_CUT}),
m AS (SELECT {_fit_three('f1', 'f2', 'f3', 'y')} FROM ml),
dec AS (SELECT p_brand, p_type, p_size, CAST(b0 AS DECIMAL(28, 9)) + CAST(b1 * {_BRAND} AS DECIMAL(28, 9)) + CAST(b2 * {_TYPE} AS DECIMAL(28, 9)) + CAST(b3 * {_SIZE} AS DECIMAL(28, 9)) AS exact
  FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT DISTINCT p_type FROM part) CROSS JOIN (SELECT DISTINCT p_size FROM part), m),
cnd AS (SELECT d.*, round(CAST(exact AS DOUBLE), 3) AS score, coalesce(n_rows, 0) AS n_rows FROM dec d LEFT JOIN sup USING (p_brand, p_type, p_size))"""


@query("K4 D1 L1", f"""WITH {_MODEL},
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY exact DESC, p_size) AS r FROM cnd)
SELECT p_brand, p_type, p_size, score FROM b WHERE r = 1 ORDER BY exact DESC, p_brand, p_type, p_size LIMIT {K}""")
def candidates_model_ranked(spark, sf_dir):
    """The space scored by the fitted model, the best of each brand and type, ranked."""
    axes = axis_levels(spark, sf_dir)
    ((intercept, weights),) = fitted(spark, sf_dir, tuple(FEATURES.values()))
    parts = additive.part_tables(axis_cells(axes), weights)
    scored = additive.score_space(spark, axes, parts, additive.base_score(intercept, weights, {}))
    best = topk.diverse_top(scored, ["p_brand", "p_type"], "score", DIMS, K)
    return rounded(best.select(*DIMS, "score"), {"score": 3})


@query("T2 D1 K4", f"""WITH {_MODEL},
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY exact DESC, p_size) AS r FROM cnd)
SELECT p_brand, p_type, p_size, score, CAST(row_number() OVER (ORDER BY exact DESC, p_brand, p_type, p_size) AS INTEGER) AS place FROM b WHERE r = 1 QUALIFY place <= {K}""")
def candidates_best_first(spark, sf_dir):
    """The same list without enumerating the space."""
    axes = axis_levels(spark, sf_dir)
    ((intercept, weights),) = fitted(spark, sf_dir, tuple(FEATURES.values()))
    parts = additive.part_tables(axis_cells(axes), weights)
    tables = [additive.axis_parts(t.withColumnRenamed("level", a), [a], parts) for a, t in axes.items()]
    best = additive.best_candidates(tables, additive.base_score(intercept, weights, {}), K, distinct=["p_brand", "p_type"])
    return rounded(best, {"score": 3})


@query("K5 K6 T2 T4", f"""WITH {_MODEL},
r AS (SELECT CAST(t AS INTEGER) AS threshold, p_brand, p_type, p_size, score, CAST(row_number() OVER (PARTITION BY t ORDER BY exact DESC, p_brand, p_type, p_size) AS INTEGER) AS place
  FROM cnd, (SELECT unnest([1, 3, 5, 40]) AS t) WHERE n_rows >= t)
SELECT * FROM r WHERE place <= {K}""")
def supported_best_first(spark, sf_dir):
    """The best supported candidates per threshold; supported combinations are read from their table, never enumerated."""
    axes = axis_levels(spark, sf_dir)
    ((intercept, weights),) = fitted(spark, sf_dir, tuple(FEATURES.values()))
    parts = additive.part_tables(axis_cells(axes), weights)
    base = additive.base_score(intercept, weights, {})
    support = stage(cooccurrence(training_lines(spark, sf_dir), DIMS), "support")
    lists = []
    for t in (1, 3, 5, 40):
        known = additive.axis_parts(support.filter(F.col("n_rows") >= t), DIMS, parts)
        lists.append(additive.best_candidates([known], base, K).withColumn("threshold", F.lit(t)))
    return rounded(reduce(DataFrame.unionByName, lists), {"score": 3})


@query("L10 R5 L7", f"""WITH {_MODEL},
m2 AS (SELECT (var_pop(f3) * covar_pop(f1, y) - covar_pop(f1, f3) * covar_pop(f3, y)) / (var_pop(f1) * var_pop(f3) - covar_pop(f1, f3) * covar_pop(f1, f3)) AS c1,
  (var_pop(f1) * covar_pop(f3, y) - covar_pop(f1, f3) * covar_pop(f1, y)) / (var_pop(f1) * var_pop(f3) - covar_pop(f1, f3) * covar_pop(f1, f3)) AS c3, avg(y) AS my, avg(f1) AS m1, avg(f3) AS m3 FROM ml),
s AS (SELECT p_brand, p_type, p_size, score AS old, round(CAST(CAST(my - c1 * m1 - c3 * m3 AS DECIMAL(28, 9)) + CAST(c1 * {_BRAND} AS DECIMAL(28, 9)) + CAST(c3 * {_SIZE} AS DECIMAL(28, 9)) AS DOUBLE), 3) AS new FROM cnd, m2),
r AS (SELECT *, rank() OVER (ORDER BY old) + (count(*) OVER (PARTITION BY old) - 1) / 2.0 AS ra, rank() OVER (ORDER BY new) + (count(*) OVER (PARTITION BY new) - 1) / 2.0 AS rb,
  row_number() OVER (ORDER BY old DESC, p_brand, p_type, p_size) AS t1, row_number() OVER (ORDER BY new DESC, p_brand, p_type, p_size) AS t2 FROM s)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho, count(*) FILTER (t1 <= {K} AND t2 <= {K}) AS overlap_top, round(avg(abs(new - old)), 4) AS mean_abs_diff FROM r""")
def candidates_without_family(spark, sf_dir):
    """Refit without the type's columns; both models score the same space, and their rankings are compared."""
    axes = axis_levels(spark, sf_dir)
    every = tuple(FEATURES.values())
    kept = tuple(f for f in every if f != "type_length")
    scored = None
    for name, (intercept, weights) in zip(("old", "new"), fitted(spark, sf_dir, every, kept), strict=True):
        parts = additive.part_tables(axis_cells(axes), weights)
        one = additive.score_space(spark, axes, parts, additive.base_score(intercept, weights, {})).select("candidate_id", *DIMS, F.round("score", 3).alias(name))
        scored = one if scored is None else scored.join(one.select("candidate_id", name), "candidate_id")
    out = topk.rank_stability(stage(scored, "two-scores"), "old", "new", DIMS, ["p_brand", "p_type"])
    return rounded(out.select("n", "rho", "overlap_top", "mean_abs_diff"), {"rho": 9, "mean_abs_diff": 4})
