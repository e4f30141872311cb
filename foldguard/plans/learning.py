"""Learning queries: cross-validation, comparisons, attribution.

Linear models have closed forms, so most of these have SQL twins too; here they are solved from Gram matrices. Tree models
are checked for rows here and for their behaviour in the tests.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_key
from ..operators import boosting, features, gram, learning, metrics, topk
from ..operators.boosting import BoostSettings
from ..operators.gram import LinearModel
from ..operators.splits import TEST, hash_fold, hash_holdout
from ..session import new_location, spread, stage
from .base import SPELLED, TEST_CUT, query, rounded, spelled_orders, sql_bucket, table

FOLDS = 5
GRID_FOLDS = 3  # of the grid's search

# --- least squares in SQL ------------------------------------------------------------------

_R2 = "1 - avg((y - p) * (y - p)) / var_pop(y)"


def _fit_one(x: str, y: str) -> str:
    return f"regr_slope({y}, {x}) AS b1, regr_intercept({y}, {x}) AS b0"


def _fit_two(a: str, b: str, y: str) -> str:
    """Slopes and intercept of y on two columns from their (co)variances."""
    saa, sbb, sab = f"var_pop({a})", f"var_pop({b})", f"covar_pop({a}, {b})"
    say, sby = f"covar_pop({a}, {y})", f"covar_pop({b}, {y})"
    det = f"({saa} * {sbb} - {sab} * {sab})"
    b1, b2 = f"(({sbb} * {say} - {sab} * {sby}) / {det})", f"(({saa} * {sby} - {sab} * {say}) / {det})"
    return f"{b1} AS b1, {b2} AS b2, avg({y}) - {b1} * avg({a}) - {b2} * avg({b}) AS b0"


def _cv_sql(rows: str, fold: str, fit: str, predict: str, label: str) -> str:
    """Mean and spread of R² over folds for a closed-form fit on all other folds."""
    return f"""
SELECT '{label}' AS label, round(avg(r2), 8) AS r2_mean, round(stddev_pop(r2), 8) AS r2_std FROM (
  SELECT r.{fold}, {_R2} AS r2 FROM (
    SELECT t.{fold}, t.y, {predict} AS p FROM {rows} t JOIN (
      SELECT f.{fold}, {fit} FROM (SELECT DISTINCT {fold} FROM {rows}) f JOIN {rows} o ON o.{fold} <> f.{fold} GROUP BY f.{fold}) m ON m.{fold} = t.{fold}) r
  GROUP BY r.{fold})"""


_LINES = f"""
lines AS (
  SELECT l_quantity AS x1, p_retailprice AS x2, l_extendedprice * 0.5::DOUBLE + l_tax * 100000 AS x3, l_extendedprice AS y,
    CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount * 100 + l_linenumber END AS x4,
    CAST({sql_bucket(42, 'l_suppkey')} % {FOLDS} AS INTEGER) AS fold, CAST({sql_bucket(7, 'l_suppkey')} % {FOLDS} AS INTEGER) AS fold2,
    CASE WHEN {sql_bucket(42, 'l_suppkey')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lines(spark, sf_dir):
    """Model rows: three plain features, one that leaks the outcome, one with holes; supplier-safe folds."""
    g = F.col("l_suppkey")
    line = spread(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
        )
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = line.join(part, "l_partkey").select(
        F.col("l_quantity").alias("x1"), F.col("p_retailprice").alias("x2"),
        (F.col("l_extendedprice") * 0.5 + F.col("l_tax") * 100000).alias("x3"),
        F.when(F.pmod("l_orderkey", F.lit(5)) != 0, F.col("l_discount") * 100 + F.col("l_linenumber")).alias("x4"),
        F.col("l_extendedprice").alias("y"), hash_fold(g, FOLDS).alias("fold"), hash_fold(g, FOLDS, 7).alias("fold2"),
        hash_holdout(g, "0.2").alias("split"), "l_suppkey",
    )
    return stage(rows, "model-rows")  # every fold's fit reads it again


R2_DIGITS = {"r2_mean": 8, "r2_std": 8}


def _scores(df, label_col="name"):
    return rounded(df.select(F.col(label_col).alias("label"), "r2_mean", "r2_std"), R2_DIGITS)


def _plain(features_):
    return learning.least_squares(features_, "y")


def _by_gram(df, models: dict[str, LinearModel], labels, columns):
    """Mean and spread of R² over the folds for all models, from one scan."""
    grams = gram.fold_grams(df, [*columns, "y"], labels)
    return _scores(gram.spread_over_folds(gram.fold_scores(df.sparkSession, grams, models, "y", range(FOLDS))))


@query("L2 A2", f"WITH {_LINES} {_cv_sql('lines', 'fold', _fit_one('x1', 'y'), 'b0 + b1 * t.x1', 'ols')}")
def ml_cv(spark, sf_dir):
    return _by_gram(lines(spark, sf_dir), {"ols": LinearModel(("x1",), "fold")}, {"fold": F.col("fold")}, ["x1"])


@query("L5 L6 L7 P17", f"""WITH {_LINES}
{_cv_sql('lines', 'fold', _fit_one('x1', 'y'), 'b0 + b1 * t.x1', 'base')} UNION ALL
{_cv_sql('lines', 'fold', _fit_two('x1', 'x2', 'y'), 'b0 + b1 * t.x1 + b2 * t.x2', 'base_price')} UNION ALL
{_cv_sql('lines', 'fold', _fit_two('x1', 'x3', 'y'), 'b0 + b1 * t.x1 + b2 * t.x3', 'base_leak')}""")
def ml_scopes(spark, sf_dir):
    scopes = {"base": ("x1",), "base_price": ("x1", "x2"), "base_leak": ("x1", "x3")}
    models = {name: LinearModel(columns, "fold") for name, columns in scopes.items()}
    return _by_gram(lines(spark, sf_dir), models, {"fold": F.col("fold")}, ["x1", "x2", "x3"])


@query("L7 C12", f"""WITH {_LINES}, low AS (SELECT * FROM lines WHERE y <= 80000), lowest AS (SELECT * FROM lines WHERE y <= 40000)
{_cv_sql('lines', 'fold', _fit_one('x3', 'y'), 'b0 + b1 * t.x3', 'all')} UNION ALL
{_cv_sql('low', 'fold', _fit_one('x3', 'y'), 'b0 + b1 * t.x3', 'le_80000')} UNION ALL
{_cv_sql('lowest', 'fold', _fit_one('x3', 'y'), 'b0 + b1 * t.x3', 'le_40000')}""")
def ml_subsets(spark, sf_dir):
    y, fold = F.col("y"), F.col("fold")
    labels = {"all": fold, "le_80000": F.when(y <= 80000, fold), "le_40000": F.when(y <= 40000, fold)}
    return _by_gram(lines(spark, sf_dir), {name: LinearModel(("x3",), name) for name in labels}, labels, ["x3"])


_GLOBAL = "filled AS (SELECT y, fold, coalesce(x4, (SELECT median(x4) FROM lines)) AS x FROM lines)"
_LOCAL = """
meds AS (SELECT f.fold AS f, median(x4) AS m FROM (SELECT DISTINCT fold FROM lines) f JOIN lines o ON o.fold <> f.fold GROUP BY f.fold),
local_rows AS (SELECT f, fold, y, coalesce(x4, m) AS x FROM lines, meds),
local_fit AS (SELECT f, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM local_rows WHERE fold <> f GROUP BY f),
local_r2 AS (SELECT f, 1 - avg((y - b0 - b1 * x) * (y - b0 - b1 * x)) / var_pop(y) AS r2 FROM local_rows JOIN local_fit USING (f) WHERE fold = f GROUP BY f)"""


@query("L8 F7 F2", f"""WITH {_LINES}, {_GLOBAL}, {_LOCAL}
{_cv_sql('filled', 'fold', _fit_one('x', 'y'), 'b0 + b1 * t.x', 'global')}
UNION ALL SELECT 'fold_local', round(avg(r2), 8), round(stddev_pop(r2), 8) FROM local_r2""")
def ml_local_vs_global(spark, sf_dir):
    """Imputation learned from all rows against imputation learned per training part."""
    df = lines(spark, sf_dir)
    fills = {r["fold"]: r["x4_median"] for r in features.fold_local_fills(df, "fold", FOLDS, ["x4"]).collect()}  # one row per fold
    fills["all"] = features.medians(df, ["x4"])["x4"]
    filled = df.withColumns({f"x_{f}": F.coalesce("x4", F.lit(v)) for f, v in fills.items()})
    # A column per training part, all in one scan: the model of a fold reads the column that its training part filled.
    grams = gram.fold_grams(filled, [*[f"x_{f}" for f in fills], "y"], {"fold": F.col("fold")})
    local = [gram.fold_scores(spark, grams, {"fold_local": LinearModel((f"x_{f}",), "fold")}, "y", [f]) for f in range(FOLDS)]
    everywhere = gram.fold_scores(spark, grams, {"global": LinearModel(("x_all",), "fold")}, "y", range(FOLDS))
    return _scores(gram.spread_over_folds(reduce(DataFrame.unionByName, local, everywhere)))


_SPELLED_ROWS = f"""{SPELLED},
rows_ AS (SELECT o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x, CAST({sql_bucket(42, "coalesce(raw_key, 'unknown')")} % {FOLDS} AS INTEGER) AS raw_fold,
  CAST({sql_bucket(42, "coalesce(norm_key, 'unknown')")} % {FOLDS} AS INTEGER) AS norm_fold,
  CAST({sql_bucket(42, "o_orderkey")} % {FOLDS} AS INTEGER) AS row_fold, coalesce(raw_key, 'unknown') AS raw_group, coalesce(norm_key, 'unknown') AS norm_group,
  CAST({sql_bucket(42, "coalesce(raw_key, 'unknown')")} >= {TEST_CUT} AS INTEGER) AS raw_side, CAST({sql_bucket(42, "coalesce(norm_key, 'unknown')")} >= {TEST_CUT} AS INTEGER) AS norm_side FROM normed)"""


@query("L9 P12 G3", f"""WITH {_SPELLED_ROWS}
{_cv_sql('rows_', 'raw_fold', _fit_one('x', 'y'), 'b0 + b1 * t.x', 'raw')} UNION ALL
{_cv_sql('rows_', 'norm_fold', _fit_one('x', 'y'), 'b0 + b1 * t.x', 'normalized')}""")
def ml_key_sensitivity(spark, sf_dir):
    labels = {"raw": F.col("raw_fold"), "normalized": F.col("norm_fold")}
    return _by_gram(spelled_rows(spark, sf_dir), {name: LinearModel(("x",), name) for name in labels}, labels, ["x"])


def spelled_rows(spark, sf_dir):
    """Orders with the folds and sides that rows, raw keys and normalised keys give them."""
    o = spread(spelled_orders(spark, sf_dir))
    unknown = F.lit("unknown")
    raw, norm = F.coalesce(F.col("raw_key"), unknown), F.coalesce(normalize_key(F.col("raw_key")), unknown)
    side = lambda key: (hash_holdout(key, "0.2") != TEST).cast("int")
    return stage(
        o.select(
            F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"), hash_fold(F.col("o_orderkey"), FOLDS).alias("row_fold"),
            hash_fold(raw, FOLDS).alias("raw_fold"), hash_fold(norm, FOLDS).alias("norm_fold"),
            side(raw).alias("raw_side"), side(norm).alias("norm_side"), raw.alias("raw_group"), norm.alias("norm_group"),
        ),
        "key-sensitivity",
    )


def _report_sql(name: str, held: str, side: str, group: str) -> str:
    """Cross-validated and holdout metrics of the line through x under one way to group rows."""
    others = f"SELECT f.k, {_fit_one('x', 'y')} FROM (SELECT DISTINCT {held} AS k FROM rows_) f JOIN rows_ o ON o.{held} <> f.k GROUP BY f.k"
    return f"""
SELECT '{name}' AS grouping, cv.*, ho.*, (SELECT count(DISTINCT {group}) FROM rows_) AS n_groups FROM (
  SELECT avg(mae) AS cv_mae, avg(rmse) AS cv_rmse, avg(r2) AS cv_r2, stddev_pop(r2) AS cv_r2_std FROM (
    SELECT avg(abs(y - b0 - b1 * x)) AS mae, sqrt(avg(pow(y - b0 - b1 * x, 2))) AS rmse, 1 - avg(pow(y - b0 - b1 * x, 2)) / var_pop(y) AS r2
    FROM rows_ JOIN ({others}) m ON m.k = {held} GROUP BY {held})) cv, (
  SELECT avg(abs(y - b0 - b1 * x)) AS holdout_mae, sqrt(avg(pow(y - b0 - b1 * x, 2))) AS holdout_rmse, 1 - avg(pow(y - b0 - b1 * x, 2)) / var_pop(y) AS holdout_r2, count(*) AS n_test
  FROM rows_, (SELECT {_fit_one('x', 'y')} FROM rows_ WHERE {side} = 1) WHERE {side} = 0) ho"""


_REPORT = [f"{part}_{m}" for part in ("cv", "holdout") for m in ("mae", "rmse", "r2")]


@query("L9 P12 G1 G2", f"""WITH {_SPELLED_ROWS}, ways AS ({_report_sql('raw', 'raw_fold', 'raw_side', 'raw_group')} UNION ALL {_report_sql('normalized', 'norm_fold', 'norm_side', 'norm_group')}),
deltas AS (SELECT 'delta' AS grouping, {', '.join(f'r.{c} - n.{c} AS {c}' for c in _REPORT)}, r.n_test - n.n_test AS n_test, r.n_groups - n.n_groups AS n_groups
  FROM ways r, ways n WHERE r.grouping = 'raw' AND n.grouping = 'normalized')
SELECT grouping, {', '.join(f'round({c}, 6) AS {c}' for c in _REPORT)}, n_test, n_groups FROM ways
UNION ALL SELECT grouping, {', '.join(f'round({c}, 6) AS {c}' for c in _REPORT)}, n_test, n_groups FROM deltas""")
def ml_key_report(spark, sf_dir):
    """The same model with keys as they are and normalised: holdout and cross-validated errors, and what normalising changes."""
    rows = spelled_rows(spark, sf_dir)
    ways = {"raw": ("raw_fold", "raw_side", "raw_group"), "normalized": ("norm_fold", "norm_side", "norm_group")}
    labels = {f"{kind}_{name}": F.col(c) for name, way in ways.items() for kind, c in zip(("cv", "holdout"), way)}
    grams = gram.fold_grams(rows, ["x", "y"], labels)
    models = {label: LinearModel(("x",), label) for label in labels}
    folds = {label: range(FOLDS) if label.startswith("cv") else [0] for label in labels}
    scores = gram.row_scores(rows, grams, models, labels, "y", folds)
    flat = scores.select(F.split("name", "_")[0].alias("part"), F.split("name", "_")[1].alias("grouping"), "n", "mae", "rmse", "r2")
    wide = flat.groupBy("grouping").agg(
        *[F.avg(F.when(F.col("part") == part, F.col(m))).alias(f"{part}_{m}") for part in ("cv", "holdout") for m in ("mae", "rmse", "r2")],
        F.max(F.when(F.col("part") == "holdout", F.col("n"))).alias("n_test"),
    )
    groups = rows.agg(*[F.count_distinct(way[2]).alias(name) for name, way in ways.items()]).first()
    counted = wide.withColumn("n_groups", F.when(F.col("grouping") == "raw", F.lit(groups["raw"])).otherwise(F.lit(groups["normalized"])))
    sign = F.when(F.col("grouping") == "raw", 1).otherwise(-1)
    delta = counted.agg(*[F.sum(sign * F.col(c)).alias(c) for c in [*_REPORT, "n_test", "n_groups"]]).withColumn("grouping", F.lit("delta"))
    return rounded(counted.unionByName(delta), {c: 6 for c in _REPORT})


@query("A27 G3 G4", f"""WITH {_SPELLED_ROWS}, random AS ({_cv_sql('rows_', 'row_fold', _fit_one('x', 'y'), 'b0 + b1 * t.x', 'random')}), grouped AS ({_cv_sql('rows_', 'norm_fold', _fit_one('x', 'y'), 'b0 + b1 * t.x', 'group')})
SELECT r.r2_mean AS random_r2_mean, r.r2_std AS random_r2_std, g.r2_mean AS group_r2_mean, g.r2_std AS group_r2_std, round(r.r2_mean - g.r2_mean, 7) AS inflation FROM random r, grouped g""")
def ml_split_inflation(spark, sf_dir):
    """One fitted model under random row folds and under folds of whole groups; both assignments in one scan."""
    rows = spelled_rows(spark, sf_dir)
    labels = {"random": F.col("row_fold"), "group": F.col("norm_fold")}
    grams = gram.fold_grams(rows, ["x", "y"], labels)
    scores = gram.fold_scores(spark, grams, {name: LinearModel(("x",), name) for name in labels}, "y", range(FOLDS))
    digits = {c: 8 for c in ("random_r2_mean", "random_r2_std", "group_r2_mean", "group_r2_std")}
    return rounded(gram.split_inflation(scores, "random", "group"), digits | {"inflation": 7})


@query("A27 L2 L4")
def ml_tree_inflation(spark, sf_dir):
    """The same with boosted trees and a target that belongs to the group: trees can learn a group from its other rows."""
    rows = spelled_rows(spark, sf_dir)
    effect = F.pmod(F.xxhash64("norm_group"), F.lit(1000)) * 300.0
    known = stage(rows.select("x", (F.col("y") + effect).alias("y"), "row_fold", "norm_fold"), "inflation-rows")
    trees = BoostSettings(rounds=100, step=0.1, leaves=63)
    out = None
    for name, fold in (("random", "row_fold"), ("group", "norm_fold")):
        edges = boosting.bin_edges(known, ["x"], 1024)
        cells = boosting.cell_table(known, edges, "y", fold)
        scores = boosting.fold_errors(cells, boosting.fold_predictions(cells, ["x"], {name: trees}, range(FOLDS)), ["x"])
        out = scores if out is None else out.unionByName(scores)
    return gram.split_inflation(out, "random", "group")


@query("A27 L2", f"""WITH {_LINES}
{_cv_sql('lines', 'fold', _fit_one('x3', 'y'), 'b0 + b1 * t.x3', 'seed_42')} UNION ALL
{_cv_sql('lines', 'fold2', _fit_one('x3', 'y'), 'b0 + b1 * t.x3', 'seed_7')}""")
def ml_fold_seeds(spark, sf_dir):
    """The same model under two assignments of groups to folds."""
    labels = {"seed_42": F.col("fold"), "seed_7": F.col("fold2")}
    return _by_gram(lines(spark, sf_dir), {name: LinearModel(("x3",), name) for name in labels}, labels, ["x3"])


_PARTS_SCORED = f"""{_LINES},
old_fit AS (SELECT {_fit_two('x1', 'x2', 'y')} FROM lines WHERE split = 'train'), new_fit AS (SELECT {_fit_two('x1', 'x2', 'y')} FROM lines),
scored AS (SELECT p_partkey, o.b0 + o.b1 * p_size + o.b2 * p_retailprice AS old, n.b0 + n.b1 * p_size + n.b2 * p_retailprice AS new FROM part, old_fit o, new_fit n)"""


def rescored_parts(spark, sf_dir):
    """Parts as candidates, scored by a model of the training side and by its refit on all rows."""
    df = lines(spark, sf_dir)
    candidates = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("x2")
    )
    model = _plain(["x1", "x2"])
    old = learning.refit_and_rescore(df.filter(F.col("split") == "train"), model, candidates)
    old = old.drop("_vector").withColumnRenamed(learning.PREDICTION, "old")
    return learning.refit_and_rescore(df, model, old).drop("_vector").withColumnRenamed(learning.PREDICTION, "new")


@query("L10 K4", f"WITH {_PARTS_SCORED} SELECT p_partkey, round(old, 3) AS old, round(new, 3) AS new FROM scored")
def ml_refit(spark, sf_dir):
    return rounded(rescored_parts(spark, sf_dir).select("p_partkey", "old", "new"), {"old": 3, "new": 3})


@query("L10 R5", f"""WITH {_PARTS_SCORED.replace('AS old, n.b0', 'AS old_, n.b0').replace('AS new FROM part', 'AS new_ FROM part')},
s AS (SELECT scored.*, p_brand, round(old_, 3) AS old, round(new_, 3) AS new FROM scored JOIN part USING (p_partkey)),
r AS (SELECT *, rank() OVER (ORDER BY old) + (count(*) OVER (PARTITION BY old) - 1) / 2.0 AS ra, rank() OVER (ORDER BY new) + (count(*) OVER (PARTITION BY new) - 1) / 2.0 AS rb,
  row_number() OVER (ORDER BY old DESC, p_partkey) AS t1, row_number() OVER (ORDER BY new DESC, p_partkey) AS t2 FROM s)
SELECT count(*) AS n, round(corr(ra, rb), 9) AS rho, count(*) FILTER (t1 <= 30 AND t2 <= 30) AS overlap_top, round(avg(abs(new - old)), 4) AS mean_abs_diff FROM r""")
def ml_refit_stability(spark, sf_dir):
    scored = rounded(rescored_parts(spark, sf_dir), {"old": 3, "new": 3})
    out = topk.rank_stability(scored, "old", "new", ["p_partkey"], ["p_brand"])
    return rounded(out.select("n", "rho", "overlap_top", "mean_abs_diff"), {"rho": 9, "mean_abs_diff": 4})


@query("S10 L1", f"""WITH {_LINES}, fit AS (SELECT {_fit_two('x1', 'x2', 'y')} FROM lines)
SELECT p_partkey, round(b0 + b1 * p_size + b2 * p_retailprice, 3) AS score FROM part, fit""")
def model_reload(spark, sf_dir):
    path = new_location(spark, "model")
    learning.save_model(_plain(["x1", "x2"]).fit(lines(spark, sf_dir)), path)
    candidates = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x1"), F.col("p_retailprice").alias("x2")
    )
    scored = learning.load_model(path).transform(candidates)
    return scored.select("p_partkey", F.round(learning.PREDICTION, 3).alias("score"))


@query("L11", """
WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_extendedprice) AS e FROM lineitem)
SELECT 'l_quantity' AS feature, round(avg(abs(-1.5::DOUBLE * (l_quantity - q))), 8) AS mean_abs_contribution FROM lineitem, m
UNION ALL SELECT 'l_discount', round(avg(abs(40.0::DOUBLE * (l_discount - d))), 8) FROM lineitem, m UNION ALL SELECT 'l_tax', round(avg(abs(25.0::DOUBLE * (l_tax - t))), 8) FROM lineitem, m
UNION ALL SELECT 'l_extendedprice', round(avg(abs(0.0001::DOUBLE * (l_extendedprice - e))), 8) FROM lineitem, m""")
def linear_attribution(spark, sf_dir):
    weights = {"l_quantity": -1.5, "l_discount": 40.0, "l_tax": 25.0, "l_extendedprice": 0.0001}
    out = learning.linear_attribution(table(spark, sf_dir, "lineitem").select(*weights), weights)
    return rounded(out, {"mean_abs_contribution": 8})


_ORDER_ROWS = """
ord AS (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS x1, CAST(month(o_orderdate) AS DOUBLE) AS x2, o_totalprice + o_custkey * 200.0::DOUBLE + month(o_orderdate) * 9000.0::DOUBLE AS y FROM orders)"""


def _permuted_sql(column: str) -> str:
    other = "x2" if column == "x1" else "x1"
    slopes = ("b1", "b2") if column == "x1" else ("b2", "b1")
    return f"""
SELECT '{column}' AS feature, round((avg(pow(a.y - b0 - {slopes[0]} * v.{column} - {slopes[1]} * a.{other}, 2)) - (SELECT avg(pow(y - b0 - b1 * x1 - b2 * x2, 2)) FROM ord, fit)) / 1e6, 3) AS mse_increase
FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS r FROM ord) a
JOIN (SELECT *, row_number() OVER (ORDER BY md5('42|{column}|' || o_orderkey), o_orderkey) AS r FROM ord) v USING (r), fit"""


@query("L11 R1", f"WITH {_ORDER_ROWS}, fit AS (SELECT {_fit_two('x1', 'x2', 'y')} FROM ord) {_permuted_sql('x1')} UNION ALL {_permuted_sql('x2')}")
def permutation_importance(spark, sf_dir):
    month = F.month("o_orderdate").cast("double")
    rows = stage(
        spread(table(spark, sf_dir, "orders")).select(
            "o_orderkey", F.col("o_custkey").cast("double").alias("x1"), month.alias("x2"),
            (F.col("o_totalprice") + F.col("o_custkey") * 200.0 + month * 9000.0).alias("y"),
        ),
        "permutation-rows",
    )
    model = _plain(["x1", "x2"]).fit(rows)
    out = learning.permutation_importance(rows, model, ["x1", "x2"], "y", "o_orderkey")
    return out.select("feature", F.round(F.col("mse_increase") / 1e6, 3).alias("mse_increase"))


@query("L12", f"""WITH {_LINES}, g AS (SELECT l_suppkey, avg(abs(y - x1 * x2)) - avg(abs(y - x3 * 1.5)) AS d FROM lines GROUP BY l_suppkey)
SELECT count(*) AS n_groups, round(avg(d), 4) AS mean_diff, round(stddev_samp(d), 4) AS std_diff, round(avg(d) * sqrt(count(*)) / stddev_samp(d), 6) AS t FROM g""")
def paired_models(spark, sf_dir):
    df = lines(spark, sf_dir).withColumns({"pa": F.col("x1") * F.col("x2"), "pb": F.col("x3") * 1.5})
    out = metrics.paired_model_difference(df, "y", "pa", "pb", "l_suppkey")
    return rounded(out, {"mean_diff": 4, "std_diff": 4, "t": 6})


# --- tree models: rows only ----------------------------------------------------------------


def tree_rows(spark, sf_dir):
    """``lines`` with three more supplier-safe folds to search on."""
    return lines(spark, sf_dir).withColumn("search_fold", hash_fold(F.col("l_suppkey"), GRID_FOLDS, 7))


@query("L1 L4 T1")
def ml_compare(spark, sf_dir):
    """All registered kinds of model at the registry's settings, cross-validated and on the holdout."""
    df = tree_rows(spark, sf_dir)
    models = learning.model_registry(["x1", "x2", "x3"], "y", df.count())
    comparison, best = learning.compare_models(df, models, "y", "fold", FOLDS, "split")
    return comparison.withColumn("is_best", F.col("model") == best)


def grid_settings() -> dict[str, BoostSettings]:
    """The grid's steps, leaves, penalties and rounds."""
    axes = {"step": [0.05, 0.1], "leaves": [31, 63], "l2": [0.0, 1.0], "rounds": [200, 400]}
    return {"_".join(map(str, v)): BoostSettings(**dict(zip(axes, v, strict=True))) for v in product(*axes.values())}


@query("L3")
def ml_grid(spark, sf_dir):
    """Grid search of boosted trees on three group folds of one seed, honest scores on five of another."""
    df = tree_rows(spark, sf_dir)
    found, best = boosting.boosted_grid(df, ["x1", "x2", "x3"], "y", grid_settings(), "search_fold", GRID_FOLDS, "fold", FOLDS)
    return found.withColumns({"is_best": F.col("name") == best["name"], "best_r2_mean": F.lit(best["r2_mean"]), "best_r2_std": F.lit(best["r2_std"])})
