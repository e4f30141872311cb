import numpy as np
import pytest
from pyspark.sql import functions as F

from foldguard.operators import gram, learning
from foldguard.operators.gram import LinearModel
from foldguard.operators.splits import hash_fold


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select("id", F.rand(1).alias("a"), (F.rand(2) * 1000).alias("b"), F.rand(3).alias("c"), F.pmod(F.xxhash64("id"), F.lit(30)).alias("g"))
    df = df.withColumns({"y": 2 * F.col("a") + F.col("b") / 100 + F.rand(4), "group_fold": hash_fold(F.col("g"), 5), "row_fold": hash_fold(F.col("id"), 5)}).cache()
    df.count()
    return df


def labels():
    return {"group": F.col("group_fold"), "row": F.col("row_fold"), "low": F.when(F.col("y") < 6, F.col("group_fold"))}


@pytest.fixture(scope="module")
def grams(rows):
    return gram.fold_grams(rows, ["a", "b", "c", "y"], labels())


def test_matrices_are_sums_over_rows(rows, grams):
    pdf = rows.toPandas()
    for f in range(5):
        x = np.column_stack([np.ones((pdf.group_fold == f).sum()), pdf.loc[pdf.group_fold == f, ["a", "b", "c", "y"]]])
        assert np.allclose(grams.of("group", f), x.T @ x)
    low = pdf[pdf.y < 6]
    assert grams.without("low", None)[0, 0] == len(low) and grams.without("low", 2)[0, 0] == (low.group_fold != 2).sum()
    assert grams.folds("row") == list(range(5))


@pytest.mark.parametrize("features", [("a",), ("a", "b"), ("a", "b", "c")])
def test_scores_equal_a_fit_per_fold(spark, rows, grams, features):
    models = {"group": LinearModel(features, "group"), "row": LinearModel(features, "row")}
    got = {(r.name, r.fold): r for r in gram.fold_scores(spark, grams, models, "y", range(5)).collect()}
    whole = {(r.name, r.fold): r for r in gram.row_scores(rows, grams, models, labels(), "y", {"group": range(5), "row": range(5)}).collect()}
    for label in ("group", "row"):
        want = {r[f"{label}_fold"]: r for r in learning.fold_scores(rows, learning.least_squares(features, "y"), "y", f"{label}_fold", 5).collect()}
        for f in range(5):
            r, w = got[label, f], whole[label, f]
            assert (r.n, r.rmse, r.r2) == (want[f].n, pytest.approx(want[f].rmse), pytest.approx(want[f].r2))
            assert (w.n, w.mae, w.rmse, w.r2) == (want[f].n, pytest.approx(want[f].mae), pytest.approx(want[f].rmse), pytest.approx(want[f].r2))


def test_ridge_scales_its_columns(rows, grams):
    pdf = rows.toPandas()
    x = pdf[["a", "b"]].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 7 * np.eye(2), z.T @ (pdf.y - pdf.y.mean()).to_numpy()) / x.std(0)
    m = grams.without("group", None)
    # The penalty is on sums of squares of scaled columns, as is the matrix.
    got = gram.solved(m, grams.at(["a", "b"]), grams.at(["y"])[0], 7.0)
    assert np.allclose(got[1:], w) and got[0] == pytest.approx(pdf.y.mean() - w @ x.mean(0))


def test_constant_repeated_and_missing_columns(spark):
    rows = [(float(i), 3.0, 2.0 * i, 5.0 + 4 * i, i % 2) for i in range(20)] + [(None, 3.0, 1.0, 1.0, 0), (1.0, 3.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, k double, twice double, y double, fold int")
    grams = gram.fold_grams(df, ["a", "k", "twice", "y"], {"f": F.col("fold")})
    assert grams.without("f", None)[0, 0] == 20
    scores = gram.fold_scores(spark, grams, {"m": LinearModel(("a", "k", "twice"), "f")}, "y", [0, 1, 7]).collect()
    assert [r.r2 for r in scores][:2] == pytest.approx([1.0, 1.0]) and scores[2].n == 0 and scores[2].r2 is None
    none = gram.fold_grams(df.limit(0), ["a", "y"], {"f": F.col("fold")})
    assert not none.matrices and gram.fold_scores(spark, none, {"m": LinearModel(("a",), "f")}, "y", [0]).first().r2 is None


def test_inflation_is_the_gap_of_the_means(spark):
    scores = spark.createDataFrame([("r", 0, 0.5), ("r", 1, 0.7), ("g", 0, 0.2), ("g", 1, 0.4)], "name string, fold int, r2 double")
    row = gram.split_inflation(scores, "r", "g").first()
    assert (row.random_r2_mean, row.group_r2_mean, row.inflation) == (pytest.approx(0.6), pytest.approx(0.3), pytest.approx(0.3))
