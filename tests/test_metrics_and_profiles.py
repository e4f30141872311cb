import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldguard.operators import audit, metrics, profile


@pytest.fixture(scope="module")
def preds():
    rng = np.random.default_rng(5)
    n = 900
    y = rng.normal(10, 4, n)
    return pd.DataFrame({"y": y, "p": y + rng.normal(0, 2, n), "g": rng.integers(0, 50, n), "fold": rng.integers(0, 3, n)})


def r2(d):
    return 1 - ((d.y - d.p) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum()


def test_metrics(spark, preds):
    got = metrics.regression_metrics(spark.createDataFrame(preds), "y", "p", ["fold"]).toPandas().set_index("fold").sort_index()
    for f, d in preds.groupby("fold"):
        assert got.loc[f, "mae"] == pytest.approx((d.y - d.p).abs().mean())
        assert got.loc[f, "rmse"] == pytest.approx(np.sqrt(((d.y - d.p) ** 2).mean()))
        assert got.loc[f, "r2"] == pytest.approx(r2(d))
    spread = metrics.metrics_over_folds(metrics.regression_metrics(spark.createDataFrame(preds), "y", "p", ["fold"])).first()
    assert spread["r2_std"] == pytest.approx(np.std([r2(d) for _, d in preds.groupby("fold")]))


def test_mean_baseline_is_slightly_worse_than_zero(spark, preds):
    got = {r["fold"]: r for r in metrics.mean_baseline(spark.createDataFrame(preds), "y", "fold").collect()}
    for f, d in preds.groupby("fold"):
        mean = preds[preds.fold != f].y.mean()
        assert got[f]["mae"] == pytest.approx((d.y - mean).abs().mean())
        assert got[f]["r2"] <= 0


def test_macro_errors(spark, preds):
    row = metrics.macro_errors(spark.createDataFrame(preds), "y", "p", "g").first()
    per = (preds.y - preds.p).abs().groupby(preds.g).mean()
    assert row["n_groups"] == len(per)
    assert row["macro_mae"] == pytest.approx(per.mean()) and row["median_group_mae"] == pytest.approx(per.median())


def test_noise_floor(spark):
    rng = np.random.default_rng(1)
    d = pd.DataFrame({"k": rng.integers(0, 60, 400) / 100 + 0.001, "g": rng.integers(0, 4, 400), "y": rng.normal(0, 1, 400)})
    row = profile.noise_floor(spark.createDataFrame(d), "y", "g", {"k": ["k"]}).first()
    d["k"] = d["k"].round(2)
    keep = d.groupby("k").filter(lambda x: len(x) >= 2 and x.g.nunique() >= 2)
    resid = keep.y - keep.groupby("k").y.transform("mean")
    var = (resid**2).sum() / (len(keep) - keep.k.nunique())
    assert row["n_keys"] == keep.k.nunique() and row["n_rows"] == len(keep)
    assert row["pooled_var"] == pytest.approx(var)
    assert row["rmse_floor"] == pytest.approx(np.sqrt((resid**2).mean()))
    assert row["r2_ceiling"] == pytest.approx(1 - var / d.y.var())
    assert row["std_median"] == pytest.approx(keep.groupby("k").y.std().median())


def test_group_size_profile(spark):
    sizes = [1] * 150 + [2] * 60 + [50, 40, 7]
    df = spark.createDataFrame([(g,) for g, n in enumerate(sizes) for _ in range(n)] + [(None,)], "g int")
    row = profile.group_size_profile(df, "g").first()
    s = pd.Series(sizes)
    assert (row["n_groups"], row["n_rows"], row["n_singletons"], row["max_size"]) == (213, s.sum(), 150, 50)
    assert row["size_p99"] == pytest.approx(s.quantile(0.99))
    assert row["top_share"] == pytest.approx(90 / s.sum())
    assert profile.group_size_profile(df, "g", include_null_group=True).first()["n_groups"] == 214


def test_bins(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.5, 2.0), (0.9, 3.0), (1.0, 4.0), (2.0, 5.0), (2.1, 6.0)], "x double, y double")
    hist = {r["bin"]: r["n"] for r in profile.histogram(df, "x", 0.0, 0.5, 4).collect()}
    assert hist == {0: 1, 1: 2, 2: 1, 3: 1}  # the last bin holds its right edge, 2.1 is outside
    means = {r["bin"]: (r["mean"], r["n"]) for r in profile.binned_mean(df, "x", "y", 0.0, 0.5, 4, 1).collect()}
    assert means == {0: (2.0, 1), 1: (3.5, 2), 3: (5.0, 1)}  # right-closed: 0.0 is outside, 0.5 in the first


def test_category_rest(spark):
    df = spark.createDataFrame([(c,) for c in "aaabbbccddeefg"] + [(None,)], "c string")
    assert {r["category"]: r["n"] for r in profile.category_shares(df, "c", 5).collect()}["other"] == 3
    six = df.filter("c < 'g'")
    assert {r["category"] for r in profile.category_shares(six, "c", 5).collect()} == set("abcdef")


def test_paired_differences(spark):
    df = spark.createDataFrame(
        [("a", True, 1.0), ("a", False, 5.0), ("a", False, 7.0), ("b", True, 2.0), ("c", False, 3.0)], "g string, f boolean, v double"
    )
    out = audit.paired_differences(df, "g", "f", "v").collect()
    assert [(r["g"], r["diff"]) for r in out] == [("a", -5.0)]


def test_collisions_and_contamination(spark):
    df = spark.createDataFrame(
        [("10.1/a", "train", 1.0, 2.0), ("10.1/A", "test", 1.0, 4.0), ("10.1/b", "test", 1.0, 2.0), ("10.1/c ", "test", 1.0, 1.0),
         ("10.1/c", "test", 1.0, 1.0), (None, "train", 1.0, 9.0)],
        "k string, split string, y double, p double",
    )
    found = {r["norm_key"]: r for r in audit.collisions(df, "k").collect()}
    assert set(found) == {"10.1/a", "10.1/c"}
    assert found["10.1/a"]["by_case"] and not found["10.1/a"]["by_space"] and found["10.1/c"]["by_space"]
    assert [r["norm_key"] for r in audit.crossing_keys(df, "k", "split").collect()] == ["10.1/a"]
    rows = {r["mask"]: r for r in audit.contamination(df, "k", "split", "y", "p", hot_rows=1).collect()}
    assert (rows["contaminated_test"]["n"], rows["contaminated_test"]["mae"]) == (1, 3.0)
    assert rows["clean_test"]["n"] == 3 and rows["train_side"]["n"] == 1


def test_one_row_and_scalars(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([(2.5,)], "d double")
    assert metrics.one_row(a, b).first().asDict() == {"i": 1, "s": "x", "d": 2.5}
    assert metrics.with_scalars(a, b).first().asDict() == {"i": 1, "s": "x", "d": 2.5}
    plan = metrics.one_row(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_support_keeps_unseen_combinations(spark):
    df = spark.createDataFrame([("n", "t", "g1"), ("n", "t", "g1"), ("n", "t", "g2")], "a string, b string, g string")
    space = spark.createDataFrame([("n", "t"), ("n", "u")], "a string, b string")
    rows = {r["b"]: r for r in audit.support_of(space, df, ["a", "b"], "g").collect()}
    assert (rows["t"]["n_rows"], rows["t"]["n_groups"], rows["t"]["max_group_share"]) == (3, 2, pytest.approx(2 / 3))
    assert (rows["u"]["n_rows"], rows["u"]["n_groups"], rows["u"]["max_group_share"]) == (0, 0, None)


def test_fold_shift(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 3.0), (1, 4.0), (1, None)], "fold int, v double")
    rows = {r["fold"]: r for r in profile.fold_median_shift(df, "fold", 2, "v").collect()}
    assert rows[0]["train_median"] == 3.5 and rows[0]["delta_vs_global"] == 1.0 and rows[1]["train_median"] == 1.5


def test_observed_profile_ignores_filled_values(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (9.0, 1)], "v double, v_missing int")
    row = profile.observed_profile(df, "v", "v_missing", [0.5], {"high": (2.0, None)}).first()
    assert (row["n_observed"], row["v_p50"], row["share_high"]) == (2, 1.5, 0.5)


def test_leave_one_out(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "fold int, s double")
    assert {r["fold"]: r["s"] for r in metrics.leave_one_out(df, "fold", ["s"]).collect()} == {0: 6.0, 1: 5.0, 2: 3.0}


def test_clean_summary(spark):
    raw = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "b")], "y double, g string")
    row = profile.clean_summary(raw, raw.filter(F.col("y").isNotNull()), "y", "g").first()
    assert (row["n_raw"], row["n_clean"], row["n_removed"], row["median"], row["n_groups"]) == (3, 2, 1, 2.0, 2)
