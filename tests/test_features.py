from pyspark.sql import functions as F

from foldguard.operators import features as feat

ROWS = [
    (0.8, 0.2, 1.5, "true", "100", "nip", "x", 1.0, "g1"), (1.0, 0.0, None, "TRUE", "100-150 C", "pin", "x", 2.0, "g1"),
    (0.5, 0.5, 1.6, None, "RT", "nip", "y", 3.0, "g2"), (0.0, 1.0, None, "false", None, None, "z-1", 4.0, "g2"),
    (1.0, 0.0, 1.7, "False", "80 | 120", "nip", "Unknown", 5.0, None), (1.0, 0.0, 1.6, "no", "100", "pin", None, 6.0, "g3"),
]
SCHEMA = "A_FA double, A_MA double, gap double, flex string, temp string, arch string, etl string, pce double, grp string"
SPEC = feat.FeatureSpec(
    "pce", "grp", numeric={"band_gap": "gap"}, number_text={"anneal_temp": "temp"}, flags={"flexible": "flex"},
    categories={"arch": "arch", "ETL": "etl"}, top_n=2,
)


def test_matrix(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("JV_leak", F.lit(1.0))
    m = feat.build_features(df, SPEC)
    assert "JV_leak" not in m.columns and "gap" not in m.columns
    rows = {r["pce"]: r for r in m.collect()}
    assert rows[2.0]["band_gap"] == 1.6 and rows[2.0]["band_gap_missing"] == 1 and rows[1.0]["band_gap_missing"] == 0
    assert [rows[i]["anneal_temp"] for i in (1.0, 2.0, 3.0, 5.0)] == [100, 150, 110, 120]
    assert [rows[float(i)]["flexible"] for i in range(1, 7)] == [1, 1, 0, 0, 0, 0]
    etl = [c for c in m.columns if c.startswith("ETL_")]
    assert "ETL_x" in etl and "ETL_ETL_other" in etl and len(etl) == 3
    assert all(sum(r[c] for c in etl) == 1 for r in rows.values())
    assert rows[4.0]["arch_arch_other"] == 1  # NULL is a category of its own, here a rare one
    assert rows[5.0]["grp"] is None


def test_null_and_unknown_are_two_categories(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept, more = feat.top_categories(df, ["etl"], 10)["etl"]
    assert set(kept) == {"x", "y", "z-1", "Unknown", "unknown"} and not more


def test_fold_local_uses_the_other_folds_only(spark):
    df = spark.createDataFrame(
        [(0, 1.0, "a"), (0, None, "b"), (1, 10.0, "c"), (1, 20.0, "c"), (2, 30.0, "c"), (2, None, "d")],
        "fold int, v double, c string",
    )
    out = feat.fold_local_features(df, "fold", 3, ["v"], ["c"], 1).collect()
    filled = {r["fold"]: r["v"] for r in out if r["v_missing"]}
    assert filled == {0: 20.0, 2: 10.0}
    assert {r["c"] for r in out if r["fold"] == 0} == {"c_other"}
    table = feat.fold_local_table(df, "fold", 3, ["v"], ["c"], 1)
    whole = feat.preprocessed_for_fold(df, table, 0, ["v"], ["c"]).collect()
    assert [r["v"] for r in whole if r["v_missing"]] == [20.0, 20.0]


def test_scaling_of_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = feat.standardize(df, feat.scale_parameters(df, ["a", "b"])).collect()
    assert sorted(tuple(r) for r in out) == [(-1.0, 0.0), (1.0, 0.0)]
