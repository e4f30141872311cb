import pytest
from pyspark.sql import functions as F

from foldguard.functions import columns as C
from foldguard.functions import text as X
from foldguard.functions.composition import Site, add_shares, composition_label
from foldguard.functions.hashing import md5_bucket
from foldguard.operators.features import add_descriptors

A = Site("A", "a", "wa", ("FA", "MA", "Cs", "Rb", "K"))


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_max_number(spark):
    rows = [("100",), ("100-150 C",), ("RT",), (None,), ("80 | 120",), (">100",), ("1.5; 0.25",)]
    assert values(spark, rows, "t string", X.max_number(F.col("t"))) == [100, 150, None, None, 120, 100, 1.5]


def test_numeric_or_null(spark):
    rows = [("1.5",), (" -2e3 ",), ("1.0d",), ("nan",), ("inf",), ("1_000",), ("abc",), (None,), (".5",), ("5.",)]
    assert values(spark, rows, "t string", X.numeric_or_null(F.col("t"))) == [
        1.5, -2000.0, None, None, None, None, None, None, 0.5, 5.0
    ]
    assert values(spark, [(float("nan"),), (1e10,)], "t double", X.numeric_or_null(F.col("t"))) == [None, 1e10]


def test_flag_text(spark):
    rows = [("TRUE",), ("true",), ("false",), (None,), ("yes",)]
    assert values(spark, rows, "t string", X.flag_text(F.col("t"))) == [1, 1, 0, 0, 0]


def test_normalize_key(spark):
    rows = [
        (" 10.1/AB ",), ("﻿10.1/ab",), ("https://doi.org/10.1/ab",), ("http://dx.doi.org/10.1/ab/",),
        ("doi: 10.1/ab.",), ("DOI:10.1/Ab",), (None,),
    ]
    assert values(spark, rows, "t string", X.normalize_key(F.col("t"))) == ["10.1/ab"] * 6 + [None]


def test_keywords(spark):
    rows = [("Absorber | Si | absorber",), ("none",)]
    assert values(spark, rows, "t string", X.keyword_hits(F.col("t"), ["si |", "cigs"])) == [["si |"], []]
    assert values(spark, rows, "t string", X.substring_count(F.col("t"), "absorber")) == [2, 0]


def test_null_tokens_keep_none(spark):
    rows = [("NA",), ("None",), ("none",), ("",), (" ",), ("x",)]
    assert values(spark, rows, "t string", X.null_tokens_to_null(F.col("t"))) == [None, None, "none", None, None, "x"]


def test_md5_bucket_matches_published_value(spark):
    assert values(spark, [(7,)], "k int", md5_bucket(42, F.col("k"))) == [1994382085]


def test_shares(spark):
    rows = [
        ("Cs; FA; MA", "0.05; 0.788; 0.162"), ("FA; GU", "0.5; 0.5"), ("Cs; FA", "1.0"), ("FA; MA", "1; x"),
        ("FA; MA; FA;", "1; 2; 1"), ("FA", "0"), (None, "1"), ("", "1"),
    ]
    out = add_shares(spark.createDataFrame(rows, "a string, wa string"), [A]).collect()
    assert sum(out[0][c] for c in A.share_columns) == pytest.approx(1.0)
    assert out[0]["A_FA"] == pytest.approx(0.788)
    assert (out[1]["A_FA"], out[1]["A_other"]) == (0.5, 0.5)
    assert (out[4]["A_FA"], out[4]["A_MA"], out[4]["A_other"]) == (0.5, 0.5, 0.0)
    for i in (2, 3, 5, 6, 7):
        assert all(out[i][c] is None for c in A.share_columns)


def test_lists_are_parsed_once(spark):
    df = add_shares(spark.createDataFrame([("FA", "1")], "a string, wa string"), [A]).filter("A_FA > 0.1")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(wa") == 1


def test_label(spark):
    df = spark.createDataFrame([(0.125, 0.875, 0.005, 1.0)], "A_FA double, A_MA double, A_Cs double, B_Pb double")
    label = composition_label({"A": ("FA", "MA", "Cs"), "B": ("Pb",), "X": ("I",)}, df.columns)
    assert df.select(label.alias("l")).first()["l"] == "FA0.12MA0.88 / Pb1.00 / -"


def test_descriptors(spark):
    names = ["A_FA", "A_MA", "A_Cs", "B_Pb", "X_I"]
    rows = [(0.0, 1.0, 0.0, 1.0, 1.0), (1.0, 0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 1.0, 1.0)]
    out = add_descriptors(spark.createDataFrame(rows, names)).collect()
    t = {tuple(r[n] for n in names[:3]): r for r in out}
    assert 0.90 <= t[0, 1, 0]["tolerance_factor"] <= 0.92
    assert t[1, 0, 0]["tolerance_factor"] > t[0, 0, 1]["tolerance_factor"]
    assert t[0, 0, 0]["descriptor_missing"] == 1
    assert t[0, 0, 0]["tolerance_factor"] == pytest.approx(t[0, 1, 0]["tolerance_factor"])  # the median of three


def test_safe_names():
    assert C.safe_names(["ETL_TiO2-c | x", "ok_1"]) == ["ETL_TiO2_c___x", "ok_1"]
    with pytest.raises(ValueError):
        C.safe_names(["a-b", "a b"])


def test_feature_scopes():
    columns = ["solv_x", "A_FA", "band_gap", "B_Pb"]
    families = {"shares": lambda c: c in C.family(columns), "most": lambda c: not c.startswith("solv"), "all": lambda c: True}
    assert C.feature_scopes(columns, families) == {
        "shares": ["A_FA", "B_Pb"], "most": ["A_FA", "B_Pb", "band_gap"], "all": ["A_FA", "B_Pb", "band_gap", "solv_x"],
    }
