import pytest

from foldguard.functions.composition import Site
from foldguard.operators import cleaning, contracts

SITES = [Site(p, f"{p}_ions", f"{p}_coef", k) for p, k in (("A", ("FA", "MA")), ("B", ("Pb",)), ("X", ("I", "Br")))]
RULES = cleaning.CleaningRules("pce", 0.0, 35.0, "module", SITES)
SCHEMA = "id int, pce string, module string, A_ions string, A_coef string, B_ions string, B_coef string, X_ions string, X_coef string"
GOOD = ("Pb", "1", "I; Br", "0.8; 0.2")


def rows(spark, items):
    return spark.createDataFrame(items, SCHEMA)


def test_every_reason_once(spark):
    df = rows(spark, [
        (0, "14.7", "false", "FA; MA", "0.8; 0.2", *GOOD),
        (1, "not-a-number", "false", "FA", "1", *GOOD),
        (2, "99", "false", "FA", "1", *GOOD),
        (3, "-1", "false", "FA", "1", *GOOD),
        (4, "10", "TRUE", "FA", "1", *GOOD),
        (5, "10", None, None, "1", *GOOD),
        (6, "10", "false", "FA; MA", "1", *GOOD),
        (7, "10", "false", "FA", "x", *GOOD),
        (8, "10", "false", "FA", "0", *GOOD),
        (9, "10", "false", "FA", "0", "Pb", None, "I", "1"),  # a missing list is reported before a zero total
    ])
    clean, rejected = cleaning.clean_rows(df, RULES, ["id"])
    assert [r["id"] for r in clean.collect()] == [0]
    assert {r["id"]: r["reason"] for r in rejected.collect()} == {
        1: "pce_not_numeric", 2: "pce_out_of_range", 3: "pce_out_of_range", 4: "module_record",
        5: "missing_ion_or_coef", 6: "ion_coef_count_mismatch", 7: "coef_not_numeric",
        8: "coef_total_not_positive", 9: "missing_ion_or_coef",
    }
    assert cleaning.reason_counts(rejected).first()["n"] == 2


def test_bounds_are_inclusive(spark):
    df = rows(spark, [(i, v, "false", "FA", "1", *GOOD) for i, v in enumerate(["0", "35.0", "35.0001"])])
    clean, _ = cleaning.clean_rows(df, RULES, ["id"])
    assert sorted(r["pce"] for r in clean.collect()) == [0.0, 35.0]


def test_clean_contract(spark):
    ok = spark.createDataFrame([(1.0, "g")], "pce double, grp string")
    assert contracts.check_clean(ok, "pce", "grp", 0, 35)["warnings"] == []
    assert contracts.check_clean(ok, "pce", "nope", 0, 35)["warnings"]
    for bad in ([("x",)], [("99",)]):
        with pytest.raises(contracts.ContractError):
            contracts.check_clean(spark.createDataFrame(bad, "pce string"), "pce", "grp", 0, 35)
    with pytest.raises(contracts.ContractError):
        contracts.check_clean(ok.filter("pce > 5"), "pce", "grp", 0, 35)
    with pytest.raises(contracts.ContractError):
        contracts.check_clean(ok, "absent", "grp", 0, 35)


def test_feature_contract(spark):
    sites = {"A": ("FA", "MA"), "B": ("Pb",)}
    df = spark.createDataFrame(
        [(0.8, 0.2, 1.0, 10.0, "g", None), (0.8, 0.4, 1.0, 10.0, "g", None), (0.0, 0.0, 0.0, 1.0, "h", None)],
        "A_FA double, A_MA double, B_Pb double, JV_default_PCE double, grp string, empty double",
    )
    report = contracts.check_features(df, "JV_default_PCE", "grp", sites)
    assert len(report["warnings"]) == 2 and "empty" in report["warnings"][1]
    with pytest.raises(contracts.ContractError):
        contracts.check_features(df.withColumnRenamed("empty", "JV_default_Voc"), "JV_default_PCE", "grp", sites)
