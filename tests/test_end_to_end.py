"""From a raw CSV to a scored model and a run record, on a few rows with known faults."""

import random

from pyspark.sql import functions as F

from foldguard.functions.composition import Site, add_shares
from foldguard.operators import cleaning, contracts, features, learning, metrics, splits
from foldguard.sources import readers, writers

SITES = [
    Site("A", "a_names", "a_weights", ("FA", "MA", "Cs")), Site("B", "b_names", "b_weights", ("Pb", "Sn")),
    Site("X", "x_names", "x_weights", ("I", "Br", "Cl")),
]
RULES = cleaning.CleaningRules("outcome", 0.0, 35.0, "module", SITES)
SPEC = features.FeatureSpec(
    "outcome", "source", numeric={"band_gap": "gap"}, number_text={"anneal_temp": "temperature", "anneal_time": "time"},
    flags={"flexible": "flexible"}, categories={"arch": "arch", "ETL": "etl", "solv": "solvent"}, top_n=3, descriptors=True,
)
HEADER = [
    "source", "a_names", "a_weights", "b_names", "b_weights", "x_names", "x_weights", "gap", "arch", "etl", "flexible",
    "module", "solvent", "temperature", "time", "JV_default_Voc", "outcome",
]


def raw_lines():
    rng = random.Random(7)
    rows = []
    for g in range(4):
        for i in range(8):
            share = round(rng.uniform(0.5, 0.95), 2)
            rows.append([
                f"10.1000/smoke.{g}", "FA; MA", f"{share}; {round(1 - share, 2)}", "Pb", "1", "I; Br", "0.83; 0.17",
                rng.choice(["1.55", "1.6", ""]), rng.choice(["nip", "pin"]), rng.choice(["TiO2-c", "SnO2-np", "NA"]), "false",
                "false", "DMF; DMSO", rng.choice(["100", "100-150", "RT"]), "20", "1.1", f"{10 + 8 * share:.2f}",
            ])
    rows.append(rows[0][:-1] + ["not-a-number"])
    rows.append(rows[1][:-1] + ["99.0"])
    return rows


def test_raw_to_model(spark, tmp_path):
    path = tmp_path / "raw.csv"
    text = "\n".join(",".join(r) for r in [HEADER, *raw_lines()])
    path.write_text("﻿" + text + "\n", encoding="utf-8")

    raw, absent = readers.read_raw_csv(spark, str(path), [*HEADER, "area"])
    assert absent == ["area"] and raw.count() == 34
    valid, rejected = cleaning.clean_rows(readers.with_null_tokens(raw), RULES, ["source"], keep_parsed=True, staged=True)
    assert valid.count() == 32
    assert {r["reason"] for r in rejected.collect()} == {"pce_not_numeric", "pce_out_of_range"}
    contracts.check_clean(valid, "outcome", "source", 0, 35)

    matrix = features.build_features(add_shares(valid, SITES), SPEC)
    sites = {s.prefix: s.known for s in SITES}
    assert contracts.check_features(matrix, "outcome", "source", sites)["warnings"] == []
    assert "JV_default_Voc" not in matrix.columns and "tolerance_factor" in matrix.columns

    split = splits.exact_holdout(matrix, "source", "0.25")
    splits.assert_group_disjoint(split, "source", "split")
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 24, "test": 8}

    names = [c for c in matrix.columns if c not in ("outcome", "source")]
    model = learning.model_registry(names, "outcome", 24)["ridge"].fit(split.filter("split = 'train'"))
    scored = model.transform(split)
    score = metrics.regression_metrics(scored.filter("split = 'test'"), "outcome", learning.PREDICTION).first()
    assert score["n"] == 8 and score["r2"] > 0.5

    record = str(tmp_path / "runs")
    writers.append_run_record(spark, record, "smoke", 42, {"top_n": 3}, {"r2": score["r2"]}, {"matrix": matrix})
    assert spark.read.parquet(record).count() == 1
    assert scored.filter(F.col(learning.PREDICTION).isNull()).count() == 0
