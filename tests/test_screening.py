import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldguard import session
from foldguard.operators import candidates as cand
from foldguard.operators import conformal, neighbours, screening, topk

# Axes (share levels and category columns) of the candidate space.
AXES: dict[str, dict[str, dict[str, float]]] = {
    "A": {
        "FA": {"A_FA": 1.0},
        "MA": {"A_MA": 1.0},
        "FA0.83_Cs0.17": {"A_FA": 0.83, "A_Cs": 0.17},
        "FA0.85_MA0.15": {"A_FA": 0.85, "A_MA": 0.15},
        "FA0.8_MA0.1_Cs0.1": {"A_FA": 0.8, "A_MA": 0.1, "A_Cs": 0.1},
        "MA0.9_Cs0.1": {"A_MA": 0.9, "A_Cs": 0.1},
        "Cs0.2_FA0.8": {"A_Cs": 0.2, "A_FA": 0.8},
    },
    "B": {"Pb": {"B_Pb": 1.0}, "Pb0.5_Sn0.5": {"B_Pb": 0.5, "B_Sn": 0.5}},
    "X": {
        "I": {"X_I": 1.0},
        "I0.83_Br0.17": {"X_I": 0.83, "X_Br": 0.17},
        "I0.6_Br0.4": {"X_I": 0.6, "X_Br": 0.4},
    },
    "arch": {"nip": {"arch_nip": 1.0}, "pin": {"arch_pin": 1.0}},
    "ETL": {
        "TiO2_c___TiO2_mp": {"ETL_TiO2_c___TiO2_mp": 1.0},
        "SnO2_np": {"ETL_SnO2_np": 1.0},
        "PCBM_60": {"ETL_PCBM_60": 1.0},
    },
    "HTL": {
        "Spiro_MeOTAD": {"HTL_Spiro_MeOTAD": 1.0},
        "PTAA": {"HTL_PTAA": 1.0},
        "PEDOT_PSS": {"HTL_PEDOT_PSS": 1.0},
    },
}
CONTEXT_HOT = {"solv_DMF__DMSO": 1.0}



@pytest.fixture(scope="module")
def preds():
    rng = np.random.default_rng(11)
    n = 803
    y = rng.normal(10, 4, n).round(3)
    p = (y + rng.normal(0, 3, n)).round(1)
    return pd.DataFrame({"id": range(n), "y": y, "p": p})


def test_enrichment(spark, preds):
    got = screening.enrichment_table(spark.createDataFrame(preds), "y", "p", ["id"], [14.0, 1000.0], ["0.05", "0.29"]).collect()
    order = preds.sort_values(["p", "id"], ascending=[False, True])
    for r in got:
        k = max(1, int(r["fraction"] * len(preds)))
        assert r["k"] == k
        base, hit = (preds.y >= r["threshold"]).mean(), (order.y.head(k) >= r["threshold"]).mean()
        assert r["base_rate"] == pytest.approx(base) and r["precision_at_k"] == pytest.approx(hit)
        assert r["lift"] == (pytest.approx(hit / base) if base else None)


def test_gains_end_at_one(spark, preds):
    got = screening.gains_curve(spark.createDataFrame(preds), "y", "p", ["id"], 12.0, 50).orderBy("point").collect()
    captured = [r["captured"] for r in got]
    assert len(got) == 50 and captured[-1] == 1.0 and captured == sorted(captured)
    order = preds.sort_values(["p", "id"], ascending=[False, True])
    assert captured[9] == pytest.approx((order.y.head(got[9]["k"]) >= 12).sum() / (preds.y >= 12).sum())


def test_top_count_is_exact():
    assert screening.top_count("0.29", 100) == 29 and screening.top_count("0.001", 10) == 1


def quantile(scores, coverage):
    k = min(math.ceil(round((len(scores) + 1) * coverage, 9)), len(scores))
    return np.sort(scores)[k - 1]


def test_conformal(spark, preds):
    cal, test = preds[preds.id % 2 == 0], preds[preds.id % 2 == 1]
    c, t = spark.createDataFrame(cal), spark.createDataFrame(test)
    for r in conformal.marginal_intervals(c, t, "y", "p", ["0.90", "0.80"]).collect():
        q = quantile((cal.y - cal.p).abs(), r["target_coverage"])
        assert r["half_width"] == pytest.approx(q)
        assert r["coverage"] == pytest.approx(((test.y - test.p).abs() <= q).mean())
    edges = np.quantile(cal.p, [0.25, 0.5, 0.75])
    bins, where = np.digitize(cal.p, edges), np.digitize(test.p, edges)
    per_bin = {r["bin"]: r for r in conformal.binned_intervals(c, t, "y", "p").collect()}
    for b in range(4):
        q = quantile((cal.y - cal.p).abs()[bins == b], 0.9)
        assert per_bin[b]["half_width"] == pytest.approx(q) and per_bin[b]["n_test"] == (where == b).sum()


def test_tiny_calibration_uses_its_largest_error(spark):
    c = spark.createDataFrame([(1.0,), (2.0,)], "e double")
    assert conformal.half_widths(c, "e", ["0.90"]).first()["half_width"] == 2.0


def brute(q, r, k, self_join):
    out = []
    for i, x in q.items():
        d = sorted((float(np.sqrt(((x - v) ** 2).sum())), j) for j, v in r.items() if not (self_join and i == j))
        out += [(i, j, round(dist, 9)) for dist, j in d[:k]]
    return sorted(out)


@pytest.mark.parametrize("self_join", [True, False])
@pytest.mark.parametrize("blocks", [(7, 11), (4096, 16384)])
def test_knn_is_exact_with_copies_and_clusters(spark, self_join, blocks):
    """A third of the vectors are one and the same; the rest lie in far-apart clusters."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 50, (4, 3))
    vectors = {i: (np.ones(3) if i % 3 == 0 else centres[i % 4] + rng.normal(0, 1, 3)) for i in range(150)}
    other = {1000 + i: centres[i % 4] + rng.normal(0, 2, 3) for i in range(40)}
    schema = "id long, v array<double>"
    refs = spark.createDataFrame([(i, list(map(float, v))) for i, v in vectors.items()], schema)
    queries = refs if self_join else spark.createDataFrame([(i, list(map(float, v))) for i, v in other.items()], schema)
    got = neighbours.knn_join(queries, refs, "id", "v", 4, self_join, 6, *blocks).collect()
    want = brute(vectors if self_join else other, vectors, 4, self_join)
    assert sorted((r["id"], r["neighbour"], round(r["distance"], 9)) for r in got) == want


def test_rows_are_packed_once_however_many_leaves_are_in_reach(spark):
    """Directions in many dimensions: nearly every leaf is in reach of every other, and yet no row is copied for them."""
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(0, 1, 24) for i in range(600)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>")
    staged = []

    def noted(rows, label="stage", settings=None):
        out = session.stage(rows, label, settings)
        staged.append((label, out))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(neighbours, "stage", noted)
        got = neighbours.knn_join(df, df, "id", "v", 3, True, 20, 64, 64).collect()
    assert sorted((r["id"], r["neighbour"], round(r["distance"], 9)) for r in got) == brute(vectors, vectors, 3, True)
    for label, out in staged:
        if "blocks" in label:
            assert out.selectExpr("sum(size(ids))").first()[0] == 600 and out.selectExpr("max(size(ids))").first()[0] <= 64
        elif label != "knn-near":
            assert out.count() <= 600


def test_far_leaves_are_not_compared(spark):
    rows = [(i, [float(i % 2) * 1e6 + i * 0.001, 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    tree = neighbours.choose_tree(df, "id", "v", 25)
    cells = neighbours._to_cells(df, "id", "v", tree)
    reach = neighbours._reach(cells, cells, tree, 3)
    assert len(tree.leaves) == 8 and max(reach.values()) < 1000


@pytest.mark.parametrize("leaves", [1, 2, 7, 40])
def test_tree_sends_each_row_to_every_leaf_it_matters_to(leaves):
    rng = np.random.default_rng(leaves)
    sample = rng.normal(0, 20, (12, 4))[rng.integers(0, 12, 400)] + rng.normal(0, 1, (400, 4))
    tree = neighbours.grown_tree(sample, leaves, branches=3)
    assert len(tree.leaves) == leaves and sorted(tree.leaf[n] for n in tree.leaves) == list(range(leaves))
    leaf_reach = {int(i): float(rng.uniform(1, 30)) for i in rng.choice(leaves, (leaves + 1) // 2, replace=False)}
    rows = rng.normal(0, 20, (100, 4))
    got = set(zip(*(x.tolist() for x in neighbours.routed(tree, neighbours.node_reach(tree, leaf_reach), rows))))
    pivots = tree.pivots[tree.leaves]
    for r in range(100):
        for leaf, reach in leaf_reach.items():
            if np.linalg.norm(rows[r] - pivots[leaf]) <= reach:
                assert (r, leaf) in got
    cell, own = neighbours.assigned(tree, rows)
    assert np.allclose(own, np.linalg.norm(rows - pivots[cell], axis=1))


def test_alike_rows_cannot_be_split():
    tree = neighbours.grown_tree(np.ones((50, 3)), 9)
    assert tree.leaves == [0] and neighbours.assigned(tree, np.zeros((2, 3)))[0].tolist() == [0, 0]


def test_comparisons_grow_in_proportion_on_clustered_vectors(spark):
    """Four times the rows, in four times the clusters: pairs that are compared grow about as much, not by sixteen."""
    rng = np.random.default_rng(5)
    pairs = {}
    for n in (1_000, 4_000):
        centres = rng.normal(0, 100, (n // 50, 6))
        vectors = centres[np.arange(n) % len(centres)] + rng.normal(0, 0.5, (n, 6))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
        tree = neighbours.choose_tree(df, "id", "v", 12)
        cells = neighbours._to_cells(df, "id", "v", tree)
        reach = neighbours.node_reach(tree, neighbours._reach(cells, cells, tree, 4))
        asked = np.bincount(neighbours.assigned(tree, vectors)[0], minlength=len(tree.leaves))
        _, leaves = neighbours.routed(tree, reach, vectors)
        pairs[n] = int((asked * np.bincount(leaves, minlength=len(tree.leaves))).sum())
    assert pairs[4_000] < 8 * pairs[1_000] and pairs[4_000] < 4_000**2 / 8


def test_default_space():
    assert cand.expected_count({a: list(v) for a, v in AXES.items()}) == 756


def test_encoded_candidates(spark):
    axes = AXES
    levels = {a: list(v) for a, v in axes.items()}
    space = cand.enumerate_space(spark, levels)
    assert cand.check_count(space, levels) == 756 and space.drop("candidate_id").distinct().count() == 756
    names = ["A_FA", "A_MA", "A_Cs", "X_I", "X_Br", "arch_nip", "arch_pin", "HTL_PTAA", "band_gap", "solv_DMF__DMSO", "unseen"]
    enc = cand.encode_space(space, axes, names, {"band_gap": 1.6} | CONTEXT_HOT)
    assert enc.columns[-len(names):] == names
    d = enc.toPandas()
    assert np.allclose(d.A_FA + d.A_MA + d.A_Cs, 1) and np.allclose(d.X_I + d.X_Br, 1)
    assert ((d.arch_nip + d.arch_pin) == 1).all() and (d.band_gap == 1.6).all() and (d.unseen == 0).all()
    assert (d[d.HTL == "PTAA"].HTL_PTAA == 1).all() and (d[d.HTL != "PTAA"].HTL_PTAA == 0).all()


def test_axes_of_any_length(spark):
    many = cand.axis_from(spark.range(100_500).select((F.col("id") * 3).alias("v")), "v")
    axes = {"v": many, "w": ["a", "b"]}
    space = cand.enumerate_space(spark, axes)
    assert space.columns == ["candidate_id", "v", "w"] and cand.check_count(space, axes) == 201_000
    assert space.select("v", "w").distinct().count() == 201_000
    assert sorted(r["w"] for r in space.filter("v = 301497").collect()) == ["a", "b"]
    none = {"v": cand.axis_from(spark.range(5).filter("id > 9"), "id"), "w": ["a", "b"]}
    assert cand.check_count(cand.enumerate_space(spark, none), none) == 0


def test_cells_as_rows(spark):
    space = cand.enumerate_space(spark, {"k": ["x", "y"], "m": ["p", "q"]})
    rows = spark.createDataFrame([("x", "f", 0.5), ("y", "other", 1.0)], "level string, feature string, value double")
    got = cand.encode_space(space, {"k": rows, "m": {"q": {"f": 0.25}}}, ["f"], {}).collect()
    assert {(r["k"], r["m"]): r["f"] for r in got} == {("x", "p"): 0.5, ("x", "q"): 0.25, ("y", "p"): 0.0, ("y", "q"): 0.25}


def test_support_and_sensitivity(spark):
    c = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "k string, score double")
    s = cand.with_support(c, spark.createDataFrame([("a", 1), ("b", 7)], "k string, n_rows long"), ["k"])
    assert {r["k"]: r["n_rows"] for r in s.collect()} == {"a": 1, "b": 7, "c": 0}
    counts = {r["threshold"]: r["n_supported"] for r in cand.support_counts(s, "n_rows", [1, 5, 10]).collect()}
    assert counts == {1: 2, 5: 1, 10: 0}
    sens = {r["threshold"]: r for r in topk.threshold_sensitivity(s, "n_rows", [1, 5], 5, "score", ["k"], 2).collect()}
    assert sens[1]["ceiling"] == 3.0 and sens[1]["overlap_base"] == 1 and sens[5]["top_median"] == 2.0


def test_examples_and_diverse(spark):
    df = spark.createDataFrame([(i, float(i), i % 3) for i in range(9)], "id int, e double, k int")
    kinds = {}
    for r in topk.stratified_examples(df, "e", ["id"], 2).collect():
        kinds.setdefault(r["kind"], []).append(r["id"])
    assert kinds == {"close": [0, 1], "typical": [4, 3], "far": [8, 7]}
    assert [r["id"] for r in topk.diverse_top(df, ["k"], "e", ["id"], 2).collect()] == [8, 7]
    stable = topk.rank_stability(df.withColumn("e2", -F.col("e")), "e", "e2", ["id"], ["k"], 3).first()
    assert stable["rho"] == pytest.approx(-1) and stable["overlap_top"] == 0
