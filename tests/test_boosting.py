import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from foldguard.operators import boosting
from foldguard.operators.boosting import BoostSettings
from foldguard.operators.metrics import regression_metrics


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(
        "id", F.floor(F.rand(1) * 9).alias("a"), F.floor(F.rand(2) * 40).alias("b"), F.rand(3).alias("c"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("int").alias("fold")
    )
    df = df.withColumn("y", F.col("a") * F.col("b") + 20 * F.col("c") + F.rand(4))
    df = df.withColumn("b", F.when(F.col("id") % 11 != 0, F.col("b"))).cache()
    df.count()
    return df


NAMES = ["a", "b", "c"]


def test_first_tree_is_the_best_greedy_one(spark, rows):
    """With whole-number features of few values Spark's tree has the same edges to choose from."""
    known = rows.filter("b IS NOT NULL").select("id", "a", F.floor(F.col("b") / 2).alias("b"), "y", F.lit(1).alias("fold"))
    one = BoostSettings(rounds=1, step=1.0, leaves=0, depth=4, min_rows=5)
    got = boosting.boosted_rows(known.withColumn("fold", F.lit(0)), ["a", "b"], "y", one, "fold", [0], bins=32)
    assert got.filter("prediction != 0").count() == 0  # all rows are held out: nothing is known
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol="v").transform(known)
    tree = DecisionTreeRegressor(featuresCol="v", labelCol="y", maxDepth=4, maxBins=64, minInstancesPerNode=5).fit(vectors)
    want = {r.id: r.prediction for r in tree.transform(vectors).collect()}
    test = known.withColumns({"fold": F.lit(0), "y": F.lit(0.0)})
    both = known.withColumn("fold", F.lit(1)).unionByName(test)
    edges = {"a": [float(i) for i in range(1, 9)], "b": [float(i) for i in range(1, 20)]}
    cells = boosting.cell_table(both, edges, "y", "fold")
    table = boosting.fold_predictions(cells, ["a", "b"], {"one": one}, [0])
    answers = {(r.bin_a, r.bin_b): r.prediction for r in table.collect()}
    for r in known.collect():
        assert answers[r.a + 1, r.b + 1] == pytest.approx(want[r.id])


def test_edges_are_values_at_even_places(rows):
    got = boosting.bin_edges(rows, NAMES, 7)
    for c in NAMES:
        values = sorted(r[0] for r in rows.filter(F.col(c).isNotNull()).select(F.col(c).cast("double")).collect())
        assert got[c] == sorted({values[(len(values) - 1) * i // 7] for i in range(1, 7)})
    none = boosting.bin_edges(rows.limit(0), ["a"])
    assert none == {"a": []}


def brute(x, y, setting, rounds):
    """Best-first boosting over single rows."""
    value = np.full(len(y), y.mean())
    for _ in range(rounds):
        r = y - value
        leaves = [(np.arange(len(y)), 0)]

        def best(at, depth):
            found = (1e-12 * np.abs(r).sum(), None)
            if setting.depth and depth >= setting.depth:
                return found
            for f in range(x.shape[1]):
                for e in np.unique(x[at, f])[:-1]:
                    left = x[at, f] <= e
                    sides = [at[left], at[~left]]
                    if min(map(len, sides)) < setting.min_rows:
                        continue
                    gain = sum(r[s].sum() ** 2 / (len(s) + setting.l2) for s in sides) - r[at].sum() ** 2 / (len(at) + setting.l2)
                    if gain > found[0] + 1e-9:
                        found = (gain, sides)
            return found

        while not setting.leaves or len(leaves) < setting.leaves:
            options = [best(at, depth) for at, depth in leaves]
            k = max(range(len(leaves)), key=lambda i: options[i][0] if options[i][1] is not None else -1)
            if options[k][1] is None:
                break
            _, depth = leaves.pop(k)
            leaves += [(s, depth + 1) for s in options[k][1]]
        step = np.zeros(len(y))
        for at, _ in leaves:
            step[at] = r[at].sum() / (len(at) + setting.l2)
        value = value + setting.step * step
    return value


@pytest.mark.parametrize("setting", [BoostSettings(leaves=5, min_rows=3, l2=1.0), BoostSettings(leaves=0, depth=3, min_rows=1), BoostSettings(leaves=6, depth=2)])
def test_cells_learn_what_single_rows_teach(setting):
    rng = np.random.default_rng(3)
    x = np.stack([rng.integers(0, 6, 300), rng.integers(0, 4, 300)], axis=1)
    y = x[:, 0] * 3.0 + (x[:, 1] == 2) * 7 + rng.normal(size=300)
    cells, at = np.unique(x, axis=0, return_inverse=True)
    n, s = np.bincount(at), np.bincount(at, y)
    two, four = boosting.boosted_cells(cells.T, n.astype(float), s, setting, [2, 4])
    assert np.allclose(two[at], brute(x, y, setting, 2)) and np.allclose(four[at], brute(x, y, setting, 4))


def test_a_longer_fit_begins_with_the_shorter_one(rows):
    edges = boosting.bin_edges(rows, NAMES)
    cells = boosting.cell_table(rows, edges, "y", "fold")
    both = {"short": BoostSettings(rounds=5), "long": BoostSettings(rounds=9)}
    together = boosting.fold_predictions(cells, NAMES, both, range(4))
    for name, setting in both.items():
        alone = boosting.fold_predictions(cells, NAMES, {name: setting}, range(4))
        a, b = ({tuple(r[c] for c in ("held", "bin_a", "bin_b", "bin_c")): r.prediction for r in t.filter(F.col("name") == name).collect()} for t in (together, alone))
        assert a == b


def test_scores_from_cells_are_those_of_rows(rows):
    setting = BoostSettings(rounds=20)
    scored = boosting.CellBoosting(tuple(NAMES), "y", setting).held_out(rows, "fold", range(4))
    assert scored.count() == 3000 and scored.columns == [*rows.columns, "prediction"]
    want = {r.fold: r for r in regression_metrics(scored, "y", "prediction", ["fold"]).collect()}
    cells = boosting.cell_table(rows, boosting.bin_edges(rows, NAMES), "y", "fold")
    for r in boosting.fold_errors(cells, boosting.fold_predictions(cells, NAMES, {"m": setting}, range(4)), NAMES).collect():
        assert (r.n, r.rmse, r.r2) == (want[r.fold].n, pytest.approx(want[r.fold].rmse), pytest.approx(want[r.fold].r2))
        assert r.r2 > 0.9


def test_held_out_targets_change_no_prediction(rows):
    spoiled = rows.withColumn("y", F.when(F.col("fold") == 2, -1e6).otherwise(F.col("y")))
    model = boosting.CellBoosting(tuple(NAMES), "y", BoostSettings(rounds=4))
    a, b = ({r.id: r.prediction for r in model.held_out(d, "fold", [2]).collect()} for d in (rows, spoiled))
    assert a == pytest.approx(b, rel=1e-9) and len(a) == rows.filter("fold = 2").count()  # the total less the fold rounds


def test_grid_tells_the_better_setting(rows):
    settings = {"poor": BoostSettings(rounds=1), "rich": BoostSettings(rounds=30), "same": BoostSettings(rounds=30)}
    table, best = boosting.boosted_grid(rows, NAMES, "y", settings, "fold", 4, "fold", 4)
    got = {r.name: r for r in table.collect()}
    assert best["name"] == "rich" and got["rich"].cv_r2_mean == got["same"].cv_r2_mean > got["poor"].cv_r2_mean
    assert best["r2_mean"] == pytest.approx(got["rich"].cv_r2_mean)


def test_many_cells_go_to_the_rows(rows, monkeypatch):
    monkeypatch.setattr(boosting, "MOST_CELLS", 10)
    model = boosting.CellBoosting(("a", "c"), "y", BoostSettings(rounds=3, leaves=8))
    out = model.held_out(rows.filter("id < 400"), "fold", [0, 1])
    assert out.count() == rows.filter("id < 400 AND fold < 2").count() and out.filter("prediction IS NULL").count() == 0
