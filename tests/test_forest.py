import numpy as np
import pytest
from pyspark.sql import functions as F

from foldguard.operators import forest, learning, metrics
from foldguard.operators.forest import Growth


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(4000).withColumns({"x1": F.floor(F.rand(1) * 50), "x2": F.rand(2), "x3": (F.col("id") % 3).cast("double")})
    df = df.withColumn("y", 1000 + F.col("x1") + F.when(F.col("x2") > 0.5, 20.0).otherwise(0.0) + F.randn(4)).repartition(4).cache()
    df.count()
    return df


def fitted(df, trees=40, features=("x1", "x2", "x3"), **kw):
    return learning.model_registry(list(features), "y", 1, trees=trees, **kw)["forest"].fit(df)


def test_many_rows_grow_on_cells_and_answer_like_sparks_forest(rows, monkeypatch):
    """From CELL_ROWS rows on Spark's forest, which reads all rows at every level of every tree, is not needed: all trees are there and err as its do."""
    train, test = rows.filter("id % 4 != 0"), rows.filter("id % 4 = 0")
    spark_model = fitted(train)
    monkeypatch.setattr(learning, "CELL_ROWS", 1000)
    monkeypatch.setattr(learning.RandomForestRegressor, "_fit", lambda *a: pytest.fail("grown on the rows"))
    model = fitted(train)
    trees = model.stages[-1].trees
    assert len(trees) == 40 and len({str(t) for t in trees}) == 40 and max(len(t) for t in trees) <= 2**6
    scored = model.transform(test)
    assert scored.columns == [*test.columns, "_vector", "prediction"]
    ours, theirs = (metrics.regression_metrics(m.transform(test), "y", "prediction").first() for m in (model, spark_model))
    assert ours["n"] == theirs["n"] and ours["rmse"] == pytest.approx(theirs["rmse"], rel=0.15) and ours["r2"] > 0.8
    grid = model.stages[-1].grid
    assert [len(e) for e in grid.edges] == [31, 31, 2]  # three values are cut between each two
    for r in scored.limit(30).collect():
        at = np.unravel_index(grid.codes(np.array([[r.x1, r.x2, r.x3]])), grid.shape)
        leaves = [v for t in trees for box, v in t if all(a <= c[0] < b for (a, b), c in zip(box, at, strict=True))]
        assert len(leaves) == 40 and r.prediction == pytest.approx(np.mean(leaves) + grid.mean)


def test_parts_and_groups_of_trees_do_not_change_the_forest(rows, monkeypatch):
    monkeypatch.setattr(learning, "CELL_ROWS", 1000)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 300)
    whole = fitted(rows, 12).stages[-1].answers()
    monkeypatch.setattr(forest, "PART_ROWS", 900)
    assert np.allclose(fitted(rows, 12).stages[-1].answers(), whole)
    assert not np.allclose(fitted(rows, 12, seed=7).stages[-1].answers(), whole)


def test_a_bootstrap_draws_every_row_about_once():
    y = np.arange(500.0)
    starts = np.array([0, 1, 200])
    n, s = (np.array(v) for v in zip(*[forest.drawn(np.random.default_rng(i), starts, y) for i in range(4000)], strict=True))
    sizes = np.diff([*starts, len(y)])
    assert np.allclose(n.mean(0), sizes, rtol=0.06) and np.allclose(n.var(0), sizes, rtol=0.12)  # Poisson: both are the rows
    assert np.allclose(s.mean(0)[1:], [y[1:200].sum(), y[200:].sum()], rtol=0.02)
    single = n[:, 0]
    assert [(single == k).mean() for k in range(3)] == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2], abs=0.03)


def test_a_tree_takes_the_best_split_of_all():
    rng = np.random.default_rng(3)
    n = rng.integers(0, 5, (4, 3)).astype(float)
    s = rng.normal(size=(4, 3)) * n
    first = forest.grown(n, s, rng, 2, Growth(1))
    scores = {}
    for axis in (0, 1):
        for place in range(1, n.shape[axis]):
            parts = [(np.split(n, [place], axis)[i].sum(), np.split(s, [place], axis)[i].sum()) for i in (0, 1)]
            if all(p[0] for p in parts):
                scores[axis, place] = sum(p[1] ** 2 / p[0] for p in parts)
    axis, place = max(scores, key=scores.get)
    assert first[0][0][axis] == (0, place) and first[1][0][axis] == (place, n.shape[axis])
    assert [v for _, v in first] == pytest.approx([x.sum() / m.sum() for x, m in zip(np.split(s, [place], axis), np.split(n, [place], axis), strict=True)])
    deep = forest.grown(n, s, rng, 2, Growth(6, least_rows=4))
    assert sum(np.prod([b - a for a, b in box]) for box, _ in deep) == n.size  # the leaves cover the grid once
    assert all(n[tuple(slice(*side) for side in box)].sum() >= 4 for box, _ in deep)


def test_what_cells_cannot_hold_goes_to_sparks_forest(rows, monkeypatch):
    monkeypatch.setattr(learning, "CELL_ROWS", 1000)
    with pytest.raises(Exception, match="(?i)label"):
        fitted(rows.withColumn("y", F.when(F.col("id") != 7, F.col("y"))), 2)
    monkeypatch.setattr(learning, "MOST_CELLS", 1000)
    assert len(fitted(rows, 2).stages[-1].trees) == 2 and not isinstance(fitted(rows, 2).stages[-1], forest.CellForest)
