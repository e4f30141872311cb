import pytest
from pyspark.sql import functions as F

from foldguard.operators import features, learning
from foldguard.operators.splits import assert_group_disjoint, hash_fold, hash_holdout


@pytest.fixture(scope="module")
def rows(spark):
    g = F.pmod(F.xxhash64("id"), F.lit(40))
    df = spark.range(1200).withColumns({"x1": F.rand(1), "x2": F.rand(2), "noise": F.rand(3), "g": g})
    df = df.withColumn("y", 3 * F.col("x1") + F.when(F.col("x2") > 0.5, 2.0).otherwise(0.0) + 0.1 * F.col("noise"))
    df = df.withColumns({"fold": hash_fold(F.col("g"), 3), "split": hash_holdout(F.col("g"), "0.25")}).cache()
    df.count()
    return df


def test_registry_learns_and_best_is_reported(rows):
    models = learning.model_registry(["x1", "x2", "noise"], "y", 1200, trees=4, rounds=3)
    table, best = learning.compare_models(rows, models, "y", "fold", 3, "split")
    scores = {r["model"]: r for r in table.collect()}
    assert set(scores) == {"ridge", "forest", "boosting"}
    assert scores["ridge"]["r2_mean"] > 0.7 and scores["forest"]["holdout_r2"] > 0.6
    assert best == max(scores, key=lambda m: scores[m]["r2_mean"])


def test_out_of_fold_covers_every_row_once(rows):
    assert_group_disjoint(rows, "g", "fold")
    out = learning.out_of_fold(rows, learning.least_squares(["x1"], "y"), "fold", 3)
    assert out.count() == 1200 and out.select("id").distinct().count() == 1200


def test_ridge_penalty_is_the_usual_one(spark, rows):
    """With alpha = 1 on summed squares the centred one-column slope is Sxy / (Sxx + 1)."""
    small = rows.filter("id < 30")
    model = learning.model_registry(["x1"], "y", 30)["ridge"].fit(small)
    pdf = small.select("x1", "y").toPandas()
    z = (pdf.x1 - pdf.x1.mean()) / pdf.x1.std()
    want = (z * (pdf.y - pdf.y.mean())).sum() / ((z**2).sum() + 1)
    assert model.stages[-1].coefficients[0] == pytest.approx(want, rel=0.05)


def test_grid_search(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    def tree(maxDepth):
        vector = VectorAssembler(inputCols=["x1", "x2"], outputCol="_vector")
        return Pipeline(stages=[vector, DecisionTreeRegressor(featuresCol="_vector", labelCol="y", maxDepth=maxDepth, seed=1)])

    table, best = learning.grid_search(rows, tree, {"maxDepth": [1, 5]}, "y", "fold", 3, "fold", 3)
    assert table.count() == 2 and best["maxDepth"] == 5 and best["r2_mean"] > 0.8
    pipe = tree(1)
    cv = learning.cross_validator(pipe, pipe.getStages()[1], {"maxDepth": [1, 5]}, "y", "fold", 3)
    assert cv.fit(rows).bestModel.stages[-1].getOrDefault("maxDepth") == 5


def test_permutation_finds_the_useless_column(rows):
    model = learning.least_squares(["x1", "noise"], "y").fit(rows)
    out = {r["feature"]: r["mse_increase"] for r in learning.permutation_importance(rows, model, ["x1", "noise"], "y", "id").collect()}
    assert out["x1"] > 0.5 and abs(out["noise"]) < 0.05


def test_attribution_orders_features(rows):
    out = learning.linear_attribution(rows, {"x1": 3.0, "noise": 0.1}).collect()
    assert [r["feature"] for r in out] == ["x1", "noise"]


def test_leak_shows_up_in_the_scopes(rows):
    df = rows.withColumn("leak", F.col("y") * 2)
    scopes = {"safe": ["x1"], "leaking": ["x1", "leak"]}
    got = {r["scope"]: r["r2_mean"] for r in learning.score_scopes(df, scopes, lambda f: learning.least_squares(f, "y"), "y", "fold", 3).collect()}
    assert got["leaking"] > 0.999 > got["safe"]


def test_save_and_load(rows, tmp_path):
    model = learning.least_squares(["x1", "x2"], "y").fit(rows)
    learning.save_model(model, str(tmp_path / "m"))
    again = learning.load_model(str(tmp_path / "m")).transform(rows).agg(F.sum("prediction")).first()[0]
    assert again == pytest.approx(model.transform(rows).agg(F.sum("prediction")).first()[0])


def test_fold_local_model(rows):
    holes = rows.withColumn("x1", F.when(F.col("id") % 4 != 0, F.col("x1")))
    table = features.fold_local_table(holes, "fold", 3, ["x1"], [], 0)
    out = learning.out_of_fold(
        holes, learning.least_squares(["x1", "x2"], "y"), "fold", 3,
        lambda df, f: features.preprocessed_for_fold(df, table, f, ["x1"]),
    )
    assert out.filter("prediction is null").count() == 0 and out.count() == 1200


def test_a_forest_keeps_little_of_the_rows_however_many_trees(spark, monkeypatch):
    """No fit holds more than a group of trees; together they are all trees, each of its own draw, and predict their mean."""
    fitted = []
    plain = learning.RandomForestRegressor._fit

    def noted(self, dataset):
        fitted.append((self.getNumTrees(), self.getSeed(), self.getCacheNodeIds()))
        return plain(self, dataset)

    monkeypatch.setattr(learning.RandomForestRegressor, "_fit", noted)
    monkeypatch.setattr(learning, "KEPT_DRAWS", 400 * 13)
    rows = spark.range(400).selectExpr("id", "id % 17 AS x1", "id % 5 AS x2", "CAST((id % 17) * 3 + (id % 5) AS DOUBLE) AS y")
    model = learning.model_registry(["x1", "x2"], "y", 400, trees=25)["forest"].fit(rows)
    assert sorted(n for n, _, _ in fitted) == [12, 13] and len({s for _, s, _ in fitted}) == 2 and not any(c for _, _, c in fitted)
    got = model.transform(rows)
    assert got.columns == [*rows.columns, "_vector", "prediction"]
    trees = [t for g in model.stages[-1].groups for t in g.trees]
    assert len(trees) == 25
    for r in got.orderBy("id").limit(40).collect():
        assert abs(r["prediction"] - sum(t.predict(r["_vector"]) for t in trees) / 25) < 1e-9


def test_tree_queries_run_the_whole_job(spark, monkeypatch):
    from foldguard.plans import learning as plans

    seen = {}

    def compared(df, models, target, fold, folds, split):
        seen["compare"] = (models["forest"].getStages()[-1].getNumTrees(), models["boosting"].settings.rounds, folds)
        return df.limit(1).withColumn("model", F.lit("ridge")), "ridge"

    def searched(df, features, target, settings, search_fold, search_folds, score_fold, score_folds):
        seen["grid"] = (len(settings), len(set(settings.values())), sorted({s.rounds for s in settings.values()}), search_folds, score_folds)
        assert sorted(r[0] for r in df.select(score_fold).distinct().collect()) == list(range(score_folds))
        return df.limit(1).withColumn("name", F.lit("a")), {"name": "a", "r2_mean": 0.0, "r2_std": 0.0}

    monkeypatch.setattr(plans.learning, "compare_models", compared)
    monkeypatch.setattr(plans.boosting, "boosted_grid", searched)
    plans.ml_compare(spark, "/root/testdata/sf0.001")
    plans.ml_grid(spark, "/root/testdata/sf0.001")
    assert seen == {"compare": (300, 500, 5), "grid": (16, 16, [200, 400], 3, 5)}
