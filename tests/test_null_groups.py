"""NULL keys are one group everywhere, also where a group is cut over partitions."""

import pytest
from pyspark.sql import functions as F

from foldguard.operators import conformal, metrics, ranking, splits
from foldguard.sources import readers, writers


@pytest.fixture
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_medians_of_a_null_group_over_many_partitions(no_aqe):
    rows = no_aqe.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 10).alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r[1] for r in ranking.exact_quantiles(rows, ["v"], [0.5], ["g"]).collect()}
    assert got[None] == 10_000.0 and got[0] == 9_995.0


def test_balanced_folds_give_null_groups_a_fold(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 4 != 0, F.col("id") % 50).alias("g"))
    folded = splits.balanced_group_folds(rows, "g", 5, hot_rows=100)
    assert folded.count() == 1000 and folded.filter("fold IS NULL").isEmpty()
    assert folded.filter("g IS NULL").select("fold").distinct().count() == 1


def test_training_mean_keeps_rows_without_a_fold(spark):
    rows = spark.createDataFrame([(1.0, 0), (3.0, 1), (5.0, None), (7.0, None)], "y double, fold int")
    got = {(r.y, r.fold): r.baseline for r in metrics.with_training_mean(rows, "y", "fold").collect()}
    assert got == {(1.0, 0): 5.0, (3.0, 1): 13 / 3, (5.0, None): 2.0, (7.0, None): 2.0}


def test_binned_intervals_keep_every_test_row(spark):
    calibration = spark.createDataFrame([(float(i % 3), 1.0) for i in range(40)], "y double, p double")
    test = spark.createDataFrame([(float(i), float(i % 4)) for i in range(30)] + [(1.0, None)], "y double, p double")
    out = conformal.binned_intervals(calibration, test, "y", "p")
    assert out.agg(F.sum("n_test")).first()[0] == 31


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    rows = [("1", 'x "y" z'), ("2", "two\nlines"), ("3", "a, b"), ("4", None)]
    writers.write_table(spark.createDataFrame(rows, "k string, t string"), f"{tmp_path}/t", "csv")
    back, missing = readers.read_raw_csv(spark, f"{tmp_path}/t", line_breaks=True)
    assert sorted(map(tuple, back.collect())) == rows and missing == []
