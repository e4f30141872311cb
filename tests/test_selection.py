import numpy as np
import pytest
from pyspark.sql import functions as F

from foldguard.operators import ranking, selection


def test_keys_keep_the_order_of_doubles():
    values = np.array([-np.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 1e-310, 0.1, 2.5, 1e300, np.inf])
    keys = selection._ordered(values)
    assert (np.diff(keys) >= 0).all() and keys[4] == keys[5] and len(set(keys.tolist())) == len(values) - 1
    assert np.array_equal(selection._doubles(keys), values)


def test_quantiles_of_thousands_of_groups(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.when(F.col("id") % 17 > 0, F.col("id") % 2500)).cast("int").alias("g"), (F.col("id") % 4).cast("string").alias("h"),
        F.when(F.col("id") % 11 > 0, F.round(F.randn(3) * F.pow(10.0, F.rand(4) * 6), 1)).alias("v"),
    ).cache()
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.h): r for r in selection.grouped_quantiles(df, "v", probs, ["g", "h"]).collect()}
    want = {(r.g, r.h): r for r in ranking.exact_quantiles(df, ["v"], probs, ["g", "h"]).collect()}
    assert len(got) > 2000 and set(got) == {k for k, r in want.items() if r.v_p50 is not None}
    for k, r in got.items():
        assert [r[f"v_p{p}"] for p in ("0", "10", "50", "95", "100")] == pytest.approx([want[k][f"v_p{p}"] for p in ("0", "10", "50", "95", "100")])
    assert sum(r.n_values for r in got.values()) == df.filter("v IS NOT NULL").count()


def test_whole_table_and_edges(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (-0.0,), (float("inf"),), (None,), (5e-324,)], "v double")
    row = selection.selected(df, "v", [F.lit(0), F.col("total") - 1, F.lit(2), F.lit(99)]).first()
    assert (row.total, row.s0, row.s1, row.s2, row.s3) == (5, 0.0, float("inf"), 1.0, None)
    assert selection.grouped_quantiles(df.limit(0).withColumn("g", F.lit("a")), "v", [0.5], ["g"]).count() == 0


def test_no_pass_shuffles_rows(spark):
    df = spark.range(2000).select((F.col("id") % 5).alias("g"), (F.col("id") * 1.0).alias("v"))
    plan = selection.grouped_quantiles(df, "v", [0.5], ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan
