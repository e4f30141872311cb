import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldguard.operators import audit, joins, ranking


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows in one group, a third of the values equal, some NULL."""
    rng = np.random.default_rng(3)
    n = 6000
    group = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    value = np.where(rng.random(n) < 0.34, 1.0, np.round(rng.normal(0, 50, n), 1))
    return pd.DataFrame({"id": range(n), "g": group.astype("int64"), "v": np.where(rng.random(n) < 0.05, np.nan, value)})


@pytest.fixture(scope="module")
def frame(spark, skewed):
    return spark.createDataFrame(skewed).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))


def test_global_rank(frame, skewed):
    got = {r["id"]: r["rank"] for r in ranking.global_rank(frame.filter("v is not null"), [F.desc("v"), "id"]).collect()}
    want = skewed.dropna().sort_values(["v", "id"], ascending=[False, True])["id"]
    assert got == {i: r for r, i in enumerate(want, 1)}


def test_positions_of_a_group_cut_over_partitions(frame, skewed):
    ones = frame.filter("v is not null").withColumn("w", F.lit(2).cast("bigint"))
    got = ranking.group_positions(ones, ["g"], ["v", "id"], "w").toPandas().set_index("id").sort_index()
    s = skewed.dropna().sort_values(["g", "v", "id"])
    before = (s.groupby("g").cumcount() * 2).set_axis(s["id"]).sort_index()
    total = (s.groupby("g")["v"].transform("size") * 2).set_axis(s["id"]).sort_index()
    assert (got["before"] == before).all() and (got["total"] == total).all()
    cut = ones.repartitionByRange("g", "v", "id").select("g", F.spark_partition_id().alias("p")).distinct()
    assert cut.groupBy("g").count().filter("count > 1 and g = 0").count() == 1  # the hot group was really cut


def test_exact_quantiles_per_group(frame, skewed):
    got = ranking.exact_quantiles(frame, ["v", "id"], [0.25, 0.5, 0.95], ["g"]).toPandas().set_index("g").sort_index()
    for c in ("v", "id"):
        for q in (0.25, 0.5, 0.95):
            want = skewed.groupby("g")[c].quantile(q)
            assert np.allclose(got[f"{c}_p{q * 100:g}"], want.sort_index())


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(spark.createDataFrame([(None,)], "v double"), ["v"], [0.5]).first()["v_p50"] is None


def test_order_statistic(frame, skewed):
    got = ranking.order_statistic(frame, "v", F.lit(100)).first()
    values = np.sort(skewed["v"].dropna())
    assert got["v"] == values[99] and got["n"] == len(values)


def test_spearman(spark, frame, skewed):
    both = frame.withColumn("u", F.col("v") * F.col("v") + F.col("g"))
    want = skewed.dropna().assign(u=lambda d: d.v * d.v + d.g)
    want = want["v"].rank().corr(want["u"].rank())
    assert audit.spearman(both, "v", "u").first()["rho"] == pytest.approx(want)
    assert audit.spearman(both, "v", "u", hot_rows=50).first()["rho"] == pytest.approx(want)


def test_signed_rank(spark):
    d = [1.5, -0.5, 0.0, 2.5, -1.5, 3.0, 0.5, 4.0]
    row = audit.signed_rank(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    s = pd.Series([x for x in d if x])
    r = s.abs().rank()
    assert row["n_used"] == 7
    assert row["w_plus"] == r[s > 0].sum() and row["w_minus"] == r[s < 0].sum()
    p = audit.signed_rank_p(spark.createDataFrame([(row["z"],)], "z double"))
    assert 0 < p < 1


@pytest.mark.parametrize("hot_rows", [50, 10**9])
def test_lookup_keeps_every_row(spark, frame, skewed, hot_rows):
    table = frame.groupBy("g").agg(F.avg("v").alias("m"), F.count("*").alias("size"))
    keyed = frame.withColumn("g", F.when(F.col("id") % 10 != 0, F.col("g")))
    out = joins.lookup_by_key(keyed, table, ["g"], "size", hot_rows).toPandas()
    assert sorted(out["id"]) == list(range(len(skewed)))
    means = skewed.groupby("g")["v"].mean()
    hit = out.dropna(subset=["g"])
    assert np.allclose(hit["m"], hit["g"].map(means)) and out[out["g"].isna()]["m"].isna().all()


def test_residuals(frame, skewed):
    out = audit.group_residuals(frame, ["g"], "v", hot_rows=100).toPandas().set_index("id").sort_index()
    want = skewed["v"] - skewed.groupby("g")["v"].transform("mean")
    assert np.allclose(out["residual"].astype(float), want, equal_nan=True)


def test_signed_rank_distribution_equals_enumeration():
    table = {(n, w): p for n, w, p in audit.signed_rank_distribution(50)}
    for n in range(1, 13):
        sums = [min(s, n * (n + 1) // 2 - s) for signs in itertools.product((0, 1), repeat=n) for s in [sum(r for r, up in zip(range(1, n + 1), signs) if up)]]
        for w in range(n * (n + 1) // 4 + 1):
            assert table[n, w] == pytest.approx(min(1.0, sum(s <= w for s in sums) / len(sums)))
    # Published two-sided critical values of the test (0.05).
    for n, critical in ((10, 8), (15, 25), (20, 52), (25, 89), (50, 434)):
        assert table[n, critical] <= 0.05 < table[n, critical + 1]


def test_signed_rank_of_groups(spark):
    rows = [("few", float(x)) for x in (1, -2, 3, 4, 5, 6)] + [("ties", x) for x in (1.0, -1.0, 2.0)] + [("zero", x) for x in (0.0, 1.0, 2.0)]
    rows += [("many", float(x) * (-1) ** (x % 3 == 0)) for x in range(1, 60)] + [(None, 1.0), (None, None), ("none", 0.0)]
    got = {r.g: r for r in audit.signed_rank_by(spark.createDataFrame(rows, "g string, d double"), "d", ["g"]).collect()}
    assert set(got) == {"few", "ties", "zero", "many", None}
    assert got["few"].p_exact == pytest.approx(0.09375) and got["few"].w == 2
    assert got["ties"].p_exact is None and got["zero"].p_exact is None and got["zero"].n_zero == 1 and got[None].p_exact == 1.0
    plain = audit.signed_rank(spark.createDataFrame([r for r in rows if r[0] == "many"], "g string, d double"), "d")
    assert got["many"].p_exact is None and got["many"].z == pytest.approx(plain.first().z)
    p = spark.createDataFrame([(got["many"].z,)], "z double").select(audit.normal_p(F.col("z"))).first()[0]
    assert p == pytest.approx(audit.signed_rank_p(plain), abs=3e-7)
