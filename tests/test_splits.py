import heapq

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldguard.operators import splits as sp


def grouped(spark, n=2000, groups=60):
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % groups).cast("string"))
    return spark.range(n).select("id", g.alias("g"))


@pytest.mark.parametrize("make", [
    lambda df: df.withColumn("split", sp.hash_holdout(F.col("g"), "0.2")),
    lambda df: sp.exact_holdout(df, "g", "0.2"),
    lambda df: sp.balanced_group_folds(df, "g", 5, out="split", hot_rows=100),
    lambda df: sp.dealt_group_folds(df, "g", 5, out="split", fineness=2, hot_rows=100),
])
def test_groups_stay_on_one_side(spark, make):
    df = grouped(spark)
    out = make(df)
    assert out.count() == df.count()
    sp.assert_group_disjoint(out, "g", "split")


def test_exact_holdout_counts_groups(spark):
    df = grouped(spark)
    n = df.select("g").distinct().count()
    test = sp.exact_holdout(df, "g", "0.2").filter("split = 'test'").select("g").distinct().count()
    assert test == -(-n * 2 // 10)


def test_hot_group_is_alone_in_the_largest_fold(spark):
    out = sp.balanced_group_folds(grouped(spark), "g", 3, hot_rows=100)
    sizes = {r["fold"]: r["n"] for r in out.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) - min(sizes.values()) <= 40


def test_broken_split_is_found(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, split int")
    with pytest.raises(ValueError):
        sp.assert_group_disjoint(df, "g", "split")


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=12), st.integers(2, 6))
def test_quota_equals_one_by_one_greedy(classes, folds):
    loads = [(0, f) for f in range(folds)]
    heapq.heapify(loads)
    expected = {}
    for size in sorted(classes, reverse=True):
        expected[size] = [0] * folds
        for _ in range(classes[size]):
            load, f = heapq.heappop(loads)
            expected[size][f] += 1
            heapq.heappush(loads, (load + size, f))
    assert dict(sp.greedy_quota(classes.items(), folds)) == expected


def test_sample_is_exact_and_stable(spark):
    df = spark.range(500)
    a, b = (sorted(r["id"] for r in sp.exact_sample(df.repartition(n), "id", 60).collect()) for n in (3, 7))
    assert a == b and len(a) == 60


def test_report(spark):
    df = spark.createDataFrame([("a", "train"), ("unknown", "test"), ("unknown", "test")], "g string, split string")
    rows = {r["split"]: r for r in sp.split_report(df, "g", "split").collect()}
    assert rows["test"]["n_sentinel"] == 2 and rows["train"]["row_share"] == pytest.approx(1 / 3)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(0, 200))
def test_rooms_end_at_one_level(loads, rows):
    rooms = sp.filled_up(loads, rows)
    tops = [load + room for load, room in zip(loads, rooms) if room > 0]
    assert sum(rooms) == pytest.approx(rows) and all(r >= 0 for r in rooms)
    assert not tops or max(tops) - min(tops) < 1e-6 and all(load >= max(tops) - 1e-6 for load, r in zip(loads, rooms) if r == 0)


@pytest.mark.parametrize(("fineness", "hot"), [(1, 0), (10, 0), (10, 900), (1000, 300)])
def test_dealt_folds_are_even_and_repeatable(spark, fineness, hot):
    sizes = [(i, 1 + i * i % 23) for i in range(200)] + [(None, 17)] + ([(999, hot)] if hot else [])
    df = spark.createDataFrame([(k,) for k, n in sizes for _ in range(n)], "k bigint").repartition(7)
    table = {r.k: (r.group_rows, r.fold) for r in sp.dealt_fold_table(df, "k", 4, fineness=fineness).collect()}
    assert {k: n for k, (n, _) in table.items()} == dict(sizes)
    total = sum(n for _, n in sizes)
    loads = [sum(n for n, f in table.values() if f == g) for g in range(4)]
    small = max((n for n, _ in table.values() if n <= total // (4 * fineness)), default=0)
    level = (total - hot) / 3 if hot > total / 4 else total / 4
    even = [load for load in loads if not (hot and load == max(loads) and hot > level)]
    assert max(abs(load - level) for load in even) <= max(small, max(n for k, n in sizes if k != 999) if fineness == 1000 else small) + 1e-6
    assert {r.k: (r.group_rows, r.fold) for r in sp.dealt_fold_table(df.repartition(3), "k", 4, fineness=fineness).collect()} == table
    assert sp.dealt_fold_table(df.limit(0), "k", 4).count() == 0
