import random

import pytest
from pyspark.sql import functions as F

from foldguard.functions.text import normalize_key
from foldguard.operators import key_groups, table_diff
from foldguard.operators.splits import assert_group_disjoint


def test_three_changes_in_a_large_table_are_found(spark):
    a = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 1000).alias("v"), F.when(F.col("id") % 9 > 0, F.col("id").cast("string")).alias("t")).repartition(5)
    b = a.filter("k != 1234").withColumn("v", F.when(F.col("k") == 777, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([(500_000, 1, None)], "k bigint, v bigint, t string"))
    rows, read = table_diff.located_difference(a, b.select("t", "k", "v"), ["k"])
    assert sorted((r.k, r.kind, r.n_a, r.n_b) for r in rows.collect()) == [(777, "changed", 1, 1), (1234, "removed", 1, 0), (500_000, "added", 0, 1)]
    r = read.first()
    assert r.n_total == 400_000 and 0 < r.n_read < 0.001 * r.n_total


def test_equal_and_empty_versions(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, "")], "k int, t string")
    rows, read = table_diff.located_difference(a, a.repartition(3), ["k"])
    assert rows.count() == 0 and read.first().n_read == 0
    rows, _ = table_diff.located_difference(a, a.limit(0), ["k"])
    assert sorted(((r.k, r.kind, r.n_a) for r in rows.collect()), key=repr) == [(1, "removed", 2), (2, "removed", 1), (None, "removed", 1)]
    assert table_diff.located_difference(a.limit(0), a.limit(0), ["k"])[0].count() == 0
    fewer = spark.createDataFrame([(1, "x"), (None, "n"), (2, None)], "k int, t string")
    rows, _ = table_diff.located_difference(a, fewer, ["k"])
    assert sorted(((r.k, r.kind, r.n_a, r.n_b) for r in rows.collect()), key=repr) == [(1, "changed", 2, 1), (2, "changed", 1, 1), (None, "changed", 1, 1)]
    with pytest.raises(ValueError):
        table_diff.located_difference(a, a.withColumn("more", F.lit(1)), ["k"])


def test_tree_levels_add_up(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    tree = table_diff.fingerprint_tree(df, ["k"]).collect()
    for level in range(5):
        here = [r for r in tree if r.level == level]
        assert sum(r.n for r in here) == 1000 and len({sum(r.h1 for r in here), next(r.h1 for r in tree if r.level == 0)}) == 1
        assert max(r.place for r in here) < 16**level


def want_groups(rows):
    root = {k: k for k, *_ in rows if k is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in (1, 2):
        seen = {}
        for row in rows:
            if row[0] is not None and row[i] is not None:
                a, b = find(row[0]), find(seen.setdefault(row[i], row[0]))
                root[max(a, b)] = min(a, b)
    return {k: find(k) for k in root}


def test_keys_are_tied_through_others(spark):
    rng = random.Random(3)
    rows = [(f"k{i:03d}", f"a{rng.randint(0, 90)}", f"b{rng.randint(0, 90)}" if rng.random() < 0.6 else None) for i in range(120)]
    rows += [(f"p{i:03d}", f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(60)]  # a path of 60 keys
    rows += [(None, "a1", "b1"), rows[0]]
    df = spark.createDataFrame(rows, "key string, a string, b string")
    got = {r.key: (r.key_group, r.n_keys) for r in key_groups.key_groups(df, "key", {"a": F.col("a"), "b": F.col("b")}).collect()}
    want = want_groups(rows)
    sizes = {g: sum(x == g for x in want.values()) for g in want.values()}
    assert got == {k: (g, sizes[g]) for k, g in want.items()}
    assert key_groups.key_groups(df.limit(0), "key", {"a": F.col("a")}).count() == 0


def test_folds_are_safe_under_every_normalisation(spark):
    keys = ["10.1/a", "10.1/A", "https://doi.org/10.1/a", " 10.1/a ", "10.1-a", "10.1/b", None]
    df = spark.createDataFrame([(keys[i % 7], i) for i in range(70)], "key string, i int")
    ties = {"norm": normalize_key(F.col("key")), "letters": F.regexp_replace(F.lower("key"), "[^a-z0-9]", "")}
    out = key_groups.safe_folds(df, "key", ties, 3, hot_rows=5)
    assert out.count() == 70 and out.filter("key IS NULL").select("fold").distinct().count() == 1
    for tie in ties.values():
        assert_group_disjoint(out.filter("key IS NOT NULL").withColumn("n", tie), "n", "fold")
    # The dash has no common normal form with the address, but with the plain key it has.
    assert len({r.key_group for r in out.filter(F.col("key").isin("10.1/a", "10.1-a", "10.1/A")).collect()}) == 1
