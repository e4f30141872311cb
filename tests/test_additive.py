import itertools
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from foldguard.operators import additive, candidates


@pytest.fixture(scope="module")
def space(spark):
    axes = {"a": ["a1", "a2", "a3"], "b": ["b1", "b2"], "c": [10, 20, 30, 40]}
    cells = {
        "a": [("a1", "fa", 1.0), ("a2", "fa", 0.5), ("a2", "fb", 2.0), ("a3", "unknown", 9.0)],
        "b": [("b1", "fc", 1.0), ("b2", "fc", -1.0)],
        "c": [(str(v), "fd", float(v)) for v in axes["c"]],
    }
    weights = {"fa": 2.0, "fb": 0.25, "fc": 1.5, "fd": -0.1, "ctx": 3.0}
    tables = {k: spark.createDataFrame(v, "level string, feature string, value double") for k, v in cells.items()}
    return axes, cells, tables, weights


def score_of(cells, weights, levels, context):
    return 0.5 + sum(weights.get(f, 0) * v for f, v in context.items()) + sum(
        weights.get(f, 0) * v for axis, level in levels.items() for lv, f, v in cells[axis] if lv == str(level)
    )


def test_space_is_scored_without_encoding(spark, space):
    axes, cells, tables, weights = space
    base = additive.base_score(0.5, weights, {"ctx": 2.0})
    got = additive.score_space(spark, axes, additive.part_tables(tables, weights), base).collect()
    assert len(got) == 24
    for r in got:
        assert r.score == pytest.approx(score_of(cells, weights, {k: r[k] for k in axes}, {"ctx": 2.0}))
    encoded = candidates.encode_space(candidates.enumerate_space(spark, axes), tables, list(weights), {"ctx": 2.0}).collect()
    whole = {tuple(r[k] for k in axes): 0.5 + sum(w * r[f] for f, w in weights.items()) for r in encoded}
    assert {tuple(r[k] for k in axes): pytest.approx(r.score) for r in got} == whole


def test_feature_of_two_axes_is_an_error(spark, space):
    _, _, tables, weights = space
    twice = {**tables, "b": tables["b"].unionByName(spark.createDataFrame([("b1", "fa", 1.0)], "level string, feature string, value double"))}
    with pytest.raises(ValueError, match="fa is set"):
        additive.part_tables(twice, weights)


def ranked(axes, names):
    rows = []
    for combo in itertools.product(*axes):
        key = tuple(v for part, own in combo for v in own)
        rows.append((-sum(part for part, _ in combo), key))
    return [(key, float(-s)) for s, key in sorted(rows)]


def test_best_first_equals_enumeration(spark):
    import random

    rng = random.Random(6)
    for _ in range(4):
        tables, lists = [], []
        for i, n in enumerate((5, 1, 7, 4)):
            rows = [(f"v{j}", Decimal(rng.randint(0, 4))) for j in range(n)]  # many ties
            tables.append(spark.createDataFrame(rows, f"n{i} string, part decimal(28,9)"))
            lists.append([(p, (v,)) for v, p in rows])
        names = [f"n{i}" for i in range(4)]
        for k in (1, 9, 500):
            got = additive.best_candidates(tables, Decimal(0), k).collect()
            assert [(tuple(r[n] for n in names), r.score) for r in got] == ranked(lists, names)[:k]
            assert [r.place for r in got] == list(range(1, len(got) + 1))


def test_best_of_each_distinct_set(spark):
    pairs = [("x", 1, 3), ("x", 2, 3), ("y", 1, 5), ("y", 3, 4), ("z", 9, 0)]
    one = spark.createDataFrame([(a, b, Decimal(p)) for a, b, p in pairs], "a string, b int, part decimal(28,9)")
    two = spark.createDataFrame([("p", Decimal(1)), ("q", Decimal(2))], "c string, part decimal(28,9)")
    got = [(r.a, r.b, r.c, r.score) for r in additive.best_candidates([one, two], Decimal(10), 2, distinct=["a"]).collect()]
    assert got == [("y", 1, "q", 17.0), ("x", 1, "q", 15.0)]
    both = [(r.a, r.c) for r in additive.best_candidates([one, two], Decimal(0), 10, distinct=["a", "c"]).collect()]
    assert both == [("y", "q"), ("y", "p"), ("x", "q"), ("x", "p"), ("z", "q"), ("z", "p")]
    assert additive.best_candidates([one, two.limit(0)], Decimal(0), 3).count() == 0


def test_a_space_of_a_million_millions(spark):
    axes = [spark.range(10_000).select(F.col("id").alias(f"n{i}"), (F.pmod(F.col("id") * (2 * i + 7919), F.lit(10_007))).cast(additive.PART).alias("part")) for i in range(3)]
    got = additive.best_candidates(axes, Decimal(0), 5).collect()
    best = [sorted(((v * (2 * i + 7919) % 10_007, -v) for v in range(10_000)), reverse=True)[:5] for i in range(3)]
    want = sorted(((-sum(p for p, _ in c), tuple(-v for _, v in c)) for c in itertools.product(*best)))[:5]
    assert [(-r.score, (r.n0, r.n1, r.n2)) for r in got] == want
