import numpy as np
import pytest

from foldguard.operators import neighbours


def test_small_leaves_are_packed_together():
    """Vectors in many dimensions fall into leaves of about equal size, none of whose parents fits a block: blocks are filled nonetheless."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(20_000, 24))
    tree = neighbours.grown_tree(vectors[:2000], 80, 8)
    cell, _ = neighbours.assigned(tree, vectors)
    counts = {i: int(n) for i, n in enumerate(np.bincount(cell, minlength=80))}
    for most in (500, 1000, 4000):
        region = neighbours.regions(tree, counts, most)
        rows: dict[int, int] = {}
        for leaf, r in enumerate(region):
            rows[r] = rows.get(r, 0) + counts[leaf]
        assert sum(-(-n // most) for n in rows.values()) <= 3 * 20_000 / most
        assert all(n <= most or region.count(r) == 1 for r, n in rows.items())  # only a leaf by itself is larger
        assert region == sorted(region, key=region.index)  # the leaves of a region follow each other


def nearest(vectors, k, parts=3):
    ids = np.arange(len(vectors))
    out = neighbours._Nearest(ids, vectors, k, True)
    for at in np.array_split(ids, parts):
        out.meet(at, vectors[at])
    return list(zip(*(x.tolist() for x in out.best), strict=True))


def brute(vectors, k):
    out = []
    for i, x in enumerate(vectors):
        d = np.sqrt(((x - vectors) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(vectors)), d)) if j != i][:k]
        out += [(i, j, float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-3, 1e6), (1e-7, 1.0), (1e30, 0.0), (1e-30, 0.0), (0.0, 3.0)])
def test_single_precision_loses_no_neighbour(scale, offset):
    """Distances far below what single precision tells apart at the vectors' own size, and values beyond its range."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(700, 5)) * scale + offset
    vectors[::9] = vectors[0]  # copies: distance 0, ordered by id
    assert nearest(vectors, 4) == brute(vectors, 4)


def test_close_pairs_far_from_the_rest():
    """Pairs that differ in the last digits, each pair far from all others."""
    rng = np.random.default_rng(8)
    base = np.repeat(rng.normal(size=(300, 8)) * 1e4, 2, axis=0)
    vectors = base + rng.normal(size=base.shape) * 1e-9
    got = nearest(vectors, 1, parts=2)
    assert [(q, r) for q, r, _ in got] == [(i, i ^ 1) for i in range(600)] and got == brute(vectors, 1)


def test_few_pairs_need_an_exact_distance(monkeypatch):
    """Of all pairs, only those that can be among the nearest are measured in double precision."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(4000, 32)) + 100.0
    measured = []
    plain = neighbours._Nearest._exact
    monkeypatch.setattr(neighbours._Nearest, "_exact", lambda self, q, r, rv: measured.append(len(q)) or plain(self, q, r, rv))
    nearest(vectors, 5, parts=8)
    assert sum(measured) < 4000 * 5 * 6


def test_text_keys_order_equal_distances(spark):
    names = [f"k{i % 7}-{i}" for i in range(60)]
    vectors = np.repeat(np.arange(20.0), 3)[:, None]
    df = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors, strict=True)], "id string, v array<double>")
    got = sorted((r["id"], r["place"], r["neighbour"]) for r in neighbours.knn_join(df, df, "id", "v", 3, True, 8, 9, 11).collect())
    want = []
    for i, n in enumerate(names):
        order = sorted((abs(float(vectors[i, 0] - vectors[j, 0])), m) for j, m in enumerate(names) if j != i)[:3]
        want += [(n, place, m) for place, (_, m) in enumerate(order, 1)]
    assert got == sorted(want)
