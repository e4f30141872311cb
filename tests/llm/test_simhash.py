"""SimHash near copies against a comparison of all fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from foldguard.llm import queries, simhash

from .conftest import EDGES
from .test_dedup import rows

NAMES = ("doc_id", "fingerprint", "component_id")


def want_fingerprint(text, words=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def want_components(prints, distance=3):
    """prints: (id, fingerprint)"""
    distinct = np.array(sorted({f for _, f in prints}), np.uint64)
    root = list(range(len(distinct)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(distinct)):
        for j in np.flatnonzero(np.bitwise_count(distinct[:i] ^ distinct[i]) <= distance):
            root[find(i)] = find(int(j))
    place = {int(f): k for k, f in enumerate(distinct)}
    least = {}
    for i, f in prints:
        k = find(place[f])
        least[k] = min((x for x in (least.get(k), i) if x is not None), default=None)
    return sorted(((i, f"{f:016x}", least[find(place[f])]) for i, f in prints), key=repr)


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    texts = ["", "A", "a b", "a b c", "É ÀB c d", "x\x1cy z w", "r\x0bs\tt\r\nu v", "a " * 70_000] + [" ".join(rng.choice("aBcdE") for _ in range(n)) for n in range(1, 60)]
    for t in texts:
        assert simhash.simhash(simhash.shingle_hashes(t.encode())) == want_fingerprint(t)


def near(prints, rng, n, flips):
    out = []
    for _ in range(n):
        f = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, flips)):
            f ^= 1 << b
        out.append(f)
    return out


@pytest.mark.parametrize("radii", [(0, 0, 0, 0), (1, 0, 0, -1), (2, -1, 0, -1), (-1, 1, -1, 1), (1, 1), (2, 0), (0, 2), (1, 0, 0), (0, -1, 2)])
def test_every_plan_finds_every_pair(radii):
    rng = random.Random(str(radii))
    base = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    other = np.array([int(f) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for f in base], np.uint64)
    order = rng.sample(range(64), 64)
    cuts = [len(order) * i // len(radii) for i in range(len(radii) + 1)]
    plan = simhash.ProbePlan(tuple(tuple(order[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)), radii)
    assert sum(r + 1 for r in radii) == 4
    (x, met), (y, _) = simhash.filed(plan, base), simhash.filed(plan, other)
    for a, b in zip(x, y, strict=True):
        assert np.intersect1d(a[met], b).size or np.intersect1d(a, b[met]).size


def test_units_go_where_they_cost_least():
    rng = random.Random(4)
    for _ in range(50):
        costs = [[0.0, *sorted(rng.random() for _ in range(4))] for _ in range(4)]
        got = simhash.allocated(costs, 4)
        all_ways = [(a, b, c, 4 - a - b - c) for a in range(5) for b in range(5 - a) for c in range(5 - a - b)]
        price = lambda u: sum(row[k] for row, k in zip(costs, u, strict=True))
        assert sum(got) == 4 and price(got) == pytest.approx(min(map(price, all_ways)))


def test_correlated_bits_stand_together():
    rng = np.random.default_rng(2)
    bits = rng.random((2_000, 64)) < 0.5
    bits[:, [3, 20, 41, 60]] = bits[:, [3]] ^ (rng.random((2_000, 4)) < 0.02)
    x = bits.astype(float)
    groups = simhash.grouped_bits(x.T @ x, len(x), 4)
    assert sorted(b for g in groups for b in g) == list(range(64)) and {len(g) for g in groups} == {16}
    assert any({3, 20, 41, 60} <= set(g) for g in groups)


def test_links_of_fingerprints_in_clusters_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 40)  # large buckets are compared in pairs of blocks
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(4):
        prints += near(prints[-60:], rng, 60, 3)  # chains
    prints += near([prints[0]], rng, 500, 4)  # one dense cluster
    prints += [0, 1, 7, 15, (1 << 64) - 1, (1 << 64) - 2]
    prints = sorted(set(prints))
    classes = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in prints], "fp bigint").repartition(5)
    for plan in (simhash.probe_plan(classes), simhash.probe_plan(classes, counts=(2,)), simhash.probe_plan(classes, counts=(3,))):
        assert sum(r + 1 for r in plan.radii) == 4
        links = simhash.fingerprint_links(classes, plan).collect()
        u = lambda x: x & ((1 << 64) - 1)
        assert all((u(a) ^ u(b)).bit_count() <= 3 and a != b for a, b in links)
        root = {f: f for f in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(u(a))] = find(u(b))
        groups = {}
        for f in prints:
            groups.setdefault(find(f), set()).add(f)
        expected = {}
        for f, (_, _, c) in zip(prints, sorted(want_components(list(enumerate(prints))), key=lambda r: r[0]), strict=True):
            expected.setdefault(c, set()).add(f)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in expected.values()}


def test_near_copies_on_edge_cases(edges, no_rows):
    want = want_components([(i, want_fingerprint(t)) for i, t, *_ in EDGES])
    assert rows(simhash.near_copies(edges), *NAMES) == want
    assert simhash.near_copies(no_rows).count() == 0


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert rows(queries.op11_simhash(spark, sf), *NAMES) == want_components([(i, want_fingerprint(t)) for i, t in texts])
