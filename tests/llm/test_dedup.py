"""Exact copies, repeated passages and near copies, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foldguard.llm import components, exact_dedup, ngram_join, suffix_dedup, suffix_sort

from .conftest import EDGES


def rows(df, *names):
    return sorted(((r.asDict() if not names else tuple(r[n] for n in names)) for r in df.collect()), key=repr)


def want_exact(documents):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in documents:
        groups.setdefault(body(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for b, members in groups.items():
        best = min(members)
        first = True
        for m in sorted(members):
            out.append((m[3], best[3], len(members), first, hashlib.sha256(b.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


NAMES = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_copies_on_edge_cases(edges):
    assert rows(exact_dedup.exact_dedup(edges), *NAMES) == want_exact([e[:2] for e in EDGES])


def test_exact_copies_of_a_group_over_many_partitions(table):
    documents = [(i, "same  text" if i % 3 else f"text {i}") for i in range(600)] + [(700, "same   text ")]
    out = exact_dedup.exact_dedup(table(documents).repartition(7), partitions=9)
    assert rows(out, *NAMES) == want_exact(documents)


def test_exact_stage_keeps_one_row_of_each_text(table, no_rows):
    documents = [(1, "a b"), (2, "ab"), (3, "c"), (3, "c"), (4, "ab"), (4, "d"), (5, None)]
    kept = exact_dedup.keep_one_of_each(table(documents))
    assert sorted((r.doc_id, r.text) for r in kept.drop("x").collect() if r.text) == [(1, "a b"), (3, "c"), (4, "d")]
    assert kept.count() == 4 and kept.columns == table(documents).columns
    assert exact_dedup.keep_one_of_each(no_rows).count() == 0


def want_cut(documents, length=50):
    first, out = {}, []
    usable = [(i, (t or "").encode()) for i, t in documents]
    for i, b in usable:
        for k in range(len(b) - length + 1 if i is not None else 0):
            first[b[k : k + length]] = min(first.get(b[k : k + length], i), i)
    for i, b in usable:
        mask = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                mask[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~mask[:-1]]) if b else b""
        spans = int((mask[:-1] & ~np.concatenate([[False], mask[:-1]])[: len(b)]).sum())
        out.append((i, len(b), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_passages_on_edge_cases(edges, no_rows):
    assert rows(suffix_dedup.suffix_dedup(edges), *CUT) == want_cut([e[:2] for e in EDGES])
    assert suffix_dedup.suffix_dedup(no_rows).count() == 0


def test_passages_on_random_texts(table, monkeypatch):
    rng = random.Random(3)
    shared = ["".join(rng.choice("ab é") for _ in range(rng.randint(30, 140))) for _ in range(8)] + ["z" * 90]
    documents = [(i, "".join(rng.choice(shared) if rng.random() < 0.6 else rng.choice("xyz") * rng.randint(1, 60) for _ in range(6))) for i in range(60)]
    assert rows(suffix_dedup.suffix_dedup(table(documents)), *CUT) == want_cut(documents)
    monkeypatch.setattr(suffix_dedup, "HOT_SEGMENTS", 1)  # every shared anchor is taken apart by its suffixes
    assert rows(suffix_dedup.suffix_dedup(table(documents)), *CUT) == want_cut(documents)


def test_deep_shallow_sorting_orders_suffixes():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 400), np.tile(rng.integers(97, 100, 60), 30)]).astype(np.uint8)
    starts = np.arange(len(text) - 50)
    group = starts % 2
    order, cls = suffix_sort.sort_suffixes(text, starts, group, 50)
    key = lambda i: (group[i], text[starts[i] : starts[i] + 50].tobytes())
    assert [key(i) for i in order] == sorted(map(key, range(len(starts))))
    names = {}
    assert all(names.setdefault(key(i), c) == c for i, c in enumerate(cls)) and len(set(names.values())) == len(names)


def test_copies_of_a_passage_are_settled_without_tries(monkeypatch):
    rng = np.random.default_rng(2)
    passages = [rng.integers(97, 123, 90).astype(np.uint8) for _ in range(40)]
    text = np.concatenate([p for p in passages for _ in range(3)])
    starts = np.concatenate([np.arange(41) + 90 * k for k in range(120)])
    group = np.repeat(np.arange(40), 3 * 41)
    monkeypatch.setattr(suffix_sort, "blind_sort", lambda *_: pytest.fail("copies need no trie"))
    order, cls = suffix_sort.sort_suffixes(text, starts, group, 50)
    key = [(g, text[s : s + 50].tobytes()) for g, s in zip(group.tolist(), starts.tolist(), strict=True)]
    assert [key[i] for i in order] == sorted(key)
    assert len(set(zip(key, cls.tolist(), strict=True))) == len(set(key)) == len(set(cls.tolist())) == 40 * 41


@pytest.mark.parametrize("limit", [8, 24, 50, 61])
def test_sorting_mixes_copies_and_near_copies(limit):
    rng = np.random.default_rng(limit)
    text = rng.integers(97, 99, 90)
    copies = [np.where(rng.random(90) < p, 99, text) for p in (0, 0, 0, 0.01, 0.02, 0.02, 0.1, 0.5) for _ in range(6)]
    text = np.concatenate(copies).astype(np.uint8)
    starts = np.concatenate([np.arange(90 - limit + 1) + 90 * k for k in range(len(copies))])
    group = rng.integers(0, 3, len(starts))
    order, cls = suffix_sort.sort_suffixes(text, starts, group, limit)
    key = [(g, text[s : s + limit].tobytes()) for g, s in zip(group.tolist(), starts.tolist(), strict=True)]
    assert [key[i] for i in order] == sorted(key)
    assert len(set(zip(key, cls.tolist(), strict=True))) == len(set(key)) == len(set(cls.tolist()))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_anchors_of_several_ids_need_no_order_of_ids(size):
    rng = random.Random(size)
    big = 1 << 62
    pairs = sorted(((big + rng.randint(0, 60), rng.choice([5, 5, 5, 2, 9])) for _ in range(150)), key=lambda r: r[0])
    batches = [pa.record_batch([pa.array([r[0] for r in part]), pa.array([r[1] for r in part])], ["anchor", "doc_id"]) for part in (pairs[i : i + size] for i in range(0, 150, size))]
    empty = batches[0].slice(0, 0)
    got = [tuple(r.values()) for b in suffix_dedup._of_several(iter([empty, *batches, empty])) for r in b.to_pylist()]
    ids = {a: {d for b, d in pairs if a == b} for a, _ in pairs}
    assert set(got) == {r for r in pairs if len(ids[r[0]]) > 1} and [a for a, _ in got] == sorted(a for a, _ in got)
    assert len(got) == sum(len(ids[a]) > 1 and (k == 0 or pairs[k - 1] != (a, d)) for k, (a, d) in enumerate(pairs))


def want_components(documents, words=4, percent=85):
    sets = []
    for i, t in documents:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a][1] & sets[b][1])
            if same and 100 * same >= percent * (len(sets[a][1]) + len(sets[b][1]) - same):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)), key=repr)


NEAR = ("doc_id", "n_shingles", "component_id")
CONTRACT = ngram_join.NgramRule(words=4, percent=85)


def test_near_copies_on_edge_cases(edges, no_rows):
    known = [e[:2] for e in EDGES if e[0] is not None]
    got = ngram_join.near_duplicates(edges, CONTRACT)
    assert rows(got.filter("doc_id IS NOT NULL"), *NEAR) == want_components(known)
    assert rows(got.filter("doc_id IS NULL"), *NEAR) == [(None, 1, 5)]
    assert ngram_join.near_duplicates(no_rows).count() == 0


def test_sets_without_hashes_have_no_bucket():
    assert all(len(ngram_join.bucket_keys(np.zeros(0, np.uint64), r)) == 0 for r in (CONTRACT, ngram_join.NgramRule()))
    one, two = np.array([7], np.uint64), np.array([7, 9], np.uint64)
    assert all(len(ngram_join.bucket_keys(x, CONTRACT)) < 20 for x in (one, two))


def test_blank_texts_link_with_nothing(table):
    documents = [(1, None), (2, ""), (3, " \t\r\n"), (4, None), (2, "")]
    got = ngram_join.near_duplicates(table(documents), CONTRACT)
    assert rows(got, *NEAR) == sorted((i, 0, i) for i, _ in documents)


@pytest.mark.parametrize("rule", [CONTRACT, ngram_join.NgramRule()], ids=["contract", "default"])
def test_near_copies_in_chains_and_large_groups(table, monkeypatch, rule):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 16)  # buckets are compared in blocks
    rng = random.Random(5)
    documents, number = [], 0
    for size in (6, 8, 12, 30, 60, 150):
        for _ in range(2):
            words = [f"v{rng.randint(0, 9999)}" for _ in range(size)]
            for _ in range(25):
                documents.append((number, " ".join(words)))
                number += 1
                words = words[:]
                for _ in range(rng.randint(0, 1 + size // 40)):
                    words[rng.randrange(size)] = f"v{rng.randint(0, 9999)}"
    rng.shuffle(documents)
    assert rows(ngram_join.near_duplicates(table(documents), rule), *NEAR) == want_components(documents, rule.words, rule.percent)


@pytest.mark.parametrize("rule", [CONTRACT, ngram_join.NgramRule()], ids=["contract", "default"])
def test_tiles_miss_no_link(rule):
    rng = np.random.default_rng(2)
    for n in [*range(1, 60), 100, 333, 1000]:
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for _ in range(20):
            gone = rng.random(n) < rng.random() * 0.15
            other = np.unique(np.concatenate([base[~gone], rng.integers(0, 1 << 64, rng.integers(0, 1 + n // 8), np.uint64)]))
            same = len(np.intersect1d(base, other))
            if same and 100 * same >= rule.percent * (len(base) + len(other) - same) and len(base) + len(other) > 2 * same:
                assert np.intersect1d(ngram_join.bucket_keys(base, rule), ngram_join.bucket_keys(other, rule)).size
                apart = ngram_join.bits_apart(ngram_join.parity_bitmap(base), ngram_join.parity_bitmap(other))
                assert apart <= len(base) + len(other) - 2 * same


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_near_copy_stage_keeps_one(table):
    text = " ".join(f"w{i}" for i in range(200))
    kept = ngram_join.keep_one_of_each(table([(3, text), (1, text + " more"), (2, "other words stand here now"), (9, None), (None, text)]))
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == [1, 2, 9, None]


def test_a_closest_pair_that_does_not_link_hides_no_other(table):
    rng = random.Random(3437)  # by bitmap bits the pair that does not link (34 apart) is closer than the one that does (32)
    b = [f"v{rng.randint(0, 10**6)}" for _ in range(203)]
    a, c = [*b[:-1], "other"], b[:]
    for at in (20, 60, 100, 140):
        c[at] = f"u{rng.randint(0, 10**6)}"
    texts = [" ".join(x) for x in (a, b, c)]
    x, y, z = map(ngram_join.parity_bitmap, ngram_join.ngram_sets(texts, 4))
    assert ngram_join.bits_apart(x, z) < ngram_join.bits_apart(y, z)
    documents = list(enumerate(texts))
    assert {r[2] for r in want_components(documents)} == {0}
    assert rows(ngram_join.near_duplicates(table(documents), CONTRACT), *NEAR) == want_components(documents)


def test_stages_that_keep_one_take_columns_of_any_name(table):
    text = " ".join(f"w{i}" for i in range(100))
    docs = table([(1, text), (2, text + " more"), (3, text), (3, text), (None, "a"), (5, None)])
    names = ("kept_id", "kept_sha", "kept_body", "gone_id", "row", "body", "id", "n_shingles", "component_id")
    wide = docs.selectExpr("*", *[f"doc_id AS {n}" for n in names])
    for stage, want in ((exact_dedup.keep_one_of_each, [1, 2, 5, None]), (ngram_join.keep_one_of_each, [1, 5, None])):
        kept = stage(wide)
        assert kept.columns == wide.columns
        got = kept.collect()
        assert sorted((r.doc_id for r in got), key=repr) == want and all(r.kept_id == r.doc_id == r.row == r.gone_id for r in got)
