"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import string
import zlib

import pytest

from foldguard.llm import merkle

from .test_dedup import rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The last node, and for each node its siblings as (left, right) by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            start = i - i % fanout
            paths[k].append(("".join(level[start:i]), "".join(level[i + 1 : start + fanout])))
            at[k] = i // fanout
        level = [digest("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def want(documents, fanout):
    groups = {}
    for r in documents:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    known = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        known[s] = members, *climb([leaf(r) for r in members], fanout)
    root, tops = climb([known[s][1] for s in order], fanout) if order else (None, [])
    out = []
    for s, top in zip(order, tops, strict=True):
        members, subroot, paths = known[s]
        for r, path in zip(members, paths, strict=True):
            changed = r if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5 else (*r[:4], None if r[4] is None else r[4].translate(LOWER))
            fold = leaf(changed)
            for left, right in path + top:
                fold = digest(left + fold + right)
            proof = digest("".join(a + b for a, b in path + top))
            out.append((r[0], leaf(r), subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def table_of(spark, documents, extra=False):
    made = spark.createDataFrame(documents, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    if extra:
        for name in ("leaf", "pos", "block", "c0", "up_block", "root", "changed", "one"):
            made = made.selectExpr("*", f"'x' AS {name}")
    return made


def some(n, sources, rng):
    text = lambda i: rng.choice([None, "", "plain", "Écrit En Ü", f"Text {i} " * rng.randint(1, 4)])
    return [(rng.randint(0, n), rng.choice(sources), rng.choice(["en", None]), rng.choice([None, i]), text(i)) for i in range(n)]


@pytest.mark.parametrize("fanout", [2, 16])
def test_manifest_equals_the_recursive_one(spark, fanout):
    rng = random.Random(fanout)
    documents = some(150, [None, "", "a", "B", "é", "z"], rng) + [(900 + i, "lone", "en", 1, "ONE") for i in range(1)]
    documents += documents[:3] + [(None, "a", None, None, "TEXT"), (None, None, None, None, None)]  # rows that repeat, ids that are NULL
    got = merkle.manifest_check(table_of(spark, documents, extra=True), fanout)
    assert got.columns == list(NAMES)
    assert rows(got, *NAMES) == want(documents, fanout)


def test_group_of_many_blocks_and_many_groups(spark):
    rng = random.Random(3)
    documents = some(400, ["hot"], rng) + [(i, f"s{i:03d}", "en", i, f"T{i}") for i in range(60)]
    assert rows(merkle.manifest_check(table_of(spark, documents), 3), *NAMES) == want(documents, 3)


@pytest.mark.parametrize("n", [1, 4, 16, 17, 257])
def test_sizes_around_the_ends_of_runs(spark, n):
    documents = [(i, "s", None, None, "x" * i) for i in range(n)]
    assert rows(merkle.manifest_check(table_of(spark, documents)), *NAMES) == want(documents, 16)


def test_no_rows_and_very_long_texts(spark):
    documents = [(1, "s", "en", 0, "Long TEXT " * 300_000), (5, "s", "en", 0, None)]
    assert rows(merkle.manifest_check(table_of(spark, documents)), *NAMES) == want(documents, 16)
    assert merkle.manifest_check(table_of(spark, documents).limit(0)).count() == 0
    assert merkle.build(table_of(spark, documents).limit(0).select("doc_id", "source", merkle.document_leaf().alias("leaf"))).root().count() == 0


def test_change_of_any_field_is_seen(spark):
    documents = [(i, "s" if i % 3 else "t", "en", i, f"text {i}") for i in range(40)]
    leaves = lambda d: table_of(spark, d).select("doc_id", "source", merkle.document_leaf().alias("leaf"))
    root = merkle.build(leaves(documents)).root().first().root
    for at, value in ((2, None), (3, 99), (4, "text 7 ")):
        changed = [tuple(value if (d[0] == 7 and k == at) else v for k, v in enumerate(d)) for d in documents]
        assert merkle.build(leaves(changed)).root().first().root != root
    assert merkle.build(leaves(documents[::-1])).root().first().root == root
