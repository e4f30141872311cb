"""The prefix trie against a dictionary of beginnings."""

import hashlib
import random
import zlib

import pytest

from foldguard.llm import prefix_trie, queries

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows(df):
    assert set(NAMES) <= set(df.columns)
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def in_order(table):
    convs = {}
    for c, turn, role, text in table:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256((f"{len(role.encode())}:{role}{text}").encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, text[:32], digest, text))
    return {c: [(t[2], t[5]) for t in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def want(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    saved, leaves = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table_of(spark, table):
    made = spark.createDataFrame(table, "conv_id bigint, turn bigint, role string, text string")
    return made.selectExpr("*", *[f"'x' AS {n}" for n in ("place", "digest", "one", "k", "prev", "least", "head", "n")])


def some(n, rng, longest=14):
    """Conversations that share beginnings of all lengths, end at and inside blocks, and copy each other."""
    texts = ["hello", "", None, "Ünï", "a longer text here"]
    table, made = [], []
    for c in rng.sample(range(-20, 4 * n), n):
        turns = list(rng.choice(made)[: rng.randint(0, longest)]) if made and rng.random() < 0.8 else []
        if rng.random() < 0.7:
            turns += [(rng.choice(["user", "assistant", None]), rng.choice(texts)) for _ in range(rng.randint(0 if turns else 1, 6))]
        if not turns:
            turns = [("user", "x")]
        made.append(turns)
        first_null = rng.random() < 0.2
        table += [(c, None if first_null and i == 0 else i, r, t) for i, (r, t) in enumerate(turns)]
    rng.shuffle(table)
    return table


@pytest.mark.parametrize("width", [1, 3, 4])
def test_trie_of_random_conversations(spark, width):
    table = some(120, random.Random(width))
    got = prefix_trie.conversation_trie(table_of(spark, table), width)
    assert rows(got) == want(in_order(table))
    assert got.select("node").distinct().count() == got.count()


def test_rebuilt_conversations(spark):
    table = some(100, random.Random(9)) + [(None, 1, "user", "lost")]
    turns = prefix_trie.with_shared_heads(prefix_trie.turn_table(table_of(spark, table)))
    convs = rebuilt(in_order(table))
    assert any(not t for t in convs.values())
    assert rows(prefix_trie.prefix_trie(turns)) == want(convs)


def test_one_conversation_copied_many_times_and_one_very_long(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 7)
    table = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(9)]
    table += [(100, t, "user", f"turn {t}") for t in range(3_000)] + [(101, t, "user", "w " * 300_000 if t == 9 else f"turn {t}") for t in range(12)]
    assert rows(prefix_trie.conversation_trie(table_of(spark, table))) == want(in_order(table))


def test_ties_repeated_rows_and_edges(spark):
    table = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "z"), (1, 0, "user", "a"), (2, None, None, None), (2, 5, "user", "a"), (3, 5, "", ""), (None, None, None, None)]
    assert rows(prefix_trie.conversation_trie(table_of(spark, table))) == want(in_order(table))
    assert rows(prefix_trie.conversation_trie(table_of(spark, table[:1]))) == want(in_order(table[:1]))
    assert prefix_trie.conversation_trie(table_of(spark, table).limit(0)).count() == 0
    no_ids = prefix_trie.turn_table(table_of(spark, table[-1:]))
    assert prefix_trie.prefix_trie(prefix_trie.with_shared_heads(no_ids)).count() == 0


def test_all_rebuilt_to_nothing(spark):
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    table = [(alone, 0, "user", "gone")]
    turns = prefix_trie.with_shared_heads(prefix_trie.turn_table(table_of(spark, table)))
    assert rows(prefix_trie.prefix_trie(turns)) == want({alone: []})


def test_query_reads_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries.op13_prefix_trie(spark, sf)) == want(rebuilt(in_order(table)))
