"""Trie of the beginnings that conversations share, by digests of blocks of several turns.

1. A turn is the sha256 of its role and text. Every ``block_turns`` turns of a conversation are a block, and a block's node is the
   hash of the node before it and its turns, so equal nodes mean equal beginnings. One pass over sorted turns
   writes a row per block, not per turn, and holds one block at a time.
2. Conversations are grouped by the node before a block and what stands in it. Where all that go on from a node go on with the same
   block, the nodes inside it are one chain and belong to that group as it is. Only where siblings
   diverge the different contents (not the conversations) are taken apart into their beginnings and grouped turn by turn.
3. What a subtree holds is found without walking it. A node is owned by its smallest member; on the way of a conversation the
   nodes that it owns are the last ones. So bytes of all nodes below a node are sums, over its members, of
   what each owns, but for the node's own smallest member, whose way counts from the node on. The same goes for leaves.

All groupings are sums, minima and counts, which Spark combines before the shuffle, so a beginning that a third of all conversations
share is a few rows for each task. Members that end at a node are hashed in order: ranges of them become chunks of text first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_by_key
from ..operators.ranking import group_positions
from ..session import stage
from .base import reachable, shuffle_parts

BLOCK_TURNS = 4
CHUNK_IDS = 4096
SPREAD_ROWS = 512  # contents that follow one node, for each shuffle key that they are spread over
_DIGEST = 32
ROOT = hashlib.sha256(b"").digest()

_BLOCKS = "conv_id bigint, k int, prev binary, turns binary, sizes array<bigint>, before bigint, ends boolean"


def turn_table(rows: DataFrame) -> DataFrame:
    """``conv_id, place, digest, n_bytes``: the turns of each conversation, numbered from 0.

    Turns are ordered by ``turn`` (NULL first), ties by role, the first 32 characters of the text, and the digest. Rows that repeat
    are turns of their own. A NULL role or text is empty. Rows with a NULL ``conv_id`` belong to no conversation and are left out.
    """
    reachable(rows)
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(32)).alias("head"),
        digest.alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(1).cast("bigint").alias("one"),
    )
    placed = group_positions(turns, ["conv_id"], [F.col(c).asc() for c in ("turn", "role", "head", "digest")], "one", "place")
    return stage(placed.select("conv_id", "place", "digest", "n_bytes"), "trie-turns")


def with_shared_heads(turns: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """Conversations rebuilt: ``c`` begins with the first ``h`` turns of ``c - c % family`` and goes on with its own after its first ``h``.

    ``h`` is the crc32 of the decimal id modulo ``longest + 1``. Where that conversation is absent nothing is borrowed. Every id stays, if
    need be without turns (``place`` -1 and a NULL digest stand for it). Remainders have the sign of the id.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest + 1)
    ids = turns.select("conv_id").distinct()
    own = turns.filter(F.col("place") >= h)
    lent = turns.filter(F.col("place") < longest).filter(F.col("conv_id") % family == 0).withColumnRenamed("conv_id", "lender")
    borrowed = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("lender"), h.alias("h")).join(lent, "lender").filter("place < h")
    columns = ["conv_id", "place", "digest", "n_bytes"]
    return own.select(columns).union(borrowed.select(columns)).union(_markers(ids))


def _markers(ids: DataFrame) -> DataFrame:
    return ids.select("conv_id", F.lit(-1).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("bigint").alias("n_bytes"))


def _cut(width: int):
    """From turns sorted by conversation and place, a row per block; the last one of each conversation ``ends``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("conv_id", pa.int64()), ("k", pa.int32()), ("prev", pa.binary()), ("turns", pa.binary()), ("sizes", pa.list_(pa.int64())), ("before", pa.int64()), ("ends", pa.bool_())]
        )
        done: list[tuple] = []
        conv, k, prev, turns, sizes, before = None, 0, ROOT, [], [], 0

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(schema)], schema=schema)
            done.clear()
            return batch

        for batch in batches:
            for c, digest, n in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("n_bytes").to_pylist(), strict=True):
                if c != conv:
                    if conv is not None:
                        done.append((conv, k, prev, b"".join(turns), sizes, before, True))
                    conv, k, prev, turns, sizes, before = c, 0, ROOT, [], [], 0
                if digest is None:
                    continue
                if len(turns) == width:
                    whole = b"".join(turns)
                    done.append((conv, k, prev, whole, sizes, before, False))
                    k, prev, before = k + 1, hashlib.sha256(prev + whole).digest(), before + sum(sizes)
                    turns, sizes = [], []
                turns.append(digest)
                sizes.append(n)
            if len(done) > 10_000:
                yield out()
        if conv is not None:
            done.append((conv, k, prev, b"".join(turns), sizes, before, True))
        yield out()

    return cut


def _node(prev: str, turns: Column | str) -> Column:
    turns = F.col(turns) if isinstance(turns, str) else turns
    return F.when(F.length(turns) == 0, F.col(prev)).otherwise(F.unhex(F.sha2(F.concat(F.col(prev), turns), 256)))


def _nodes(blocks: DataFrame, width: int, sums: list[str]) -> DataFrame:
    """``id, parent, depth, least, n, size, before`` and ``sums`` over the members, for every node but the root."""
    added = [F.sum(c).alias(c) for c in sums]
    contents = stage(
        blocks.filter(F.length("turns") > 0)
        .groupBy("k", "prev", "turns")
        .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.min("sizes").alias("sizes"), F.min("before").alias("before"), *added),
        "trie-contents",
    )
    kinds = contents.groupBy("k", "prev").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").withColumn("rows", F.col("kinds"))
    # A node may be followed by a large part of all contents, as the root is: its rows are spread.
    met = lookup_by_key(contents, kinds, ["k", "prev"], "rows", SPREAD_ROWS)
    each = met.select("*", F.posexplode("sizes").alias("i", "size"))
    path = F.substring("turns", F.lit(1), (F.col("i") + 1) * _DIGEST)
    ahead = F.aggregate(F.slice("sizes", F.lit(1), F.col("i")), F.col("before"), lambda a, x: a + x)
    steps = each.select("k", "prev", "kinds", "i", path.alias("path"), "n", "least", "size", ahead.alias("before"), *sums)
    rest = ["n", "least", "size", "before", *sums]
    chains = steps.filter("kinds IS NULL").select("k", "prev", "i", "path", *rest)
    split = (
        steps.filter("kinds IS NOT NULL")
        .groupBy("k", "prev", "i", "path")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.min("size").alias("size"), F.min("before").alias("before"), *added)
    )
    above = _node("prev", F.substring("path", F.lit(1), F.col("i") * _DIGEST))
    return chains.union(split.select(chains.columns)).select(
        _node("prev", "path").alias("id"), above.alias("parent"), (F.col("k") * width + F.col("i") + 1).cast("bigint").alias("depth"), *rest
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From ids sorted by node, runs of at most ``CHUNK_IDS`` of one node as text."""
    node, ids = None, []
    done: list[tuple[bytes, int, str]] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["id", "first", "ids"]
        )
        done.clear()
        return batch

    for batch in batches:
        for n, c in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(ids) >= CHUNK_IDS:
                if ids:
                    done.append((node, ids[0], ",".join(map(str, ids))))
                node, ids = n, []
            ids.append(c)
        if len(done) > 10_000:
            yield out()
    if ids:
        done.append((node, ids[0], ",".join(map(str, ids))))
    yield out()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From chunks sorted by node and first id, the hash of each node's ids; holds one chunk and one hash state."""
    node, state = None, None
    done: list[tuple[bytes, str]] = []

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["end_id", "ends"])
        done.clear()
        return batch

    for batch in batches:
        for n, ids in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                state.update(b",")
            else:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256()
            state.update(ids.encode())
        if len(done) > 10_000:
            yield out()
    if state is not None:
        done.append((node, state.hexdigest()))
    yield out()


def prefix_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per distinct beginning of the conversations in ``turns`` (as ``turn_table`` makes them; a NULL digest is no turn).

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (NULL for the root), ``n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``, and ``node``, a digest that names the beginning. ``saved_tokens`` are the bytes of texts that need not be read again where
    a beginning is shared, over the whole subtree. The root has depth 0 and all conversations, also those without turns. Without
    any conversation there is no row. A conversation's turns pass through one task in order, one block in memory.
    """
    parts = shuffle_parts(turns)
    ordered = turns.select("conv_id", "place", "digest", "n_bytes").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place")
    blocks = stage(ordered.mapInArrow(_cut(block_turns), _BLOCKS), "trie-blocks")

    plain = stage(_nodes(blocks, block_turns, []), "trie-nodes")
    kids = plain.groupBy(F.col("parent").alias("kids_of")).agg(F.count(F.lit(1)).alias("n_children"))
    owned = plain.join(kids, F.col("id") == F.col("kids_of"), "left")
    per_owner = owned.groupBy("least").agg(F.sum("size").alias("own"), F.count_if(F.col("kids_of").isNull()).alias("leaves"))
    lengths = blocks.filter("ends").select("conv_id", F.aggregate("sizes", F.col("before"), lambda a, x: a + x).alias("total"))
    zero = F.lit(0).cast("bigint")
    worth = lengths.join(per_owner, F.col("conv_id") == F.col("least"), "left")
    worth = stage(worth.select("conv_id", "total", F.coalesce("own", zero).alias("own"), F.coalesce("leaves", zero).alias("leaves")), "trie-worth")

    nodes = _nodes(blocks.join(worth, "conv_id"), block_turns, ["total", "own", "leaves"])
    first = worth.select(F.col("conv_id").alias("first_id"), F.col("total").alias("first_total"), F.col("own").alias("first_own"))
    parents = stage(
        plain.join(kids, F.col("id") == F.col("kids_of")).select("kids_of", "n_children", F.col("least").alias("parent_conv_id")), "trie-parents"
    )
    top = worth.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), *[F.sum(c).alias(c) for c in ("total", "own", "leaves")]).filter("n > 0")
    first_turns = plain.filter("depth = 1").agg(F.count(F.lit(1)).alias("n_children")).first().n_children
    least = top.first()
    # Every byte that members read from here on, less those of the nodes below, each counted once.
    saved = (F.col("total") - F.col("n") * F.col("before")) - (F.col("own") - F.col("first_own") + F.col("first_total") - F.col("before"))
    inner = (
        nodes.join(first, F.col("least") == F.col("first_id"))
        .join(parents.select("kids_of", "n_children"), F.col("id") == F.col("kids_of"), "left")
        .drop("kids_of")
        .join(parents.select("kids_of", "parent_conv_id"), F.col("parent") == F.col("kids_of"), "left")
        .select(
            "id", F.col("least").alias("conv_id"), "depth",
            F.when(F.col("depth") == 1, F.lit(least.least if least else None).cast("bigint")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        )
    )
    root = top.select(
        F.lit(ROOT).alias("id"), F.col("least").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.lit(first_turns).cast("bigint").alias("n_children"), F.greatest("leaves", F.lit(1)).alias("n_leaves"), (F.col("total") - F.col("own")).alias("saved_tokens"),
    )

    ended = blocks.filter("ends").select(_node("prev", "turns").alias("id"), "conv_id")
    chunks = ended.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(_chunks, "id binary, first bigint, ids string")
    ends = chunks.repartition(parts, "id").sortWithinPartitions("id", "first").mapInArrow(_hashed, "end_id binary, ends string")
    whole = inner.union(root).join(ends, F.col("id") == F.col("end_id"), "left")
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.hex("id").alias("node")
    )


def conversation_trie(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``prefix_trie`` of conversations as they are: rows of ``conv_id, turn, role, text``; other columns are not read."""
    turns = turn_table(rows)
    return prefix_trie(turns.union(_markers(turns.select("conv_id").distinct())), block_turns)
