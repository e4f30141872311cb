"""Merkle manifest of a table: a root that names its rows, and for each row the digests that lead to it.

Leaves of a group stand in order; every ``fanout`` consecutive nodes hash to one, until one is left, and the groups' last nodes
are hashed likewise to the root. A level is kept in blocks: an aligned block holds ``fanout ** 2`` consecutive nodes as one
string of hex digests of fixed width. Substrings of it hash to the parents, which are again a string, and the substrings that
flank a node in its run are its siblings. A block ends as one node of the next round, so rounds recurse on a table that is
``fanout ** 2`` times smaller, and the groups' last nodes go through the same rounds.

A group that holds a third of all rows is many blocks like any other: positions come from range partitions, not from a sort
of a group in one task. Proofs are made where a block is taken apart; only the path above a block is joined to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import group_positions
from ..session import stage

FANOUT = 16
WIDTH = 64  # hex digits of a sha256
#: Fixed order of the fields in a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """sha256 of the fields one after the other, each as ``-`` if NULL, else its UTF-8 byte count, ``:`` and itself."""

    def part(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields.values()]), 256)


def document_leaf(**changed: Column) -> Column:
    """The leaf of a row of documents; ``changed`` puts other values in place of fields."""
    return leaf_digest({name: changed.get(name, F.col(name)) for name in FIELDS})


@dataclass(frozen=True)
class Manifest:
    """``levels[k]`` are the written blocks of round k: group, block, total (nodes of the group in this round), members,
    level0, level1, top. ``groups`` are those of the groups' last nodes."""

    group: str
    carried: tuple[str, ...]
    fanout: int
    levels: tuple[DataFrame, ...]
    groups: tuple[DataFrame, ...]

    def root(self) -> DataFrame:
        """``root``: one row, none of an empty table."""
        return self.groups[-1].select(F.col("top").alias("root"))


def _parents(level: Column, fanout: int) -> Column:
    width = fanout * WIDTH
    runs = F.greatest(F.ceil(F.length(level) / width).cast("int"), F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)), "")


def _blocks(nodes: DataFrame, keys: list[str], carried: list[str], fanout: int) -> DataFrame:
    size = fanout * fanout
    placed = nodes.withColumn("block", F.floor(F.col("pos") / size))
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *carried)))  # at most ``size``
    rows = placed.groupBy(*keys, "block", "total").agg(members.alias("members"))
    level0 = rows.withColumn("level0", F.array_join(F.transform("members", lambda m: m["node"]), ""))
    level1 = level0.withColumn("level1", F.when(F.col("total") > 1, _parents(F.col("level0"), fanout)))
    top = F.when(F.col("total") == 1, F.col("level0")).when(F.col("total") <= fanout, F.col("level1")).otherwise(_parents(F.col("level1"), fanout))
    return stage(level1.withColumn("top", top), "merkle-blocks")


def _climb(nodes: DataFrame, keys: list[str], carried: list[str], fanout: int) -> tuple[DataFrame, ...]:
    """Blocks of every round, until each group is one node. The number of rounds grows with the logarithm of the largest group."""
    levels, size = [], fanout * fanout
    while True:
        levels.append(_blocks(nodes, keys, carried, fanout))
        if (levels[-1].agg(F.max("total")).first()[0] or 1) <= size:
            return tuple(levels)
        nodes = levels[-1].select(*keys, F.col("block").alias("pos"), F.ceil(F.col("total") / size).alias("total"), F.col("top").alias("node"))
        carried = []


def build(leaves: DataFrame, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves``: columns ``group``, ``order``, ``leaf`` (hex) and any that are carried to the proofs.

    Groups are ordered as Spark orders them (NULL first, strings by UTF-8 bytes), rows of a group by ``order`` (NULL first), ties by
    ``leaf``. Rows that repeat are leaves of their own. Names used inside are kept apart from those of carried columns.
    """
    own = {c: f"c{i}" for i, c in enumerate(leaves.columns)}
    row = F.monotonically_increasing_id().alias("nth")  # parts rows that repeat, so that they can be spread
    written = stage(leaves.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.lit(1).cast("bigint").alias("one"), row), "merkle-leaves")
    key, by, leaf = own[group], own[order], own["leaf"]
    placed = group_positions(written, [key], [F.col(by).asc(), F.col(leaf).asc(), F.col("nth").asc()], "one", "pos", "total")
    rest = [n for c, n in own.items() if c not in (group, "leaf")]
    levels = _climb(placed.select(key, "pos", "total", F.col(leaf).alias("node"), *rest), [key], rest, fanout)
    lone = stage(levels[-1].select(key, F.col("top").alias("node"), F.lit(1).cast("bigint").alias("one")), "merkle-subroots")
    ranked = group_positions(lone, [], [F.col(key).asc()], "one", "pos", "total")
    groups = _climb(ranked.select("pos", "total", "node", key), [], [key], fanout)
    return Manifest(group, tuple(leaves.columns), fanout, levels, groups)


def _taken_apart(blocks: DataFrame, fanout: int, kept: list[str]) -> DataFrame:
    """A row per node of ``blocks``: its struct ``m``, the columns in ``kept``, and its path, siblings of the lowest level first."""
    one = blocks.select("total", "level0", "level1", "above", *kept, F.posexplode("members").alias("i", "m"))
    run = F.floor(F.col("i") / fanout).cast("int")
    start = run * fanout

    def flanks(level: str, first: Column, at: Column) -> Column:
        left = F.substring(level, first * WIDTH + 1, (at - first) * WIDTH)
        right = F.substring(level, (at + 1) * WIDTH + 1, (first + fanout - 1 - at) * WIDTH)
        return F.array(F.struct(left.alias("left"), right.alias("right")))

    none = F.array().cast(PATH)
    low = F.when(F.col("total") > 1, flanks("level0", start, F.col("i"))).otherwise(none)
    high = F.when(F.col("total") > fanout, flanks("level1", F.lit(0), run)).otherwise(none)
    return one.select("m", *kept, F.concat(low, high, "above").alias("path"))


def _descend(levels: tuple[DataFrame, ...], top: DataFrame, keys: list[str], kept: list[str], fanout: int) -> DataFrame:
    """Paths of the nodes of the first round; ``top`` has, for each group, ``kept`` and the path ``above`` its last node."""
    above = top.withColumn("up_block", F.lit(0).cast("bigint"))
    for k in range(len(levels) - 1, -1, -1):
        names = {c: f"up_{c}" for c in keys}
        same = [F.col("block") == F.col("up_block"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]]
        joined = levels[k].join(above.withColumnsRenamed(names), same).drop(*names.values(), "up_block")
        apart = _taken_apart(joined, fanout, [*keys, *kept])
        if k:
            above = apart.select(*keys, *kept, F.col("m.pos").alias("up_block"), F.col("path").alias("above"))
    return apart


def proofs(manifest: Manifest) -> DataFrame:
    """A row per leaf: the columns that ``build`` was given, ``subroot, root`` and ``path``, an array of ``(left, right)``.

    ``left`` and ``right`` are the hex digests beside a node in its run, put together; one entry for each level, the lowest first, the
    groups' levels last. A lone node has no level. An empty table gives no rows.
    """
    f, (key, *_) = manifest.fanout, manifest.levels[0].columns
    # The one block of the last round of all groups is the root's.
    known = manifest.groups[-1].select(F.col("top").alias("r"))
    groups = _descend(manifest.groups, known.select("r", F.array().cast(PATH).alias("above")), [], ["r"], f)
    subroots = manifest.levels[-1].select(F.col(key).alias("sub_key"), F.col("top").alias("s"))
    ends = groups.select(F.col(f"m.{key}").alias("g"), "r", F.col("path").alias("above"))
    top = ends.join(subroots, F.col("g").eqNullSafe(F.col("sub_key"))).select(F.col("g").alias(key), "s", "r", "above")
    rows = _descend(manifest.levels, top, [key], ["s", "r"], f)
    places = {c: f"c{i}" for i, c in enumerate(manifest.carried)}
    out = [
        (F.col(key) if c == manifest.group else F.col("m.node") if c == "leaf" else F.col(f"m.{n}")).alias(c) for c, n in places.items()
    ]
    return rows.select(*out, F.col("s").alias("subroot"), F.col("r").alias("root"), "path")


def proof_digest(path: str | Column) -> Column:
    """sha256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(leaf: Column, path: str | Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest_check(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every document's proof, and what it says once some texts were changed after the manifest was made.

    Columns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``, one row per input row. Where 5 divides the crc32 of
    the decimal ``doc_id``, the leaf that is folded has A-Z of its text in lower case; a text without any, or NULL, stays as it was. NULL
    fields are ``-`` in a leaf; a NULL ``source`` is a group, a NULL ``doc_id`` comes first and is never changed. Rows that repeat
    are leaves of their own; ties of ``doc_id`` are ordered by leaf. An empty table gives no rows; other columns are not read.
    """
    plain = docs.select(*FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = plain.select("doc_id", "source", document_leaf().alias("leaf"), F.when(hit, document_leaf(text=lower)).alias("changed"))
    rows = proofs(build(leaves, fanout=fanout))
    told = rows.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), "path").alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
