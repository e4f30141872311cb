"""Join of near-duplicate documents by the Jaccard similarity of their word n-grams, exact, over size-banded tiles.

1. A document is the set of hashes of its distinct n-grams. Equal sets are one class; only classes are compared.
2. Sizes are cut into bands; a link joins a band with itself or the next. For each band ``d`` bounds how many hashes the
   sets of a link can have apart, so of ``d + 1`` or more tiles, into which the range of hashes is cut, one at least is
   equal in both. A set enters one bucket per tile, named by what it holds there. A tile in which both are empty tells
   nothing; a few tiles more than needed make up for those, and sets with yet more empty tiles name them, too.
3. Buckets with several classes give candidates: every class meets the first class of its buckets. Links found make
   components; only where a bucket still holds several components its classes are compared across them, at first by the
   closest pair of each two, as long as that links, then by all pairs left. So a group of thousands of near copies is not expanded into its pairs.
4. Candidates are tested on hashed parity bitmaps first: the bits in which two bitmaps differ are at most as many as the
   hashes that the sets have apart, which bounds the overlap from above. What passes is intersected exactly.

A key is one tile of a document's many, so even a group with a third of all documents puts a small share of the rows in one
bucket. Buckets of more than ``TILE_ROWS`` classes are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import SHORT_RUN_CHARS, id_and_text, lent, runs, shuffle_parts
from .components import components

TILE_ROWS = 4096
_HELD_PAIRS = 1_000_000  # pairs of nodes that a task holds (16 bytes each) before it passes them on
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SHIFTS = (np.uint64(29), np.uint64(32))


@dataclass(frozen=True)
class NgramRule:
    words: int = 5
    percent: int = 80  # documents link if 100 * intersection >= percent * union

    def apart(self, both: np.ndarray | int):
        """The most hashes that two linked sets of this joint size have apart."""
        return both * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, size: int) -> int:
        return size * 100 // self.percent

    def bands(self) -> Iterator[tuple[int, int]]:
        low = 1
        while True:
            high = max(low, low * 3 // 2)
            yield low, high
            low = high + 1


def _product(a: int, b: np.uint64) -> np.uint64:
    return np.uint64(a * int(b) & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + _product(salt, _ODD[2])
    x = (x ^ (x >> _SHIFTS[0])) * _ODD[0]
    x = (x ^ (x >> _SHIFTS[1])) * _ODD[1]
    return x ^ (x >> _SHIFTS[0])


def ngram_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; shorter texts are one n-gram, texts without words none."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(lengths.sum()))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))[ids]
    ends = np.cumsum(lengths)
    total = max(0, len(hashes) - words + 1)
    rolled = np.zeros(total, np.uint64)
    for i in range(words):
        rolled = rolled * _ODD[1] + hashes[i : i + total]
    rolled = _mix(rolled)
    out = []
    for n, end in zip(lengths, ends, strict=True):
        start = end - n
        if n >= words:
            out.append(np.unique(rolled[start : end - words + 1]))
        elif n:
            value = np.zeros(1, np.uint64)
            for h in hashes[start:end]:
                value = value * _ODD[1] + h
            out.append(_mix(value, int(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """Bit ``i`` is the parity of the number of hashes that fall on ``i``; at least four times as many bits as hashes."""
    bits = 1 << max(6, int(4 * len(hashes) - 1).bit_length())
    at = (_mix(hashes, 1) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, the larger ones folded to the size of the smallest."""
    size = min(map(len, bitmaps))
    rows = np.empty((len(bitmaps), size // 8), np.uint64)
    for i, b in enumerate(bitmaps):
        row = np.frombuffer(b, np.uint64)
        while len(row) > size // 8:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        rows[i] = row
    return rows


def bits_apart(a: bytes, b: bytes) -> int:
    x, y = _folded([a, b])
    return int(np.bitwise_count(x ^ y).sum())


def bucket_keys(hashes: np.ndarray, rule: NgramRule) -> np.ndarray:
    """Names of the buckets that a set enters: one for each tile, in its own band and, if it can be the larger one, the band below."""
    n, keys = len(hashes), []
    if n == 0:
        return np.zeros(0, np.uint64)  # an empty set links with nothing and has no band
    for number, (low, high) in enumerate(rule.bands()):
        own = low <= n <= high
        if own or n <= rule.largest_partner(high) and n > high:
            keys.append(_keys_of_band(hashes, number, low, high, rule))
        if own:
            break
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _keys_of_band(hashes: np.ndarray, band: int, low: int, high: int, rule: NgramRule) -> np.ndarray:
    most = int(rule.apart(high + rule.largest_partner(high)))
    if most == 0:
        return np.zeros(0, np.uint64)  # only equal sets link, and those are one class
    spare = ceil(1.5 * (most + 1) * exp(-low / (most + 1)))
    tiles = most + 1 + spare
    tile = (hashes >> _SHIFTS[1]) * np.uint64(tiles) >> _SHIFTS[1]  # grows with the sorted hashes
    first = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    held = np.add.reduceat(_mix(hashes, 2), first)
    salt = _product(band + 1, _ODD[0])
    keys = _mix(held ^ (tile[first] * _ODD[1] + salt), 3)
    if tiles - len(first) > spare:
        empty = np.setdiff1d(np.arange(tiles, dtype=np.uint64), tile[first])
        keys = np.concatenate([keys, _mix(empty * _ODD[1] + salt, 4)])
    return keys


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(rule: NgramRule):
    @lent
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, chars=SHORT_RUN_CHARS):
            sets = ngram_sets(batch.column("text").to_pylist(), rule.words)
            cls = np.array([_mix(_mix(s, 5).sum(keepdims=True), len(s))[0] for s in sets], np.uint64)
            check = np.array([_mix(s, 6).sum() for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _signed(cls), _signed(check), pa.array([parity_bitmap(s) for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "cls", "cls_check", "bits"],
            )

    return make


def _keys(rule: NgramRule):
    @lent
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, chars=SHORT_RUN_CHARS):
            sets = ngram_sets(batch.column("text").to_pylist(), rule.words)
            keys = [bucket_keys(s, rule) for s in sets]
            cls = np.array([_mix(_mix(s, 5).sum(keepdims=True), len(s))[0] for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.repeat(cls, [len(k) for k in keys]))], ["key", "cls"])

    return make


@lent
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and class, those of keys with several classes, each with the key's first class."""
    key = lead = last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        k, c = (np.asarray(batch.column(i)) for i in range(2))
        new = np.empty(len(k), bool)
        new[0], new[1:] = k[0] != key, k[1:] != k[:-1]
        other = np.empty(len(k), bool)
        other[0], other[1:] = c[0] != last, c[1:] != c[:-1]
        opened = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        leads = np.where(opened >= 0, c[np.maximum(opened, 0)], 0 if lead is None else lead)
        emit = ~new & other
        yield pa.RecordBatch.from_arrays([pa.array(k[emit]), pa.array(c[emit]), pa.array(leads[emit])], ["key", "cls", "lead"])
        key, lead, last = k[-1], leads[-1], c[-1]


def _passes(rule: NgramRule):
    """Pairs whose bitmaps leave a link possible, with the bits that they differ in."""

    @lent
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.to_pydict()
            apart = np.array([bits_apart(x, y) for x, y in zip(p["a_bits"], p["b_bits"], strict=True)], np.int64)
            most = rule.apart(np.array(p["a_n"], np.int64) + np.array(p["b_n"], np.int64))
            good = apart <= most
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(p["a"], np.int64)[good]), pa.array(np.array(p["b"], np.int64)[good]), pa.array(apart[good])], ["a", "b", "apart"]
            )

    return test


def _links(docs: DataFrame, pairs: DataFrame, rule: NgramRule) -> DataFrame:
    """Of pairs of documents those that link, by exact intersection of their sorted sets."""
    wanted = pairs.select(F.col("a").alias("wanted")).union(pairs.select(F.col("b").alias("wanted"))).distinct()

    @lent
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, chars=SHORT_RUN_CHARS):
            sets = ngram_sets(batch.column("text").to_pylist(), rule.words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["member", "grams"])

    @lent
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("a_grams"), batch.column("b_grams"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * same >= rule.percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], ["a", "b"])

    texts = id_and_text(docs).join(wanted, F.col("doc_id") == F.col("wanted"), "left_semi")
    known = stage(texts.dropDuplicates(["doc_id"]).mapInArrow(arrays, "member bigint, grams binary"), "ngram-sets")
    left = known.select(F.col("member").alias("a"), F.col("grams").alias("a_grams"))
    right = known.select(F.col("member").alias("b"), F.col("grams").alias("b_grams"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a")
    return stage(met.mapInArrow(intersect, "a bigint, b bigint"), "ngram-links")


def _number_apart(a: tuple[int, int], b: tuple[int, int]) -> int:
    """Bits in which two bitmaps, given as a number and its size in bits, differ."""
    (x, size), (y, other) = (a, b) if a[1] <= b[1] else (b, a)
    while other > size:
        other //= 2
        y = (y >> other) ^ (y & ((1 << other) - 1))
    return (x ^ y).bit_count()


def _few_across(block: dict[str, list], rule: NgramRule, closest_only: bool) -> list[tuple[int, int]]:
    """Pairs of nodes of a small block that can link; of each two components the closest, if that is all that is asked for."""
    bits = [(int.from_bytes(b, "little"), 8 * len(b)) for b in block["bits"]]
    node, n, comp, side = block["node"], block["n"], block["comp"], block["side"]
    found = []
    for i in range(len(node)):
        for j in range(i):
            if comp[i] != comp[j] and (side[i] != side[j] or side[i] == 2):
                apart = _number_apart(bits[i], bits[j])
                if apart <= rule.apart(n[i] + n[j]):
                    found.append((apart, i, j))
    if closest_only:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for pair in found:
            key = (min(comp[pair[1]], comp[pair[2]]), max(comp[pair[1]], comp[pair[2]]))
            best[key] = min(best.get(key, pair), pair)
        found = list(best.values())
    return [(min(node[i], node[j]), max(node[i], node[j])) for _, i, j in found]


def _many_across(block: dict[str, list], rule: NgramRule, closest_only: bool) -> Iterator[np.ndarray]:
    """The same for a large block as arrays of positions and bits apart, a run of rows at a time, the closest ones of each run."""
    rows = _folded(block["bits"])
    size, side = (np.array(block[c]) for c in ("n", "side"))
    # Members of the largest component are met by the others only; the others meet each other, too.
    _, comp, count = np.unique(block["comp"], return_inverse=True, return_counts=True)
    largest = count.argmax()
    found, held = [], 0
    for i in np.flatnonzero(comp != largest):
        apart = np.bitwise_count(rows ^ rows[i]).sum(axis=1, dtype=np.int64)
        once = (comp == largest) | (np.arange(len(comp)) < i)
        at = np.flatnonzero((apart <= rule.apart(size + size[i])) & (comp != comp[i]) & ((side != side[i]) | (side == 2)) & once)
        found.append(np.stack([np.full(len(at), i), at, apart[at]], axis=1).astype(np.int32))
        held += len(at)
        if held > 500_000:
            found = [_closest(np.concatenate(found), comp) if closest_only else np.concatenate(found)]
            if (held := len(found[0])) > 250_000:
                yield found[0]
                found, held = [], 0
    if found:
        yield _closest(np.concatenate(found), comp) if closest_only else np.concatenate(found)


def _closest(found: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Of pairs (positions, bits apart) the closest one of each two components: one link joins them."""
    a, b = comp[found[:, 0]], comp[found[:, 1]]
    key = np.minimum(a, b) * (int(comp.max()) + 1) + np.maximum(a, b)
    order = np.lexsort((found[:, 1], found[:, 0], found[:, 2], key))
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(order) else np.zeros(0, bool)
    return found[order[first]]


def _once(pairs: np.ndarray) -> np.ndarray:
    """Rows of two numbers, each once."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    return pairs[np.concatenate([[True], (pairs[1:] != pairs[:-1]).any(axis=1)])] if len(pairs) else pairs


def _across(rule: NgramRule, closest_only: bool):
    """Within each block of a bucket (rows come sorted by block), pairs of different components that can link."""
    columns = ("node", "comp", "n", "bits", "side")

    @lent
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: list[tuple[int, int]] = []
        many: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            """What was found since the last time, each pair once: near copies meet in many buckets."""
            nonlocal rows
            pairs = _once(np.concatenate([np.array(few, np.int64).reshape(-1, 2), *many]))
            few.clear()
            many.clear()
            rows = 0
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in (0, 1)], ["a", "b"])

        def compared(block: dict[str, list]) -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if len(block["node"]) <= 12:
                few.extend(_few_across(block, rule, closest_only))
            else:
                node = np.array(block["node"], np.int64)
                for found in _many_across(block, rule, closest_only):
                    many.append(np.sort(node[found[:, :2]], axis=1))
                    rows += len(found)
                    if rows > _HELD_PAIRS:
                        many[:] = [_once(np.concatenate(many))]
                        if (rows := len(many[0])) > _HELD_PAIRS // 2:
                            yield out()
            if len(few) > 100_000:
                few[:] = set(few)
                if len(few) > 50_000:
                    yield out()

        name, block = None, {c: [] for c in columns}
        for batch in batches:
            values = batch.to_pydict()
            for r, at in enumerate(zip(values["key"], values["i"], values["j"], strict=True)):
                if at != name:
                    yield from compared(block)
                    name, block = at, {c: [] for c in columns}
                for c in columns:
                    block[c].append(values[c][r])
        yield from compared(block)
        yield out()

    return compare


def _cross_pairs(buckets: DataFrame, classes: DataFrame, labels: DataFrame, rule: NgramRule, closest_only: bool) -> DataFrame:
    members = buckets.select("key", "cls").union(buckets.select("key", F.col("lead").alias("cls")).distinct())
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        "cls", F.col("rep").alias("node"), F.coalesce("component", "rep").alias("comp"), F.col("n_shingles").alias("n"), "bits"
    )
    slim = members.join(named.select("cls", "node", "comp"), "cls")
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"print{i}") for i in (0, 1)]
    mixed = slim.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("rows"), *prints).filter("c1 != c2")
    # Near copies share many tiles: buckets of the same members give the same pairs, so one of them is compared.
    mixed = mixed.groupBy("rows", "print0", "print1").agg(F.min("key").alias("mixed_key"))
    mixed = mixed.select("mixed_key", F.ceil(F.col("rows") / TILE_ROWS).alias("blocks"))
    kept = stage(slim.join(mixed, F.col("key") == F.col("mixed_key")).select("key", "cls", "node", "comp", "blocks"), "ngram-mixed")
    rows = kept.select("key", "node", "comp", "blocks").join(named.select(F.col("node").alias("of"), "n", "bits"), F.col("node") == F.col("of")).drop("of")
    # A bucket of one block is compared in itself (side 2); of several blocks, each pair of blocks makes a tile.
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"))))
    tiled = rows.select("*", own.alias("own"), tile.alias("tile")).select(
        "key", "tile.i", "tile.j", "node", "comp", "n", "bits",
        F.when(F.col("tile.i") == F.col("tile.j"), F.lit(2)).when(F.col("own") == F.col("tile.i"), F.lit(0)).otherwise(F.lit(1)).alias("side"),
    )
    tile_rows = tiled.repartition(shuffle_parts(buckets), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tile_rows.mapInArrow(_across(rule, closest_only), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, rule: NgramRule = NgramRule()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, class_id``.

    ``component_id`` is the smallest id reachable by links, ``class_id`` the smallest id with the same n-grams. Null, empty and
    blank texts have no n-gram and link with nothing, not even each other. Rows that repeat are members of one class. A NULL
    ``doc_id`` takes the component of documents with its n-grams, or NULL. An empty table gives no rows; other columns are not read.
    """
    texts, parts = id_and_text(docs), shuffle_parts(docs)
    sets = stage(texts.mapInArrow(_sets(rule), "doc_id bigint, n_shingles bigint, cls bigint, cls_check bigint, bits binary"), "ngram-documents")
    some = sets.filter("n_shingles > 0")
    classes = stage(
        some.groupBy("cls", "cls_check", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("bits").alias("bits")).filter("rep IS NOT NULL"),
        "ngram-classes",
    )
    rows = texts.mapInArrow(_keys(rule), "key bigint, cls bigint")
    buckets = stage(
        rows.repartition(parts, "key").sortWithinPartitions("key", "cls").mapInArrow(_shared, "key bigint, cls bigint, lead bigint"), "ngram-buckets"
    )

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(f"{name}_cls"), F.col("rep").alias(name), F.col("n_shingles").alias(f"{name}_n"), F.col("bits").alias(f"{name}_bits"))

    stars = buckets.select(F.col("lead").alias("a_cls"), F.col("cls").alias("b_cls")).distinct()
    near = stars.join(side("b"), "b_cls").join(side("a"), "a_cls").filter("a != b").mapInArrow(_passes(rule), "a bigint, b bigint, apart bigint")
    # Every class first meets the closest of its buckets' first classes.
    first = near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    first = stage(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-pairs")
    links, tested = _links(docs, first, rule), first
    labels = stage(components(links), "ngram-labels")
    closest_only, ended = True, buckets.isEmpty()
    while not ended:
        found = stage(_cross_pairs(buckets, classes, labels, rule, closest_only), "ngram-cross")
        pairs = stage(found.join(tested, ["a", "b"], "left_anti"), "ngram-pairs")
        some_pairs = not pairs.isEmpty()
        more = _links(docs, pairs, rule) if some_pairs else pairs
        tested = tested.unionByName(pairs)
        # A tested closest pair that does not link hides the others of its two components: only a round of all pairs is the last.
        ended = not closest_only or (not some_pairs and found.isEmpty())
        if not some_pairs or more.isEmpty():
            closest_only = False  # once the closest pairs link no more, all pairs left are tested
        else:
            links = links.unionByName(more)
            labels = stage(components(links), "ngram-labels")
    of_class = classes.join(labels, F.col("rep") == F.col("node"), "left").select(
        F.col("cls").alias("c1"), F.col("cls_check").alias("c2"), "rep", F.coalesce("component", "rep").alias("component")
    )
    joined = sets.join(of_class, (F.col("cls") == F.col("c1")) & (F.col("cls_check") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"))


def keep_one_of_each(docs: DataFrame, rule: NgramRule = NgramRule()) -> DataFrame:
    """``docs`` without near copies: of each component the rows with its smallest id stay, and rows with a NULL id."""
    result = near_duplicates(docs, rule)
    gone = stage(result.filter("doc_id != component_id").select(F.col("doc_id").alias("gone_id")).distinct(), "ngram-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # columns may have any names
    return rows.join(gone, F.col("row.doc_id") == F.col("gone_id"), "left_anti").select("row.*")
