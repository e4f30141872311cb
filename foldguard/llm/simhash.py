"""Near copies by SimHash fingerprints, exact within a Hamming distance, by the generalised pigeonhole principle.

1. A fingerprint bit is 1 if it is 1 in over half the hashes of a document's shingles. Equal fingerprints are one class; classes are
   compared, never copies.
2. Bits are grouped into partitions, correlated ones together. If the radii at which partitions are searched, each plus one, add up to the
   distance plus one, two fingerprints within the distance are within the radius in one partition at least. A partition may get
   nothing. Which partition gets which radius is solved by dynamic programming on the estimated number of probes and candidates:
   pairs that agree in a partition are counted over all classes, and those a few bits apart follow from how often each bit is set. Two,
   three and four partitions are tried, so wide keys win where there are many documents, few probes where there are not.
3. Each class is filed under the values near its own in each partition that is searched; half the radius from either side is enough to
   meet. In a bucket, whole fingerprints are compared, and of the links found those go on that join what was apart: a group of near
   copies is a tree, not all its pairs. Buckets of more than ``TILE_ROWS`` classes are compared in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_by_key
from ..session import stage
from .base import id_and_text, runs, shuffle_parts
from .components import components

BITS = 64
TILE_ROWS = 4096
SPREAD_ROWS = 1024  # classes of one component, for each shuffle key that they are spread over
#: Estimated cost of a row that is filed, and of two fingerprints that are compared.
PROBE_COST, PAIR_COST = 1.0, 0.02
_SMALL = 24  # buckets up to this size are compared many at a time
_KEY_BITS = 40  # a bucket's name is its partition above the value, which takes fewer bits than this
_HASHES = 1 << 16  # shingles that are counted at a time


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words are one shingle, none give no hash."""
    split = text.lower().split()  # of bytes: A-Z only, and the six blanks
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed)], np.uint64)
    line = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = map(slice, starts[: len(split) - words + 1].tolist(), ends[words - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(line[s], seed) for s in spans), np.uint64, len(split) - words + 1)


def simhash(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _HASHES):
        counts += _bits(hashes[i : i + _HASHES]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits per value, the lowest first."""
    return np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fingerprints(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            texts = batch.column("text")
            found = np.fromiter((simhash(shingle_hashes(t.as_buffer().to_pybytes(), words)) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return make


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number."""
    return id_and_text(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(words), "doc_id bigint, fp bigint")


@dataclass(frozen=True)
class ProbePlan:
    """Partitions of the bits, and the radius at which each is searched; -1 is not at all."""

    parts: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]


def grouped_bits(together: np.ndarray, n: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """The bits in ``parts`` groups of nearly equal size, each grown from the strongest pair left by the bit most correlated with it.

    ``together[i, j]`` counts the fingerprints with both bits set, ``n`` all of them.
    """
    share = together / max(n, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 0))
    scale = np.outer(spread, spread)
    linked = np.abs(np.divide(share - np.outer(p, p), scale, out=np.zeros_like(share), where=scale > 1e-12))
    np.fill_diagonal(linked, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        size = BITS // parts + (i < BITS % parts)
        inside = linked[np.ix_(left, left)]
        group = [left[int(inside.sum(axis=1).argmax())]]
        left.remove(group[0])
        while len(group) < size:
            best = left[int(linked[np.ix_(left, group)].mean(axis=1).argmax())]
            group.append(best)
            left.remove(best)
        out.append(tuple(sorted(group)))
    return tuple(out)


def allocated(costs: Sequence[Sequence[float]], units: int) -> tuple[int, ...]:
    """How many units each partition gets, so that all are given out at the least sum of ``costs[partition][units]``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for given, (cost, chosen) in best.items():
            for u in range(units - given + 1):
                option = (cost + row[u], (*chosen, u))
                step[given + u] = min(step.get(given + u, option), option)
        best = step
    return best[units][1]


def _meeting(radius: int) -> tuple[int, int]:
    """How far from its own value a class is filed as met, and as meeting: the two add up to the radius."""
    return radius // 2, radius - radius // 2


def _costs(group: Sequence[int], same_pairs: float, n: int, ones: np.ndarray, distance: int) -> list[float]:
    """Estimated cost of searching a partition with 0, 1, … units."""
    p = ones[list(group)] / max(n, 1)
    differ = 2 * p * (1 - p)
    odds = differ / (1 - differ)
    apart = np.zeros(distance + 1)  # by number of bits: pairs that differ there, for each pair that agrees
    apart[0] = 1
    for o in odds:
        apart[1:] += o * apart[:-1]
    out = [0.0]
    for radius in range(distance + 1):
        filed = sum(comb(len(group), k) for k in range(_meeting(radius)[1] + 1))
        out.append(PROBE_COST * n * filed + PAIR_COST * same_pairs * apart[: radius + 1].sum())
    return out


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        if batch.num_rows:
            x = _bits(np.asarray(batch.column("fp")).view(np.uint64)).astype(np.float32)
            total += (x.T @ x).astype(np.int64)
    i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i.astype(np.int32), j.astype(np.int32), total)], ["i", "j", "n"])


def _values(groups: Sequence[Sequence[int]], fp: np.ndarray) -> list[np.ndarray]:
    """For each group of bits, the number that a fingerprint holds there."""
    bits, out = _bits(fp), []
    for g in groups:
        packed = np.zeros((len(fp), BITS), np.uint8)
        packed[:, : len(g)] = bits[:, list(g)]
        out.append(np.packbits(packed, axis=1, bitorder="little").view("<u8").ravel().astype(np.int64))
    return out


def _valued(groups: Sequence[Sequence[int]]):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(groups, np.asarray(batch.column("fp")).view(np.uint64))
            numbers = np.repeat(np.arange(len(groups), dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate(values))], ["part", "value"])

    return make


def probe_plan(classes: DataFrame, distance: int = 3, counts: Sequence[int] = (2, 3, 4)) -> ProbePlan:
    """The cheapest plan for the distinct fingerprints ``fp`` of ``classes``; the driver sees 64 x 64 counts and a number per partition."""
    found = classes.select("fp").mapInArrow(_co_occurrence, "i int, j int, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    together = np.zeros((BITS, BITS))
    for r in found:
        together[r.i, r.j] = r.n
    n = classes.count()
    options = [grouped_bits(together, n, m) for m in counts]
    groups = [g for parts in options for g in parts]
    sizes = classes.select("fp").mapInArrow(_valued(groups), "part int, value bigint").groupBy("part", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    same = {r.part: r.pairs for r in sizes.groupBy("part").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")).collect()}
    plans, at = [], 0
    for parts in options:
        costs = [_costs(g, same.get(at + i, 0.0), n, np.diag(together), distance) for i, g in enumerate(parts)]
        at += len(parts)
        units = allocated(costs, distance + 1)
        plans.append((sum(row[u] for row, u in zip(costs, units, strict=True)), ProbePlan(parts, tuple(u - 1 for u in units))))
    return min(plans, key=lambda p: p[0])[1]


def filed(plan: ProbePlan, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint, a row of the buckets that it enters: their names, and whether it may be met there by one farther off."""
    names, met = [], []
    for number, (values, group, radius) in enumerate(zip(_values(plan.parts, fp), plan.parts, plan.radii, strict=True)):
        if radius < 0:
            continue
        inner, outer = _meeting(radius)
        for k in range(outer + 1):
            for flipped in combinations(range(len(group)), k):
                mask = sum(1 << b for b in flipped)
                names.append((values ^ mask) | (number << _KEY_BITS))
                met.append(k <= inner)
    return np.stack(names, axis=1), np.array(met, bool)


def _buckets(plan: ProbePlan):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            for i in range(0, len(fps), 1024):
                some = fps[i : i + 1024]
                names, met = filed(plan, some.view(np.uint64))
                width = names.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names.ravel()), pa.array(np.repeat(some, width)), pa.array(np.tile(met, len(some)))], ["key", "fp", "met"]
                )

    return make


def _grown(fp: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that make a forest of one bucket: each fingerprint reached is compared with those not reached yet."""
    links, waiting = [], np.arange(len(fp))
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            at = front.pop()
            near = np.bitwise_count(fp[waiting] ^ fp[at]) <= distance
            if near.any():
                links += [(at, x) for x in waiting[near]]
                front += list(waiting[near])
                waiting = waiting[~near]
    return links


def _side_by_side(bucket: np.ndarray, fp: np.ndarray, met: np.ndarray, size: int, distance: int) -> list[tuple[int, int]]:
    """The same for many small buckets at once, whose rows stand together; rows are compared with those a few places on."""
    a, b = [], []
    for step in range(1, size):
        same = (bucket[step:] == bucket[:-step]) & (met[step:] | met[:-step])
        at = np.flatnonzero(same)
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        a.append(at)
        b.append(at + step)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    links = []
    for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            links.append((x, y))
    return links


def _linked(distance: int):
    """From rows sorted by bucket and tile, links that join each bucket's near fingerprints."""

    def links_of(bucket: np.ndarray, fp: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        sizes = np.diff(np.append(new, len(bucket)))
        small = np.repeat((sizes > 1) & (sizes <= _SMALL), sizes)
        out = []
        if small.any():
            x, y = bucket[small], fp[small]
            links = _side_by_side(x, y, met[small], int(sizes[(sizes > 1) & (sizes <= _SMALL)].max()), distance)
            out += [(y[i], y[j]) for i, j in links]
        for start, size in zip(new[sizes > _SMALL], sizes[sizes > _SMALL], strict=True):
            some = np.unique(fp[start : start + size])
            out += [(some[i], some[j]) for i, j in _grown(some, distance)]
        pairs = np.array(out, np.uint64).reshape(-1, 2)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]].view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, fp, met = np.asarray(batch.column("key")), np.asarray(batch.column("fp")).view(np.uint64), batch.column("met").to_numpy(zero_copy_only=False)
            tile = np.asarray(batch.column("i")) * (1 << 31) + np.asarray(batch.column("j"))
            held.append((np.stack([key, tile]), fp, met))
            rows += len(key)
            if rows < 50_000:
                continue
            name, fps, mets = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            ends = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0))
            if len(ends):  # the last bucket may go on
                cut = int(ends[-1]) + 1
                yield links_of(_numbered(name[:, :cut]), fps[:cut], mets[:cut])
                name, fps, mets = name[:, cut:], fps[cut:], mets[cut:]
            held, rows = [(name, fps, mets)], 0
        if held:
            name, fps, mets = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            if len(fps):
                yield links_of(_numbered(name), fps, mets)

    return compare


def _numbered(name: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((name[:, 1:] != name[:, :-1]).any(axis=0))])


def fingerprint_links(classes: DataFrame, plan: ProbePlan, distance: int = 3) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` of ``classes`` that join all within the distance of each other."""
    parts = shuffle_parts(classes)
    rows = stage(classes.select("fp").mapInArrow(_buckets(plan), "key bigint, fp bigint, met boolean"), "simhash-buckets")
    large = rows.groupBy(F.col("key").alias("large_key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE_ROWS)
    large = large.select("large_key", F.ceil(F.col("n") / TILE_ROWS).alias("blocks"))
    named = rows.join(large, F.col("key") == F.col("large_key"), "left")
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), blocks)
    other = F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    tiles = named.select("key", "fp", "met", own.alias("own"), F.explode(other).alias("other"))
    placed = tiles.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "met")
    ordered = placed.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = ordered.mapInArrow(_linked(distance), "a bigint, b bigint")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable by links.

    Fingerprints link at ``distance`` or fewer differing bits. A-Z count as lower case; null, empty and blank texts have the fingerprint
    zero, which links like any other; texts of fewer than ``words`` words are one shingle. Rows that repeat have a fingerprint each.
    A NULL ``doc_id`` links like any other row; only a component without any id has a NULL ``component_id``. An empty table gives no
    rows; other columns are not read.
    """
    rows = stage(fingerprints(docs, words), "simhash-documents")
    classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    links = fingerprint_links(classes, probe_plan(classes, distance), distance)
    labels = stage(components(links), "simhash-labels")
    named = labels.join(classes.select(F.col("fp").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("size"))
    led = lookup_by_key(labels, named, ["component"], "size", SPREAD_ROWS)  # one component may hold a large part of all classes
    of_class = classes.join(led, F.col("fp") == F.col("node"), "left")
    table = of_class.select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), "n")
    met = lookup_by_key(rows, table, ["fp"], "n")
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
