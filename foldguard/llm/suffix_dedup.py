"""Removal of passages that an earlier document has, by sorting suffixes.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller id goes.

1. Whole copies need no sorting: all but the first of equal texts are removed in full (from ``length`` bytes on).
2. Suffixes are split over tasks by their anchor, the k-gram with the smallest hash in their first ``length`` bytes: suffixes
   that agree that far have the same anchor. Neighbouring suffixes mostly share one, so they travel together as one
   segment of the text. Anchors that only one document has are found first, by their hashes, and their suffixes stay home.
3. Equal segments are merged with the smallest id before they are sorted, so a passage that a third of all documents
   share is one row for each of its segments. Deep-shallow sorting orders the suffixes of an anchor's segments; those that
   agree in ``length`` bytes are neighbours, and the smallest id among them decides.
4. What is covered comes back as byte ranges, which are merged and cut out.

An anchor with more than ``HOT_SEGMENTS`` different segments is taken apart once more, by the suffixes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .base import id_and_text, runs, shuffle_parts
from .suffix_sort import sort_suffixes

HOT_SEGMENTS = 100_000
BLOCK_BYTES = 2_000_000  # longer texts are anchored in overlapping blocks
TOGETHER_BYTES = 120_000  # shorter ones are anchored together, in arrays that stay in the cache
BATCH_SEGMENTS = 20_000


@dataclass(frozen=True)
class Passages:
    length: int = 50
    gram: int = 20

    @property
    def grams(self) -> int:
        """K-grams in a string of ``length`` bytes."""
        return self.length - self.gram + 1


def _power(n: int) -> np.uint64:
    return np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes, put together from runs of 1, 2, 4, … bytes."""
    spread = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)
    part, size, out, done = spread[data], 1, None, 0
    while True:
        if gram & size:
            n = len(data) - gram + 1
            piece = part[done : done + n]
            out = piece if out is None else out * _power(size) + piece
            done += size
        if 2 * size > gram:
            break
        part = part[:-size] * _power(size) + part[size:]
        size *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(32))


def segments(texts: list[bytes], rule: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring suffixes with one anchor: text number, first suffix, number of suffixes, hash of the anchor."""
    found = []
    bounds = [(i, at, t[at : at + BLOCK_BYTES + rule.length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - rule.length + 1), BLOCK_BYTES)]
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for entry in bounds:
        if held and total + len(entry[2]) > TOGETHER_BYTES:
            found.append(_segments_of(held, rule))
            held, total = [], 0
        held.append(entry)
        total += len(entry[2])
    if held:
        found.append(_segments_of(held, rule))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


def _segments_of(blocks: list[tuple[int, int, bytes]], rule: Passages) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(b for _, _, b in blocks), np.uint8)
    n = len(data) - rule.length + 1
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64))
    hashes = _gram_hashes(data, rule.gram)
    # The smallest hash of each string, the rightmost of equals: the place is kept in the low bits.
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    reach, width = least, 1
    while 2 * width <= rule.grams:
        reach = np.minimum(reach[:-width], reach[width:])
        width *= 2
    rest = rule.grams - width
    least = np.minimum(reach[:n], reach[rest : rest + n])
    anchor = (low - (least & low)).astype(np.int64)
    sizes = np.array([len(b) for _, _, b in blocks])
    block = np.repeat(np.arange(len(blocks)), sizes)
    valid = block[:n] == block[rule.length - 1 :]
    head = np.ones(n, bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (block[1:n] != block[: n - 1])
    first = np.flatnonzero(head & valid)
    edge = np.flatnonzero(head | ~valid)
    end = np.append(edge, n)[np.searchsorted(edge, first, side="right")]
    offset = np.cumsum(sizes) - sizes
    own = block[first]
    text_of, at = np.array([i for i, _, _ in blocks]), np.array([a for _, a, _ in blocks])
    return text_of[own], first - offset[own] + at[own], end - first, hashes[anchor[first]]


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _content(b: bytes) -> int:
    return xxhash.xxh64_intdigest(b) - (1 << 63)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        texts = _bytes(batch)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                batch.column("content"),
            ],
            ["doc_id", "n_bytes", "sha", "content"],
        )


def _anchors(rule: Passages):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            text, _, _, anchor = segments(_bytes(batch), rule)
            ids = np.asarray(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([_signed(anchor), pa.array(ids[text])], ["anchor", "doc_id"])

    return make


def _of_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, those of anchors that more than one id has; rows in a row that say the same are one."""
    carried = np.zeros((2, 0), np.int64)  # a row of the anchor at hand: its anchor and id
    sent = False  # whether it has been passed on, as one of several
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, d = (np.append(carried[i], np.asarray(batch.column(i))) for i in range(2))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        a, d = a[new], d[new]
        heads = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        several = np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)
        several[0] |= sent
        keep = np.repeat(several, np.diff(heads, append=len(a)))
        if sent:
            keep[0] = False
        carried, sent = np.array([a[-1:], d[-1:]]), bool(several[-1])
        yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(d[keep], pa.int64())], ["anchor", "doc_id"])


def _shared_segments(rule: Passages):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            texts, ids = _bytes(batch), np.asarray(batch.column("doc_id"))
            text, start, count, anchor = segments(texts, rule)
            wanted = batch.column("anchors")
            owners = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.list_value_length(wanted)))
            signed = anchor.astype(np.uint64).view(np.int64)
            # Text and anchor as one number; an accidental match would only be sorted for nothing.
            spread = np.int64(0x9E3779B97F4A7C1)
            keep = pa.compute.is_in(pa.array(signed * spread + text), pa.array(np.asarray(wanted.flatten()) * spread + owners)).to_numpy(zero_copy_only=False)
            text, start, count, signed = text[keep], start[keep], count[keep], signed[keep]
            rows = [texts[t][s : s + c + rule.length - 1] for t, s, c in zip(text.tolist(), start.tolist(), count.tolist(), strict=True)]
            content = np.asarray(batch.column("content"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed), pa.array([_content(r) for r in rows], pa.int64()), pa.array(rows, pa.binary()), pa.array(ids[text]),
                    pa.array(content[text]), pa.array(start), pa.array(count),
                ],
                ["anchor", "segment", "bytes", "doc_id", "content", "start", "count"],
            )

    return make


def smallest_ids(groups: np.ndarray, rows: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes of all segments, one after another, the smallest id whose segments of the same group have that suffix;
    the number of suffixes of each segment."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    counts = sizes - length + 1
    text = np.frombuffer(b"".join(rows), np.uint8)
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[owner] + inside
    order, cls = sort_suffixes(text, starts, groups[owner], length)
    least = np.full(len(starts), np.iinfo(np.int64).max)
    np.minimum.at(least, cls, ids[owner])
    return least[cls], counts


def _resolved(rule: Passages):
    """From different segments sorted by anchor, the smallest id of each of their suffixes; one number if it is the same for all."""

    names = ["anchor", "segment", "least"]

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """All segments of some anchors."""
        anchors, first = rows.column("anchor").to_numpy(), rows.column("first_id").to_numpy()
        alone = np.ones(len(anchors), bool)
        alone[1:] &= anchors[1:] != anchors[:-1]
        alone[:-1] &= anchors[1:] != anchors[:-1]
        segment = rows.column("segment").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchors[alone]), pa.array(segment[alone]), pa.ListArray.from_arrays(pa.array(np.arange(alone.sum() + 1), pa.int32()), pa.array(first[alone]))], names
        )
        many = np.flatnonzero(~alone)
        if len(many):
            found, counts = smallest_ids(anchors[many], rows.column("bytes").take(pa.array(many)).to_numpy().tolist(), first[many], rule.length)
            begin = np.cumsum(counts) - counts
            one = np.minimum.reduceat(found, begin) == np.maximum.reduceat(found, begin)
            keep = np.repeat(~one, counts)
            keep[begin] = True
            ends = np.append(0, np.cumsum(np.where(one, 1, counts)))
            least = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(anchors[many]), pa.array(segment[many]), least], names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH_SEGMENTS:
                continue
            rows = pa.Table.from_batches(held)
            anchors = rows.column("anchor").to_numpy()
            ready = int(np.searchsorted(anchors, anchors[-1]))  # the last anchor may go on in the next batch
            if ready:
                yield from settle(rows.slice(0, ready))
                held = rows.slice(ready).combine_chunks().to_batches()
        if held and (rows := pa.Table.from_batches(held)).num_rows:
            yield from settle(rows)

    return make


def _spans(rule: Passages):
    """Byte ranges that a document's segments cover; ``least`` has one number for all suffixes or one for each."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, content, start, count = (np.asarray(batch.column(c)) for c in ("doc_id", "content", "start", "count"))
            least = batch.column("least")
            sizes, values = np.asarray(pa.compute.list_value_length(least)), np.asarray(least.flatten())
            first = np.cumsum(sizes) - sizes
            one = np.flatnonzero((sizes == 1) & (values[first] < doc_id))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (doc_id[one], content[one], start[one], start[one] + count[one] + rule.length - 1)], ["doc_id", "content", "at", "to"]
            )
            # Segments whose suffixes differ: runs of covered suffixes, all segments at once.
            several = np.flatnonzero(sizes > 1)
            if len(several):
                row = np.repeat(several, sizes[several])
                inside = np.arange(len(row)) - np.repeat(np.cumsum(sizes[several]) - sizes[several], sizes[several])
                covered = values[first[row] + inside] < doc_id[row]
                before, after = np.zeros(len(row), bool), np.zeros(len(row), bool)
                before[1:] = covered[:-1] & (row[1:] == row[:-1])
                after[:-1] = covered[1:] & (row[1:] == row[:-1])
                opens, closes = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
                of = row[opens]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (doc_id[of], content[of], start[of] + inside[opens], start[of] + inside[closes] + rule.length)],
                    ["doc_id", "content", "at", "to"],
                )

    return make


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        out: list[list] = [[] for _ in range(6)]
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "content", "spans"))
        for doc_id, content, spans, text in zip(*columns, _bytes(batch), strict=True):
            kept, end, pieces, n_spans, removed = 0, -1, [], 0, 0
            for span in sorted((s["at"], s["to"]) for s in spans or []):
                if span[0] > end:  # ranges that touch are one
                    pieces.append(text[kept : span[0]])
                    n_spans += 1
                    removed += span[1] - span[0]
                    end = kept = span[1]
                elif span[1] > end:
                    removed += span[1] - end
                    end = kept = span[1]
            pieces.append(text[kept:])
            whole = b"".join(pieces)
            for column, value in zip(out, (doc_id, content, removed, n_spans, hashlib.sha256(whole).hexdigest(), whole), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ["cut_id", "cut_content", "n_removed", "n_spans", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def _hot_least(hot: DataFrame, rule: Passages) -> DataFrame:
    """``anchor, segment, least`` of segments of anchors that have very many: suffix by suffix, merged before the shuffle."""
    place = F.explode(F.sequence(F.lit(0), F.length("bytes") - rule.length))
    suffixes = hot.select("anchor", "segment", "first_id", "bytes", place.alias("i")).withColumn("suffix", F.substring("bytes", F.col("i") + 1, F.lit(rule.length)))
    least = suffixes.groupBy("suffix").agg(F.min("first_id").alias("id"))
    met = suffixes.select("anchor", "segment", "i", "suffix").join(least, "suffix")
    ordered = F.array_sort(F.collect_list(F.struct("i", "id")))
    return met.groupBy("anchor", "segment").agg(F.transform(ordered, lambda x: x["id"]).alias("least"))


def suffix_dedup(docs: DataFrame, rule: Passages = Passages(), with_kept: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, on demand ``kept`` (the bytes that stay; NULL
    where nothing was removed).

    Texts are UTF-8 bytes; a null text is empty. Matches never cross documents and are judged on the input. Texts shorter
    than ``rule.length`` lose nothing. Rows that repeat an id do not remove from each other; a NULL id neither removes nor
    loses. Removed ranges that touch are one span. An empty table gives no rows; other columns are not read.
    """
    parts = shuffle_parts(docs)
    texts = id_and_text(docs)
    texts = texts.withColumn("content", F.xxhash64("text"))  # tells texts that share an id apart
    described = stage(texts.mapInArrow(_described, "doc_id bigint, n_bytes bigint, sha string, content bigint"), "passage-documents")
    usable = described.filter((F.col("n_bytes") >= rule.length) & F.col("doc_id").isNotNull())
    firsts = stage(usable.groupBy("sha", "n_bytes").agg(F.min("doc_id").alias("first_id")).drop("n_bytes"), "passage-firsts")
    originals = texts.join(firsts.select(F.col("first_id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    originals = stage(originals.filter(F.octet_length("text") >= rule.length), "passage-originals")

    anchors = originals.mapInArrow(_anchors(rule), "anchor bigint, doc_id bigint")
    shared = stage(
        anchors.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_of_several, "anchor bigint, doc_id bigint"), "passage-anchors"
    )
    per_document = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))  # at most one for each byte
    kinds = "anchor bigint, segment bigint, bytes binary, doc_id bigint, content bigint, start bigint, count bigint"
    grams = stage(originals.join(per_document.hint("shuffle_hash"), "doc_id").mapInArrow(_shared_segments(rule), kinds), "passage-segments")

    unstage(shared)
    different = grams.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first_id"), F.min("bytes").alias("bytes"))
    different = stage(different, "passage-different")
    sizes = different.groupBy("anchor").count().filter(F.col("count") > HOT_SEGMENTS).select("anchor")
    sizes = stage(sizes, "passage-hot")
    cold = different.join(sizes, "anchor", "left_anti")
    sorted_rows = cold.select("anchor", "segment", "bytes", "first_id").repartition(parts, "anchor").sortWithinPartitions("anchor", "segment")
    least = sorted_rows.mapInArrow(_resolved(rule), "anchor bigint, segment bigint, least array<bigint>")
    least = least.unionByName(_hot_least(different.join(sizes, "anchor", "left_semi"), rule))
    met = grams.select("anchor", "segment", "doc_id", "content", "start", "count").join(least, ["anchor", "segment"])
    spans = stage(met.mapInArrow(_spans(rule), "doc_id bigint, content bigint, at bigint, to bigint"), "passage-spans")

    unstage(different)
    unstage(grams)
    per_text = spans.groupBy("doc_id", "content").agg(F.collect_list(F.struct("at", "to")).alias("spans"))  # at most one for each byte
    kinds = "cut_id bigint, cut_content bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    cut = originals.join(per_text.hint("shuffle_hash"), ["doc_id", "content"]).mapInArrow(_cut, kinds)
    cut = stage((cut if with_kept else cut.drop("kept")).dropDuplicates(["cut_id", "cut_content"]), "passage-cut")

    first_of = described.join(firsts.withColumnRenamed("sha", "first_sha"), F.col("sha") == F.col("first_sha"), "left")
    copy = F.col("first_id") < F.col("doc_id")
    joined = first_of.join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("content") == F.col("cut_content")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = joined.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
    return out
