"""Best-fit packing of tokenised documents, with bounds that certify it.

Documents are cut into pieces of at most ``capacity`` tokens; full pieces are sequences by themselves, the others are
packed. They are dealt by hash to units of about ``UNIT_ROWS`` pieces, and every unit packs its own by best-fit decreasing. A
dual-feasible function maps lengths to numbers whose sum in any sequence is at most 1, so the sum over a unit's pieces,
rounded up, is a lower bound for its sequences. A unit that reaches its bound is certified and final. The others
give the pieces of their unfilled sequences back; these are dealt anew, to fewer units, and packed again.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import reduce
from itertools import chain, compress, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import id_and_text, lent, runs
from .tokens import Remembered, distinct_pieces, vocabulary_path

CAPACITY = 1024
END_ID = 2  # ends every document
UNIT_ROWS = 20_000
REMEMBERED_IDS = 1_200_000  # pieces of text whose ids a worker keeps in a task ...
KEPT_IDS = 100_000  # ... and from one task to the next
TOGETHER = 32  # new pieces that are encoded as one text

_PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PACKED = f"{_PIECES}, unit bigint, bin bigint, offset bigint, open boolean, gap boolean"

_ENCODERS: dict[str, Remembered] = {}


def _encoder(path: str) -> Remembered:
    """Ids of pieces of text as little-endian unsigned 32-bit numbers."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        vocabulary = tokenizer.get_vocab()
        spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        spaced[[i for token, i in vocabulary.items() if token.startswith((" ", "Ġ"))]] = True

        def encode(texts: list[str]) -> list[array]:
            return [array("I", c.ids) for c in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        def stored(ids: array) -> bytes:
            if sys.byteorder == "big":
                ids.byteswap()
            return ids.tobytes()

        def solve_some(new: list[str]) -> list[bytes]:
            # Pieces whose only space is the first character, put together, are cut where a token begins with a space.
            spaces = [p.rfind(" ") == 0 and not p[-1].isspace() for p in new]
            words, others = list(compress(new, spaces)), [p for p, s in zip(new, spaces, strict=True) if not s]
            ids = array("I")
            for some in encode(["".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]):
                ids += some
            at = (4 * np.flatnonzero(spaced[np.frombuffer(ids, np.uint32)])).tolist()
            if len(at) == len(words):
                raw = stored(ids)
                found = [raw[a:b] for a, b in pairwise([*at, len(raw)])]
            else:  # a vocabulary whose tokens hold spaces elsewhere
                found = map(stored, encode(words))
            if not others:
                return found
            found, rest = iter(found), map(stored, encode(others))
            return [next(found if s else rest) for s in spaces]

        def solve(new: list[str]) -> list[bytes]:
            return list(chain.from_iterable(solve_some(new[i : i + 20_000]) for i in range(0, len(new), 20_000)))

        _ENCODERS[path] = Remembered(solve, REMEMBERED_IDS)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``uid, doc_id, piece, start, length, ids_crc32``, on demand ``ids``.

    A document is the ids of its text and ``end_id``. Only the first piece may be shorter than ``capacity``. A null or empty
    text is one piece that holds ``end_id`` alone. ``uid`` tells pieces apart where rows repeat; it follows the
    placement of rows, so write the result before it is read twice.
    """
    path = path or vocabulary_path()

    @lent
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, end = _encoder(path), np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << 36
        for batch in runs(batches):
            words, places, sizes = distinct_pieces(batch.column("text"))
            found = known.results(words)
            bounds = np.zeros(len(found) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // 4, out=bounds[1:])
            by_word = pa.LargeListArray.from_arrays(bounds, np.frombuffer(b"".join(found), np.uint32))
            ids = by_word.take(places).flatten().to_numpy(zero_copy_only=False).tobytes()
            ends = np.append(0, np.cumsum(np.diff(bounds)[np.asarray(places)]))[np.cumsum(sizes)].tolist()
            out: list[list] = [[] for _ in range(7)]
            for doc_id, first, last in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
                n = last - first + 1
                at = 0
                for number in range(-(-n // capacity)):
                    to = at + (n - at - 1) % capacity + 1
                    own = ids[4 * (first + at) : 4 * min(first + to, last)] + (end if to == n else b"")
                    for column, value in zip(out, (uid, doc_id, number, at, to - at, zlib.crc32(own), own), strict=True):
                        column.append(value)
                    at, uid = to, uid + 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=False)]
            names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[6]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        known.keep_first(KEPT_IDS)

    return id_and_text(docs).mapInArrow(cut, _PIECES + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that pieces of these lengths need at least, by two families of dual-feasible functions."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length, 0 to the capacity."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    total, pairs = count * size, capacity * count
    sums = [int(total.sum())]
    upward = np.cumsum(total)
    many = np.cumsum(pairs)
    for cut in range(1, capacity // 2 + 1):
        # Longer than capacity - cut counts as whole, shorter than cut as nothing, the rest as it is.
        sums.append(int(many[-1] - many[capacity - cut] + upward[capacity - cut] - upward[cut - 1]))
    best = max(-(-s // capacity) for s in sums)
    for k in range(1, 20):
        steps = (k + 1) * size
        # Counted in units of 1 / (k * capacity): whole multiples keep their size, the rest is rounded down to steps of 1 / k.
        value = np.where(steps % capacity == 0, k * size, steps // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each piece, and what stays free in each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        need = int(lengths[i])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        free[b] = left
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def pack(parts: DataFrame, capacity: int = CAPACITY, unit_rows: int = UNIT_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``parts`` comes from ``token_pieces`` and is written already.

    Units that miss their bound give the pieces of sequences with room to the next round, which deals them to other units. Rounds go on as
    long as they save a sequence; one that saves none is undone. ``certified`` tells whether the sequence belongs
    to a unit that reached its lower bound. Ties between equal lengths go by the order of ``uid``. An empty table gives no rows.
    """

    def pack_unit(unit: pd.DataFrame) -> pd.DataFrame:
        unit = unit.sort_values("uid", ignore_index=True)
        lengths = unit["length"].to_numpy()
        bins, offsets, free = best_fit(lengths, capacity)
        gap = len(free) > lower_bound(lengths, capacity)
        return unit.assign(bin=bins, offset=offsets, open=gap & (free[bins] > 0), gap=gap)

    full = parts.filter(F.col("length") == capacity).select(
        *parts.columns, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("certified")
    )
    counted = [F.count(F.lit(1)).alias("rows"), F.sum((F.col("offset") == 0).cast("int")).alias("sequences")]
    done, rest = [full], parts.filter(F.col("length") < capacity)
    number, before, last, turn = rest.count(), None, None, 0
    while number:
        units = max(1, round(number / unit_rows))
        dealt = rest.select(*parts.columns, F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(units)).alias("unit"))
        packed = stage(dealt.groupBy("unit").applyInPandas(pack_unit, _PACKED), "packed")
        sequence = F.lit(turn << 56) + F.shiftleft(F.col("unit"), 28) + F.col("bin")
        named = packed.select(*parts.columns, sequence.alias("sequence_id"), "offset", (~F.col("gap")).alias("certified"), "open")
        now = {r.open: r for r in named.groupBy("open").agg(*counted).collect()}
        if before is not None and sum(r.sequences for r in now.values()) >= before:
            break  # nothing saved: the sequences that the round before left open stay
        left = now.get(True)
        done.append(named.filter("NOT open").drop("open"))
        last = rest = named.filter("open").drop("open")
        number, before, turn = (left.rows, left.sequences, turn + 1) if left else (0, None, turn)
        if left is None:
            last = None
        if units == 1:
            break
    if last is not None:
        done.append(last)
    return reduce(DataFrame.unionByName, done)


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``sequences``, the ``bound`` that no packing of these pieces goes below, and the ``gap`` between them."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most one row per length
        counts[r.length] = r.n
    bound = bound_of_counts(counts, capacity)
    used = packed.agg(F.sum((F.col("offset") == 0).cast("bigint")).alias("sequences"))
    return used.select(F.coalesce("sequences", F.lit(0)).alias("sequences"), F.lit(bound).cast("bigint").alias("bound")).withColumn("gap", F.col("sequences") - F.col("bound"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified`` for every piece of every document.

    Rows that repeat a document are packed each by itself; a NULL ``doc_id`` is packed like any other. Other columns are
    not read. See ``token_pieces`` for null and empty texts and ``pack`` for ties.
    """
    parts = stage(token_pieces(docs, capacity, path=path), "pieces")
    return pack(parts, capacity).drop("uid")
