"""Exact deduplication by content sort.

Texts are equal when they are identical after their blanks (space, tab, line breaks) are deleted. The normalised bytes are
range-partitioned by sampled splitters, every partition is sorted by Spark's external sort, which puts equal texts
next to each other, and one pass compares each text in full with its neighbour.

* Splitters are chosen on the first bytes, a 128-bit digest, the length and the id, so the sample that Spark takes is of
  bounded size however long texts are, and a group of copies that holds a third of all rows is cut over as many
  partitions as it fills.
* A group that crosses partitions has a part in each. Each partition reports its first and last group only (two rows);
  these are merged and looked up again, the rest never leaves its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import BLANK_BYTES, id_and_text, lent, runs, shuffle_parts

HEAD_BYTES = 16  # of the normalised text, as the leading part of the sort key

_NORMAL = "doc_id bigint, n_cp bigint, head binary, digest binary, body binary"
_LOCAL = "doc_id bigint, sha string, size bigint, best_cp bigint, best_id bigint, first boolean, part int, edge boolean"


@lent
def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in runs(batches):
        texts = batch.column("text").to_pylist()
        bodies = [t.encode("utf-8", "surrogatepass").translate(None, BLANK_BYTES) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([b[:HEAD_BYTES] for b in bodies], pa.binary()),
                pa.array([xxhash.xxh3_128_digest(b) for b in bodies], pa.binary()),
                pa.array(bodies, pa.binary()),
            ],
            ["doc_id", "n_cp", "head", "digest", "body"],
        )


class _Group:
    """Rows of one text that follow each other; the first row is the best one of the part."""

    def __init__(self, body: bytes, n_cp: int, doc_id: int):
        self.body, self.n_cp, self.best, self.ids = body, n_cp, doc_id, []


@lent
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["doc_id", "sha", "size", "best_cp", "best_id", "first", "part", "edge"]

    def rows(group: _Group, edge: bool) -> list[pa.Array]:
        n, sha = len(group.ids), hashlib.sha256(group.body).hexdigest()
        return [
            pa.array(group.ids, pa.int64()), pa.array([sha] * n), pa.array([n] * n, pa.int64()),
            pa.array([group.n_cp] * n, pa.int64()), pa.array([group.best] * n, pa.int64()),
            pa.array([True] + [False] * (n - 1)), pa.array([part] * n, pa.int32()), pa.array([edge] * n),
        ]

    def batch_of(groups: list[tuple[_Group, bool]]) -> pa.RecordBatch:
        columns = zip(*(rows(g, e) for g, e in groups), strict=True)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names)

    group, at_start, done, held = None, True, [], 0
    for batch in batches:
        ids, cps = batch.column("doc_id").to_pylist(), batch.column("n_cp").to_pylist()
        for doc_id, n_cp, body in zip(ids, cps, batch.column("body"), strict=True):
            body = body.as_py()
            if group is None or body != group.body:
                if group is not None:
                    done.append((group, at_start))
                    held += len(group.ids)
                    at_start = False
                    if held > 5_000:
                        yield batch_of(done)
                        done, held = [], 0
                group = _Group(body, n_cp, doc_id)
            group.ids.append(doc_id)
    if group is not None:
        done.append((group, True))
        yield batch_of(done)


def exact_dedup(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points before normalisation stays, then the smallest ``doc_id``.
    Null texts count as empty and are one group with blank texts. A NULL ``doc_id`` sorts last and is kept only if all
    ids of its group are NULL. Of rows that repeat a ``doc_id`` with an equal text, one is kept. An empty table gives
    no rows; other columns of ``docs`` are not read.
    """
    n = partitions or shuffle_parts(docs)
    normal = id_and_text(docs).mapInArrow(_normalise, _NORMAL)
    last = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    order = [F.col("head"), F.col("digest"), F.col("body"), F.col("n_cp").desc(), last.asc()]
    split = [o for i, o in enumerate(order) if i != 2]
    compared = normal.repartitionByRange(n, *split).sortWithinPartitions(*order).mapInArrow(_compare, _LOCAL)
    local = stage(compared, "exact-dedup")  # positions depend on sampled splitters: fixed once, here

    parts = local.filter("edge AND first").select("sha", "size", "best_cp", "best_id", "part")
    better = F.struct(-F.col("best_cp"), F.coalesce(F.col("best_id"), F.lit((1 << 63) - 1)), F.col("part"))
    whole = parts.groupBy(F.col("sha").alias("all_sha")).agg(
        F.sum("size").alias("all_size"), F.min_by("best_id", better).alias("all_id"), F.min_by("part", better).alias("all_part")
    )
    # ``whole`` has at most two rows for each sort partition.
    joined = local.join(F.broadcast(whole), (F.col("sha") == F.col("all_sha")) & F.col("edge"), "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("best_id")).otherwise(F.col("all_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & (F.coalesce("all_part", "part") == F.col("part"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without its exact copies, all columns kept, whatever their names."""
    result = stage(exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "exact-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    same_id = F.col("row.doc_id").eqNullSafe(F.col("kept_id"))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.select(row).join(result, same_id, "left_semi").select("row.*")
    # Rows that share an id are told apart by their texts.
    body = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]", ""), 256)
    one = docs.select(F.col("doc_id").alias("id"), body.alias("body"), row).dropDuplicates(["id", "body"])
    return one.join(result, same_id & (F.col("body") == F.col("kept_sha")), "left_semi").select("row.*")
