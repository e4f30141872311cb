"""What the operators share: inputs, word rules, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that parts words, as code points (space, tab, line feed, vertical tab, form feed, return).
BLANKS = " \t\n\x0b\x0c\r"
BLANK_BYTES = BLANKS.encode()

#: Texts of a batch are worked on in runs of about this many characters, so that the arrays stay small.
RUN_CHARS = 4_000_000
#: The same for operators that make several arrays of numbers for every word.
SHORT_RUN_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def reachable(df: DataFrame) -> DataFrame:
    """``df``; Python workers started from now on find this package where it lies now, or else where it is installed."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    return df


def id_and_text(docs: DataFrame, keep_null: bool = False) -> DataFrame:
    """The two columns an operator reads; other columns, whatever their names, are left behind."""
    reachable(docs)
    text = F.col("text") if keep_null else F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.cast("string").alias("text"))


def runs(batches: Iterator[pa.RecordBatch], size_of: str = "text", chars: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``chars`` characters; a longer text is a slice by itself."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = batch.column(size_of)
        if pa.types.is_string(sizes.type):
            sizes = sizes.cast(pa.large_string())
        elif pa.types.is_binary(sizes.type):
            sizes = sizes.cast(pa.large_binary())
        lengths = pa.compute.binary_length(sizes).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > chars:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)


def give_back() -> None:
    """What this process holds without using it goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # a C library without this call
        pass


def lent(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` that gives its memory back when a task ends: the worker lives on beside stages that need the memory elsewhere."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def shuffle_parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions (the one knob that a cluster sizes to its data)."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: str | Column) -> Column:
    """Words in the sense of ``BLANKS``, by built-in functions."""
    return F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
