"""Readers: explicit schemas, tolerant projections, null tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ordered_unique
from ..functions.text import NULL_TOKENS, null_tokens_to_null


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text: the raw table is cast later, with a reason for each bad row."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_reader(spark: SparkSession, line_breaks: bool = False) -> DataFrameReader:
    """Options for quoted fields: doubled quotes are one quote; with ``line_breaks`` a quoted field may hold line breaks."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
    return reader.option("multiLine", line_breaks)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file from its first line (no inference pass over the data)."""
    return csv_reader(spark).csv(path).columns


def read_raw_csv(
    spark: SparkSession, path: str, wanted: Sequence[str] | None = None, line_breaks: bool = False
) -> tuple[DataFrame, list[str]]:
    """A wide CSV (a byte order mark is allowed) cut to the wanted columns.

    Returns the table and the wanted columns it lacks.  The reader parses only the
    columns that are kept.  ``line_breaks`` allows them inside quoted fields; a file is then
    read by one task, so large tables should come in many files.
    """
    names = [c.lstrip("\ufeff") for c in csv_header(spark, path)]
    raw = csv_reader(spark, line_breaks).schema(text_schema(names)).csv(path)
    return project_present(raw, wanted if wanted is not None else names)


def project_present(df: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Wanted columns in the wanted order, each once; absent ones are reported, not an error."""
    names = ordered_unique(wanted)
    return df.select(*[c for c in names if c in df.columns]), [c for c in names if c not in df.columns]


def select_where(df: DataFrame, keep: Callable[[str], bool]) -> DataFrame:
    """Column selection by predicate; only these columns are read."""
    return df.select(*[c for c in df.columns if keep(c)])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def with_null_tokens(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Turn null words into NULL in every text column (``none`` is a word of its own)."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_tokens_to_null(F.col(c), tokens) for c in texts})
