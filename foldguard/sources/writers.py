"""Writers for tables, metric documents and run records."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


FORMATS = ("parquet", "csv", "json", "orc")
NULL_MARK = "<null>"


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> None:
    """Write in parallel, one file per partition; splits and folds make good partition columns."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)


def write_metrics(spark: SparkSession, path: str, metrics: Mapping[str, object]) -> None:
    """One metrics document."""
    spark.createDataFrame([(json.dumps(metrics, sort_keys=True),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def row_bucket(columns: Sequence[str]):
    """32 bits of the md5 of a row's values."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(NULL_MARK)) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and an order-insensitive content sum; equal tables have equal fingerprints."""
    bucket = row_bucket(columns or df.columns).cast(T.DecimalType(20, 0))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(bucket), F.lit(0).cast(T.DecimalType(30, 0))).cast("string").alias("content_sum"),
    )


def append_run_record(
    spark: SparkSession, path: str, stage: str, seed: int, params: Mapping, metrics: Mapping,
    outputs: Mapping[str, DataFrame] = {},
) -> None:
    """Append one row per run: what ran, with which parameters, and what came out."""
    prints = {name: fingerprint(df).first().asDict() for name, df in outputs.items()}
    row = (stage, seed, json.dumps(params, sort_keys=True), json.dumps(metrics, sort_keys=True), json.dumps(prints, sort_keys=True))
    record = spark.createDataFrame([row], "stage string, seed int, params string, metrics string, outputs string")
    record.withColumn("written_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


