import pytest
from pyspark.sql import functions as F

from foldguard import session
from foldguard.sources import readers, writers


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_bytes("﻿key,value,none_col\n1,NA,none\n2,,x\n".encode("utf-8"))
    df, absent = readers.read_raw_csv(spark, str(path), ["value", "key", "value", "gone"])
    assert df.columns == ["value", "key"] and absent == ["gone"]
    assert all(t == "string" for _, t in df.dtypes)
    full, _ = readers.read_raw_csv(spark, str(path))
    rows = readers.with_null_tokens(full).orderBy("key").collect()
    assert [tuple(r) for r in rows] == [("1", None, "none"), ("2", None, "x")]


@pytest.mark.parametrize("fmt", writers.FORMATS)
def test_write_and_read(spark, tmp_path, fmt):
    writers.write_table(spark.range(10).withColumn("s", F.lit("a")), str(tmp_path / fmt), fmt, partition_by=["s"])
    assert spark.read.option("header", True).format(fmt).load(str(tmp_path / fmt)).count() == 10


def test_fingerprint_ignores_order_only(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    a = writers.fingerprint(df).first()
    assert a == writers.fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a != writers.fingerprint(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v")))).first()


def test_run_records_append(spark, tmp_path):
    path = str(tmp_path / "runs")
    for stage in ("clean", "features"):
        writers.append_run_record(spark, path, stage, 42, {"top_n": 15}, {"rows": 3}, {"t": spark.range(3)})
    rows = spark.read.parquet(path).orderBy("stage").collect()
    assert [r["stage"] for r in rows] == ["clean", "features"] and rows[0]["outputs"] == rows[1]["outputs"]


def test_metrics_document(spark, tmp_path):
    writers.write_metrics(spark, str(tmp_path / "m"), {"r2": 0.4, "best": "ridge"})
    assert spark.read.json(str(tmp_path / "m")).first().asDict() == {"r2": 0.4, "best": "ridge"}


def test_staging_uses_the_shared_folder(spark, tmp_path, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()
        sparkContext = spark.sparkContext

    assert session.staging_root(Session()) == str(tmp_path)
    assert session.new_location(Session(), "x").startswith(f"{tmp_path}/foldguard/")

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        session.staging_root(Cluster())


def test_spread_only_deals_out_small_scans(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert session.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == 8
    many = spark.range(0, 100, 1, 20)
    assert session.spread(many) is many
