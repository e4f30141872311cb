"""Session defaults and the one place where intermediate results are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"

_local_roots: dict[str, str] = {}


def local_session(app: str = "foldguard", cores: int | str = "*", **conf: str) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    A temporary folder is made only where the setting is absent and the session runs
    in one local JVM; on a cluster a machine-local folder would be lost with its
    machine, so there the missing setting is an error.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="foldguard-")
    return _local_roots[app]


def new_location(spark: SparkSession, label: str) -> str:
    """A fresh path below the staging root."""
    app = spark.sparkContext.applicationId
    return f"{staging_root(spark)}/foldguard/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage", settings: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` once, under these settings of the session, and go on from the written table.

    Used where a value depends on how rows were placed (partition numbers, positions):
    a lost executor must not make Spark place them differently a second time.  The
    parquet copy also gives later joins true sizes and keeps column pruning.
    """
    spark = df.sparkSession
    path = new_location(spark, label)
    wanted = {CLEANUP_CONF: "true", **(settings or {})}  # its shuffle files are not needed once it is written
    before = {name: spark.conf.get(name, "false") if name == CLEANUP_CONF else spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def unstage(staged: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing reads it any more."""
    spark = staged.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in staged.inputFiles()}
    for folder in folders:
        if "/foldguard/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def importable(df: DataFrame) -> DataFrame:
    """``df``; Python workers started from now on find this package where it lies now, or else where it is installed."""
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    return df


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a file scan to all cores where its files give fewer tasks than cores.

    For inputs of a few row groups in front of work that is heavy per row; a large table
    has more splits than cores and passes through untouched.  ``scan`` must not shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def release_staged(spark: SparkSession) -> None:
    """Delete the tables that this application staged (call when its results are written)."""
    root = f"{staging_root(spark)}/foldguard/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
