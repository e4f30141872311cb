"""The query registry and the inputs that several queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import md5_bucket
from ..session import spread, stage
from ..sources.readers import read_table

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated function under its name; ``ids`` are the inventory lines it covers."""

    def register(build: Build) -> Build:
        if build.__name__ in REGISTRY:
            raise ValueError(f"query {build.__name__} exists already")
        REGISTRY[build.__name__] = Query(build.__name__, tuple(ids.split()), build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Round columns so that engines which add in another order still agree."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def int_text(c: str | Column) -> Column:
    """A number as integer text (engines print doubles differently)."""
    return (F.col(c) if isinstance(c, str) else c).cast("bigint").cast("string")


def decimal_text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)").cast("string")


def sql_bucket(seed: object, expr: str) -> str:
    """SQL twin of ``md5_bucket``."""
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({expr} AS VARCHAR)), 1, 8))::UBIGINT AS BIGINT)"


def sql_draw(seed: object, expr: str) -> str:
    """SQL twin of ``seeded_md5``."""
    return f"md5('{seed}|' || CAST({expr} AS VARCHAR))"


# --- predictions: y = price of a line, p = quantity times list price, group = supplier -----

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y"]
TEST_CUT = 858993459  # floor(0.2 * 2**32)
HALF_CUT = 2147483648


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a truth and a prediction; the key columns identify a row."""
    line = spread(table(spark, sf_dir, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.col("l_extendedprice").alias("y"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return line.join(part, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "y",
        (F.col("l_quantity") * F.col("p_retailprice")).alias("p"),
    )


PRED = """
pred AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS y, l_quantity * p_retailprice AS p
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

PRED_SPLIT = f"""{PRED},
sided AS (
  SELECT *, CASE WHEN {sql_bucket(42, 'l_suppkey')} < {TEST_CUT} THEN 'test' ELSE 'train' END AS split,
         CAST({sql_bucket(42, 'l_suppkey')} % 5 AS INTEGER) AS fold
  FROM pred
)"""


def calibration_and_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The holdout side of the predictions, halved once more by supplier."""
    held = predictions(spark, sf_dir).filter(md5_bucket(42, F.col("l_suppkey")) < TEST_CUT)
    held = stage(held, "holdout")  # widths, edges and coverages each read it
    side = md5_bucket(7, F.col("l_suppkey")) < HALF_CUT
    return held.filter(~side), held.filter(side)


HELD = f"""{PRED},
held AS (
  SELECT *, abs(y - p) AS e, {sql_bucket(7, 'l_suppkey')} < {HALF_CUT} AS is_test
  FROM pred WHERE {sql_bucket(42, 'l_suppkey')} < {TEST_CUT}
),
cal AS (SELECT * FROM held WHERE NOT is_test),
tst AS (SELECT * FROM held WHERE is_test)"""


# --- keys in several spellings -------------------------------------------------------------


def spelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a text key per customer, written differently here and there, sometimes absent."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    k = F.concat(F.lit("10.5555/cust."), F.col("o_custkey").cast("string"))
    some = F.pmod("o_custkey", F.lit(5)) == 0
    n = F.col("o_orderkey")
    raw = (
        F.when(F.pmod("o_custkey", F.lit(37)) == 0, F.lit(None))
        .when(some & (F.pmod(n, F.lit(7)) == 0), F.upper(k))
        .when(some & (F.pmod(n, F.lit(7)) == 1), F.concat(F.lit("  "), k, F.lit(" ")))
        .when(some & (F.pmod(n, F.lit(7)) == 2), F.concat(F.lit("https://doi.org/"), k))
        .when(some & (F.pmod(n, F.lit(7)) == 3), F.concat(F.lit("doi: "), k, F.lit("/")))
        .otherwise(k)
    )
    return o.withColumn("raw_key", raw)


SPELLED = r"""
spelled AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
    CASE WHEN o_custkey % 37 = 0 THEN NULL
         WHEN o_custkey % 5 = 0 AND o_orderkey % 7 = 0 THEN upper('10.5555/cust.' || o_custkey)
         WHEN o_custkey % 5 = 0 AND o_orderkey % 7 = 1 THEN '  10.5555/cust.' || o_custkey || ' '
         WHEN o_custkey % 5 = 0 AND o_orderkey % 7 = 2 THEN 'https://doi.org/10.5555/cust.' || o_custkey
         WHEN o_custkey % 5 = 0 AND o_orderkey % 7 = 3 THEN 'doi: 10.5555/cust.' || o_custkey || '/'
         ELSE '10.5555/cust.' || o_custkey END AS raw_key
  FROM orders
),
normed AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(trim(raw_key)),
      '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', ''), '[/.]+$', '') AS norm_key
  FROM spelled
)"""


# --- records with composition lists, numbers in text and flags -----------------------------

SITE_NAMES = {"A": ("FA", "MA", "Cs", "Rb", "K"), "B": ("Pb", "Sn", "Ge"), "X": ("I", "Br", "Cl")}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dressed as raw records: list columns, number texts, flag texts, a text target."""
    line = spread(table(spark, sf_dir, "lineitem"))
    n, q = F.col("l_orderkey"), F.col("l_quantity")
    a_names = (
        F.when(F.col("l_returnflag") == "A", F.lit("Cs; FA"))
        .when(F.col("l_returnflag") == "N", F.lit("FA; MA; FA"))
        .otherwise(F.lit("GU; MA"))
    )
    third = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("; "), int_text("l_linenumber"))).otherwise(F.lit(""))
    a_weights = (
        F.when(F.pmod(n, F.lit(41)) == 0, F.lit(None))
        .when(F.pmod(n, F.lit(43)) == 0, int_text(q))
        .when(F.pmod(n, F.lit(47)) == 0, F.concat(int_text(q), F.lit("; x"), third))
        .when(F.pmod(n, F.lit(53)) == 0, F.concat(F.lit("0; 0"), F.when(F.col("l_returnflag") == "N", F.lit("; 0")).otherwise(F.lit(""))))
        .otherwise(F.concat(int_text(q), F.lit("; "), int_text("l_linenumber"), third))
    )
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        a_names.alias("a_names"), a_weights.alias("a_weights"),
        F.when(F.col("l_linestatus") == "F", F.lit("Pb")).otherwise(F.lit("Pb; Sn")).alias("b_names"),
        F.when(F.col("l_linestatus") == "F", F.lit("1")).otherwise(F.lit("1; 1")).alias("b_weights"),
        F.lit("I; Br").alias("x_names"),
        F.concat(int_text("l_linenumber"), F.lit("; "), int_text(q)).alias("x_weights"),
        F.when(F.pmod(n, F.lit(29)) == 0, F.lit("n/a")).otherwise(decimal_text(q * F.lit(0.8))).alias("target"),
        F.when(F.pmod(n, F.lit(31)) == 0, F.lit("TRUE")).when(F.pmod(n, F.lit(31)) == 1, F.lit(None))
        .otherwise(F.lit("false")).alias("module_flag"),
        F.when(F.pmod(n, F.lit(3)) == 0, F.lit(None)).otherwise(F.col("l_tax")).alias("gap"),
        F.when(F.pmod(n, F.lit(4)) == 0, F.lit("RT")).when(F.pmod(n, F.lit(4)) == 1, F.concat(int_text(q), F.lit("-150 C")))
        .otherwise(F.concat(int_text(q), F.lit(" | "), int_text("l_linenumber"))).alias("temperature"),
    )


RECORDS = """
records AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE l_returnflag WHEN 'A' THEN 'Cs; FA' WHEN 'N' THEN 'FA; MA; FA' ELSE 'GU; MA' END AS a_names,
    CASE WHEN l_orderkey % 41 = 0 THEN NULL
         WHEN l_orderkey % 43 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
         WHEN l_orderkey % 47 = 0 THEN CAST(l_quantity AS BIGINT) || '; x' || CASE WHEN l_returnflag = 'N' THEN '; ' || l_linenumber ELSE '' END
         WHEN l_orderkey % 53 = 0 THEN '0; 0' || CASE WHEN l_returnflag = 'N' THEN '; 0' ELSE '' END
         ELSE CAST(l_quantity AS BIGINT) || '; ' || l_linenumber || CASE WHEN l_returnflag = 'N' THEN '; ' || l_linenumber ELSE '' END
    END AS a_weights,
    CASE WHEN l_linestatus = 'F' THEN 'Pb' ELSE 'Pb; Sn' END AS b_names,
    CASE WHEN l_linestatus = 'F' THEN '1' ELSE '1; 1' END AS b_weights,
    'I; Br' AS x_names,
    l_linenumber || '; ' || CAST(l_quantity AS BIGINT) AS x_weights,
    CASE WHEN l_orderkey % 29 = 0 THEN 'n/a' ELSE CAST(CAST(l_quantity * 0.8::DOUBLE AS DECIMAL(18,2)) AS VARCHAR) END AS target,
    CASE l_orderkey % 31 WHEN 0 THEN 'TRUE' WHEN 1 THEN NULL ELSE 'false' END AS module_flag,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS gap,
    CASE l_orderkey % 4 WHEN 0 THEN 'RT' WHEN 1 THEN CAST(l_quantity AS BIGINT) || '-150 C'
         ELSE CAST(l_quantity AS BIGINT) || ' | ' || l_linenumber END AS temperature,
    l_returnflag, l_linestatus, l_quantity
  FROM lineitem
),
parsed AS (
  SELECT *, list_filter(list_transform(string_split(a_weights, ';'), lambda x: trim(x)), lambda x: x <> '') AS wl,
         list_filter(list_transform(string_split(a_names, ';'), lambda x: trim(x)), lambda x: x <> '') AS nl,
         TRY_CAST(target AS DOUBLE) AS t
  FROM records
),
reasoned AS (
  SELECT *, CASE
      WHEN t IS NULL THEN 'pce_not_numeric'
      WHEN t < 0 OR t > 35 THEN 'pce_out_of_range'
      WHEN lower(coalesce(module_flag, '')) = 'true' THEN 'module_record'
      WHEN a_weights IS NULL THEN 'missing_ion_or_coef'
      WHEN len(wl) <> len(nl) THEN 'ion_coef_count_mismatch'
      WHEN len(list_filter(wl, lambda x: TRY_CAST(x AS DOUBLE) IS NULL)) > 0 THEN 'coef_not_numeric'
      WHEN list_sum(list_transform(wl, lambda x: TRY_CAST(x AS DOUBLE))) <= 0 THEN 'coef_total_not_positive'
    END AS reason
  FROM parsed
),
valid AS (
  SELECT *, list_transform(wl, lambda x: TRY_CAST(x AS DOUBLE)) AS w FROM reasoned WHERE reason IS NULL
),
shares AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t AS target, gap, temperature, module_flag,
    l_returnflag, l_linestatus,
    CASE l_returnflag WHEN 'A' THEN w[2] WHEN 'N' THEN w[1] + w[3] ELSE 0.0 END / list_sum(w) AS A_FA,
    CASE l_returnflag WHEN 'A' THEN 0.0 ELSE w[2] END / list_sum(w) AS A_MA,
    CASE l_returnflag WHEN 'A' THEN w[1] ELSE 0.0 END / list_sum(w) AS A_Cs,
    0.0::DOUBLE AS A_Rb, 0.0::DOUBLE AS A_K,
    CASE l_returnflag WHEN 'R' THEN w[1] ELSE 0.0 END / list_sum(w) AS A_other,
    CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS B_Pb,
    CASE WHEN l_linestatus = 'F' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS B_Sn,
    0.0::DOUBLE AS B_Ge, 0.0::DOUBLE AS B_other,
    l_linenumber / (l_linenumber + l_quantity) AS X_I,
    l_quantity / (l_linenumber + l_quantity) AS X_Br,
    0.0::DOUBLE AS X_Cl, 0.0::DOUBLE AS X_other
  FROM valid
)"""
