"""Feature-building queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.composition import add_shares
from ..functions.hashing import md5_bucket
from ..operators import features as feat
from ..operators.cleaning import clean_rows
from ..operators.profile import missing_rates as rates
from .base import RECORDS, query, records, rounded, sql_bucket, table
from .cleaning import RECORD_KEY, RULES, SITES

HOLES = """
holes AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS cust
  FROM orders)"""


def holes(spark, sf_dir):
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n, F.when(F.pmod(n, F.lit(7)) != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.pmod(n, F.lit(5)) != 0, F.col("o_custkey").cast("double")).alias("cust"),
    )


@query("F2", f"""WITH {HOLES}
SELECT o_orderkey, coalesce(price, (SELECT round(median(price), 4) FROM holes)) AS price, coalesce(cust, (SELECT median(cust) FROM holes)) AS cust,
       CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_missing, CASE WHEN cust IS NULL THEN 1 ELSE 0 END AS cust_missing
FROM holes""")
def median_impute(spark, sf_dir):
    out = feat.median_impute(holes(spark, sf_dir), ["price", "cust"])
    return rounded(out, {"price": 4})


@query("A20", f"""WITH {HOLES}
SELECT 'price_missing' AS "column", round(avg(CASE WHEN price IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS missing_rate FROM holes
UNION ALL SELECT 'cust_missing', round(avg(CASE WHEN cust IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) FROM holes""")
def missing_rates(spark, sf_dir):
    flagged = feat.impute(holes(spark, sf_dir), {"price": 0.0, "cust": 0.0})
    return rounded(rates(flagged, ["price_missing", "cust_missing"]), {"missing_rate": 9})


_TOP_BRANDS = """
brands AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand),
bucketed AS (SELECT p_partkey, CASE WHEN place <= 6 THEN p.p_brand ELSE 'brand_other' END AS b FROM part p JOIN brands USING (p_brand)),
sources AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) AS place FROM documents GROUP BY source)"""


@query("F3 F4 P13", f"""WITH {_TOP_BRANDS},
long AS (SELECT b AS value, count(*) AS n FROM bucketed GROUP BY b
  UNION ALL
  SELECT CASE WHEN place <= 5 THEN source ELSE 'src_other' END, count(*) FROM documents JOIN sources USING (source) GROUP BY 1)
SELECT (CASE WHEN value LIKE 'src%' THEN 'src_' ELSE 'brand_' END) || regexp_replace(value, '[^0-9A-Za-z_]', '_', 'g') AS feature, n AS n_ones FROM long""")
def topn_onehot(spark, sf_dir):
    """One-hot columns are data-dependent, so the check compares the ones per named column."""
    out = None
    for name, column, prefix, n in (("part", "p_brand", "brand", 6), ("documents", "source", "src", 5)):
        df = table(spark, sf_dir, name)
        kept, has_rare = feat.top_categories(df, [column], n)[column]
        hot = feat.one_hot(column, prefix, kept, has_rare)
        wide = df.select(*[c.alias(f) for f, c in hot.items()]).agg(*[F.sum(f).alias(f) for f in hot])
        part = wide.select(
            F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("n_ones")) for f in hot]))
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("F3 F4", f"""WITH {_TOP_BRANDS} SELECT p_partkey, b AS bucket FROM bucketed""")
def rare_bucket(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kept, _ = feat.top_categories(part, ["p_brand"], 6)["p_brand"]
    return part.select("p_partkey", feat.bucket_rare("p_brand", kept, "brand_other").alias("bucket"))


SPEC = feat.FeatureSpec(
    target="target", group="l_suppkey", numeric={"band_gap": "gap"}, number_text={"anneal_temp": "temperature"},
    flags={"flexible": "module_flag"}, categories={"arch": "l_returnflag", "ETL": "bucket_source"}, top_n=3,
)

_MATRIX = f"""{RECORDS},
texts AS (
  SELECT *, 'E' || (l_partkey % 7) AS bucket_source,
    list_max(list_transform(regexp_extract_all(temperature, '(\\d+\\.?\\d*)', 1), lambda x: TRY_CAST(x AS DOUBLE))) AS temp
  FROM shares),
kept AS (SELECT bucket_source, row_number() OVER (ORDER BY count(*) DESC, bucket_source) AS place FROM texts GROUP BY 1)"""


def matrix_records(spark, sf_dir):
    """Valid records with shares and a second category column."""
    raw = records(spark, sf_dir).withColumns(
        {
            "l_returnflag": F.when(F.startswith("a_names", F.lit("Cs")), F.lit("A"))
            .when(F.startswith("a_names", F.lit("FA")), F.lit("N")).otherwise(F.lit("R")),
            "bucket_source": F.concat(F.lit("E"), F.pmod("l_partkey", F.lit(7)).cast("string")),
        }
    )
    valid, _ = clean_rows(raw, RULES, RECORD_KEY, keep_parsed=True)
    return add_shares(valid, SITES)


@query("F1 F5", f"""WITH {_MATRIX},
filled AS (
  SELECT t.*, coalesce(gap, (SELECT median(gap) FROM texts)) AS band_gap, CASE WHEN gap IS NULL THEN 1 ELSE 0 END AS band_gap_missing,
    coalesce(temp, (SELECT median(temp) FROM texts)) AS anneal_temp, CASE WHEN temp IS NULL THEN 1 ELSE 0 END AS anneal_temp_missing,
    CASE WHEN place <= 3 THEN t.bucket_source ELSE 'ETL_other' END AS etl
  FROM texts t JOIN kept USING (bucket_source))
SELECT l_suppkey, count(*) AS n, round(sum(A_FA), 6) AS a_fa, round(sum(A_other), 6) AS a_other, round(sum(X_Br), 6) AS x_br,
  round(avg(band_gap), 9) AS band_gap, CAST(sum(band_gap_missing) AS BIGINT) AS band_gap_missing,
  round(avg(anneal_temp), 9) AS anneal_temp, CAST(sum(anneal_temp_missing) AS BIGINT) AS anneal_temp_missing,
  count(*) FILTER (lower(coalesce(module_flag, '')) = 'true') AS flexible,
  count(*) FILTER (l_returnflag = 'A') AS arch_a, count(*) FILTER (l_returnflag = 'N') AS arch_n,
  count(*) FILTER (etl = 'ETL_other') AS etl_other, round(avg(target), 9) AS target
FROM filled GROUP BY l_suppkey""")
def feature_matrix(spark, sf_dir):
    m = feat.build_features(matrix_records(spark, sf_dir), SPEC)
    out = m.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("A_FA").alias("a_fa"), F.sum("A_other").alias("a_other"),
        F.sum("X_Br").alias("x_br"), F.avg("band_gap").alias("band_gap"),
        F.sum("band_gap_missing").alias("band_gap_missing"), F.avg("anneal_temp").alias("anneal_temp"),
        F.sum("anneal_temp_missing").alias("anneal_temp_missing"), F.sum("flexible").cast("bigint").alias("flexible"),
        F.sum("arch_A").alias("arch_a"), F.sum("arch_N").alias("arch_n"), F.sum("ETL_ETL_other").alias("etl_other"),
        F.avg("target").alias("target"),
    )
    return rounded(out, {"a_fa": 6, "a_other": 6, "x_br": 6, "band_gap": 9, "anneal_temp": 9, "target": 9})


@query("F6", f"""WITH {_MATRIX}
SELECT round(A_FA, 9) AS A_FA, round(X_I, 9) AS X_I, gap AS band_gap, temp AS anneal_temp, CASE WHEN gap IS NULL THEN 1 ELSE 0 END AS band_gap_missing,
       bucket_source AS "ETL_category", target, l_suppkey FROM texts""")
def raw_features(spark, sf_dir):
    raw = feat.raw_features(matrix_records(spark, sf_dir), SPEC)
    out = raw.select("A_FA", "X_I", "band_gap", "anneal_temp", "band_gap_missing", "ETL_category", "target", "l_suppkey")
    return rounded(out, {"A_FA": 9, "X_I": 9})


_FOLDED_PARTS = f"""
folded AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size, p_brand AS brand,
             CAST({sql_bucket(42, 'p_partkey')} % 5 AS INTEGER) AS fold FROM part)"""


def folded_parts(spark, sf_dir):
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        n, F.when(F.pmod(n, F.lit(6)) != 0, F.col("p_size").cast("double")).alias("size"),
        F.col("p_brand").alias("brand"), F.pmod(md5_bucket(42, n), F.lit(5)).cast("int").alias("fold"),
    )


@query("F7", f"""WITH {_FOLDED_PARTS},
f AS (SELECT DISTINCT fold FROM folded),
med AS (SELECT f.fold, median(size) AS m FROM f JOIN folded r ON r.fold <> f.fold GROUP BY f.fold),
top AS (SELECT fold, brand, row_number() OVER (PARTITION BY fold ORDER BY n DESC, brand) AS place
        FROM (SELECT f.fold, brand, count(*) AS n FROM f JOIN folded r ON r.fold <> f.fold GROUP BY f.fold, brand))
SELECT p_partkey, r.fold, coalesce(size, m) AS size, CASE WHEN size IS NULL THEN 1 ELSE 0 END AS size_missing,
       CASE WHEN place <= 8 THEN r.brand ELSE 'brand_other' END AS brand
FROM folded r JOIN med USING (fold) LEFT JOIN top ON top.fold = r.fold AND top.brand = r.brand""")
def fold_local_features(spark, sf_dir):
    return feat.fold_local_features(folded_parts(spark, sf_dir), "fold", 5, ["size"], ["brand"], 8)


@query("F8", """
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 8) + 0.0 AS price,
       round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders), 8) + 0.0 AS cust FROM orders""")
def standard_scaling(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust")
    )
    out = feat.standardize(o, feat.scale_parameters(o, ["price", "cust"]))
    return rounded(out, {"price": 8, "cust": 8})
