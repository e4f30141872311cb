"""Sources, scalar functions, cleaning and contracts on the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import text as X
from ..functions.composition import Site, add_shares, composition_label, list_items, list_weights
from ..operators import cleaning as clean
from ..operators import contracts, profile
from ..operators.features import add_descriptors
from ..operators.joins import match_difference
from ..operators.metrics import abs_error, signed_error
from ..session import new_location, stage
from ..sources import readers, writers
from .base import (
    PRED, RECORDS, SITE_NAMES, SPELLED, decimal_text, predictions, query, records, rounded, spelled_orders, table,
)

SITES = [
    Site("A", "a_names", "a_weights", SITE_NAMES["A"]),
    Site("B", "b_names", "b_weights", SITE_NAMES["B"]),
    Site("X", "x_names", "x_weights", SITE_NAMES["X"]),
]
RULES = clean.CleaningRules("target", 0.0, 35.0, "module_flag", SITES)
RECORD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def valid_records(spark, sf_dir):
    """Cleaned records with their share columns."""
    valid, _ = clean.clean_rows(records(spark, sf_dir), RULES, RECORD_KEY, keep_parsed=True)
    return add_shares(valid, SITES)


# --- sources -------------------------------------------------------------------------------


@query("S1 S3 S7 S8", """
SELECT CAST(event_id AS VARCHAR) AS event_id,
       CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 'none' ELSE event_type END AS kind,
       CAST(value AS DOUBLE) AS value
FROM events""")
def csv_roundtrip(spark, sf_dir):
    kind = F.col("event_type")
    path = new_location(spark, "csv")
    writers.write_table(
        table(spark, sf_dir, "events").select(
            "event_id", "user_id",
            F.when(kind == "error", F.lit("NA")).when(kind == "view", F.lit("none")).otherwise(kind).alias("kind"),
            decimal_text("value").alias("value"),
        ),
        path, "csv",
    )
    raw, _absent = readers.read_raw_csv(spark, path, ["event_id", "kind", "value", "kind", "not_there"])
    named = readers.with_null_tokens(raw)
    return named.withColumn("value", X.numeric_or_null(F.col("value")))


@query("S4 S5", "SELECT doc_id, lang, n_chars FROM documents")
def column_predicate(spark, sf_dir):
    return readers.select_where(table(spark, sf_dir, "documents"), lambda c: c in ("doc_id", "n_chars", "lang"))


@query("S11", """
SELECT count(*) AS n_rows,
       CAST(sum(('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), o_orderpriority)), 1, 8))::UBIGINT) AS VARCHAR) AS content_sum
FROM orders""")
def table_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return writers.fingerprint(
        o.select(
            "o_orderkey", "o_custkey", "o_orderstatus", decimal_text("o_totalprice").alias("price"),
            F.to_date("o_orderdate").alias("day"), "o_orderpriority",
        )
    )


@query("S9", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups FROM orders")
def metrics_document(spark, sf_dir):
    found = table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups")
    )
    path = new_location(spark, "metrics")
    writers.write_metrics(spark, path, found.first().asDict())
    return spark.read.schema("n_rows bigint, n_groups bigint").json(path)


# --- scalar functions ----------------------------------------------------------------------


@query("P1", r"""
WITH texts AS (
  SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' ' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' ' WHEN 1 THEN 'nan' WHEN 2 THEN '1.0d'
      WHEN 3 THEN '-' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) WHEN 4 THEN CAST(event_id AS VARCHAR) || 'e-2' ELSE event_type END AS txt
  FROM events)
SELECT event_id, CASE WHEN regexp_matches(trim(txt), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST(trim(txt) AS DOUBLE) END AS number
FROM texts""")
def lenient_numeric(spark, sf_dir):
    v, i = decimal_text("value"), F.col("event_id")
    m = F.pmod(i, F.lit(6))
    txt = (
        F.when(m == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(m == 1, F.lit("nan")).when(m == 2, F.lit("1.0d"))
        .when(m == 3, F.concat(F.lit("-"), v)).when(m == 4, F.concat(i.cast("string"), F.lit("e-2")))
        .otherwise(F.col("event_type"))
    )
    return table(spark, sf_dir, "events").select("event_id", X.numeric_or_null(txt).alias("number"))


@query("P2", r"""
SELECT 'page' AS origin, page_id AS id, list_max(list_transform(regexp_extract_all(url, '(\d+\.?\d*)', 1), lambda x: TRY_CAST(x AS DOUBLE))) AS number FROM pages
UNION ALL
SELECT 'event', event_id, list_max(list_transform(regexp_extract_all(props, '(\d+\.?\d*)', 1), lambda x: TRY_CAST(x AS DOUBLE))) FROM events""")
def max_number(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("id"), X.max_number(F.col("url")).alias("number")
    )
    events = table(spark, sf_dir, "events").select(
        F.lit("event").alias("origin"), F.col("event_id").alias("id"), X.max_number(F.col("props")).alias("number")
    )
    return pages.unionByName(events)


@query("P3", f"""WITH {RECORDS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN lower(coalesce(module_flag, '')) = 'true' THEN 1 ELSE 0 END AS flag FROM records""")
def boolean_text(spark, sf_dir):
    return records(spark, sf_dir).select(*RECORD_KEY, X.flag_text(F.col("module_flag")).alias("flag"))


@query("P4", f"""WITH {RECORDS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(len(nl) AS INTEGER) AS n_names, CAST(len(wl) AS INTEGER) AS n_weights,
       array_to_string(nl, '+') AS names, list_sum(list_transform(wl, lambda x: TRY_CAST(x AS DOUBLE))) AS total
FROM parsed""")
def parallel_lists(spark, sf_dir):
    names, weights = list_items(F.col("a_names")), list_weights(F.col("a_weights"))
    known = F.filter(weights, lambda w: w.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda acc, w: acc + w))
    return records(spark, sf_dir).select(
        *RECORD_KEY, F.size(names).alias("n_names"), F.when(F.col("a_weights").isNotNull(), F.size(weights)).alias("n_weights"),
        F.array_join(names, "+").alias("names"), total.alias("total"),
    )


_SHARE_COLUMNS = [c for s in SITES for c in s.share_columns]
_SHARE_SQL = ", ".join(f"round({c}, 9) AS {c}" for c in _SHARE_COLUMNS)


@query("P4 P5 P6 P7", f"""WITH {RECORDS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SHARE_SQL} FROM shares""")
def shares(spark, sf_dir):
    out = valid_records(spark, sf_dir).select(*RECORD_KEY, *_SHARE_COLUMNS)
    return rounded(out, {c: 9 for c in _SHARE_COLUMNS})


@query("P8 P9 P10", f"""WITH {RECORDS},
radii AS (
  SELECT *,
    CASE WHEN A_FA + A_MA + A_Cs > 0 THEN (A_FA * 2.53::DOUBLE + A_MA * 2.17::DOUBLE + A_Cs * 1.88::DOUBLE) / (A_FA + A_MA + A_Cs) END AS ra,
    (B_Pb * 1.19::DOUBLE + B_Sn * 1.10::DOUBLE) / (B_Pb + B_Sn) AS rb,
    (X_I * 2.20::DOUBLE + X_Br * 1.96::DOUBLE) / (X_I + X_Br) AS rx
  FROM shares),
ratios AS (
  SELECT *, (ra + rx) / (sqrt(2.0) * (rb + rx)) AS t, rb / rx AS mu, rx / rb - (1.0 - (ra / rb) / ln(ra / rb)) AS tau FROM radii)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(coalesce(t, (SELECT median(t) FROM ratios)), 10) AS tolerance_factor,
  round(coalesce(mu, (SELECT median(mu) FROM ratios)), 10) AS octahedral_factor,
  round(coalesce(tau, (SELECT median(tau) FROM ratios)), 10) AS tau_factor,
  CASE WHEN t IS NULL OR mu IS NULL OR tau IS NULL THEN 1 ELSE 0 END AS descriptor_missing
FROM ratios""")
def descriptors(spark, sf_dir):
    out = add_descriptors(stage(valid_records(spark, sf_dir), "records")).select(
        *RECORD_KEY, "tolerance_factor", "octahedral_factor", "tau_factor", "descriptor_missing"
    )
    return rounded(out, {"tolerance_factor": 10, "octahedral_factor": 10, "tau_factor": 10})


def _label_sql(prefix: str) -> str:
    parts = " || ".join(
        f"CASE WHEN {prefix}_{n} > 0.01 THEN '{n}' || printf('%.2f', round_even({prefix}_{n}, 2)) ELSE '' END"
        for n in SITE_NAMES[prefix]
    )
    return f"CASE WHEN {parts} = '' THEN '-' ELSE {parts} END"


_LABEL = " || ' / ' || ".join(f"({_label_sql(p)})" for p in SITE_NAMES)


@query("P11", f"""WITH {RECORDS}
SELECT label, count(*) AS n FROM (SELECT {_LABEL} AS label FROM shares) GROUP BY label""")
def composition_labels(spark, sf_dir):
    df = valid_records(spark, sf_dir)
    return df.groupBy(composition_label(SITE_NAMES, df.columns).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("P12", f"WITH {SPELLED} SELECT o_orderkey, norm_key FROM normed")
def normalized_keys(spark, sf_dir):
    return spelled_orders(spark, sf_dir).select("o_orderkey", X.normalize_key(F.col("raw_key")).alias("norm_key"))


@query("P13 P17 P20", """
SELECT p_partkey, p_brand AS A_brand_1, p_type AS arch_type, p_size AS solv_size_x FROM part""")
def safe_column_names(spark, sf_dir):
    named = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("A_brand#1"), F.col("p_type").alias("arch-type"),
        F.col("p_size").alias("solv size x"), F.col("p_retailprice").alias("target"),
    )
    features = named.drop("target")
    families = {
        "shares": lambda c: c.startswith("A_"), "with_device": lambda c: c.startswith("arch"), "with_process": lambda c: c.startswith("solv"),
    }
    scopes = C.feature_scopes([c for c in features.columns if c != "p_partkey"], families)
    return C.with_safe_names(features.select("p_partkey", *scopes["with_process"]))


@query("P14", """
SELECT p_partkey, concat_ws('|', substr(p_brand, 7), p_type, CAST(p_size AS VARCHAR)) AS recipe FROM part""")
def composite_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.composite_key(X.strip_prefix(F.col("p_brand"), "Brand#"), F.col("p_type"), F.col("p_size").cast("string")).alias("recipe"),
    )


_WORDS = ("license", "http", "copyright", "the", "que")


@query("P15", f"""
SELECT doc_id,
  {" || ".join(f"CASE WHEN contains(lower(text), '{w}') THEN '{w};' ELSE '' END" for w in _WORDS)} AS hits,
  CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 AS INTEGER) AS n_the
FROM documents""")
def keyword_hits(spark, sf_dir):
    hits = F.array_join(F.transform(X.keyword_hits(F.col("text"), _WORDS), lambda w: F.concat(w, F.lit(";"))), "")
    return table(spark, sf_dir, "documents").select(
        "doc_id", hits.alias("hits"), X.substring_count(F.col("text"), "the").alias("n_the")
    )


@query("P16", f"""WITH {PRED}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(y - p), 4) AS abs_error, round(p - y, 4) AS signed_error FROM pred""")
def error_columns(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        *RECORD_KEY, F.round(abs_error("y", "p"), 4).alias("abs_error"), F.round(signed_error("y", "p"), 4).alias("signed_error")
    )


@query("P19", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice END AS price,
       CASE WHEN o_orderkey % 4 = 0 THEN 'none' ELSE o_orderpriority END AS priority FROM orders""")
def fill_constants(spark, sf_dir):
    n = F.col("o_orderkey")
    holes = table(spark, sf_dir, "orders").select(
        n, F.when(F.pmod(n, F.lit(3)) != 0, F.col("o_totalprice")).alias("price"),
        F.when(F.pmod(n, F.lit(4)) != 0, F.col("o_orderpriority")).alias("priority"),
    )
    return C.fill_constants(holes, {"price": 0.0, "priority": "none"})


@query("P21", f"""WITH {PRED},
cut AS (SELECT *, round_even(y, 1) AS truth, round_even(p, 1) AS predicted FROM pred)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(truth, 1) AS truth, round(predicted, 1) AS predicted,
       round(abs(truth - predicted), 1) AS abs_error FROM cut""")
def prediction_report(spark, sf_dir):
    cut = predictions(spark, sf_dir).select(
        *RECORD_KEY, F.bround("y", 1).alias("truth"), F.bround("p", 1).alias("predicted")
    )
    return cut.withColumn("abs_error", F.bround(abs_error("truth", "predicted"), 1))


# --- cleaning and contracts ----------------------------------------------------------------


@query("C1 C2 C3 C4 C5", f"""WITH {RECORDS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, reason FROM reasoned WHERE reason IS NOT NULL""")
def clean_reasons(spark, sf_dir):
    return clean.clean_rows(records(spark, sf_dir), RULES, RECORD_KEY)[1]


@query("C6", f"WITH {RECORDS} SELECT reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(spark, sf_dir):
    return clean.reason_counts(clean.clean_rows(records(spark, sf_dir), RULES, RECORD_KEY)[1])


@query("C7 A26", f"""WITH {RECORDS}
SELECT (SELECT count(*) FROM records) AS n_raw, count(*) AS n_clean, (SELECT count(*) FROM records) - count(*) AS n_removed,
       round(avg(t), 8) AS mean, round(median(t), 8) AS median, round(stddev_samp(t), 8) AS std, count(DISTINCT l_suppkey) AS n_groups
FROM valid""")
def clean_summary(spark, sf_dir):
    raw = records(spark, sf_dir)
    valid, _ = clean.clean_rows(raw, RULES, RECORD_KEY)
    valid = stage(valid.select("target", "l_suppkey"), "valid")
    out = profile.clean_summary(raw, valid, "target", "l_suppkey")
    return rounded(out, {"mean": 8, "median": 8, "std": 8})


@query("C8", f"""WITH {RECORDS}
SELECT count(*) AS n_rows, count(*) FILTER (t IS NULL) AS n_not_numeric, count(*) FILTER (t < 0 OR t > 35) AS n_out_of_range FROM parsed""")
def contract_clean(spark, sf_dir):
    return contracts.clean_violations(records(spark, sf_dir), "target", 0.0, 35.0)


@query("C9", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem")
def contract_leakage(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
        F.col("l_tax").alias("JV_tax"), F.col("l_discount").alias("Stability_discount"),
    )
    return line.drop(*contracts.leaking_columns(line.columns))


@query("C10", f"""WITH {RECORDS},
scaled AS (SELECT *, CASE WHEN l_orderkey % 10 = 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS f FROM shares)
SELECT count(*) FILTER ((A_FA * f + A_MA + A_Cs + A_other) NOT BETWEEN 0.98 AND 1.02) AS n_bad_A,
       count(*) FILTER ((B_Pb * f + B_Sn) NOT BETWEEN 0.98 AND 1.02) AS n_bad_B,
       count(*) FILTER ((X_I * f + X_Br) NOT BETWEEN 0.98 AND 1.02) AS n_bad_X
FROM scaled""")
def contract_shares(spark, sf_dir):
    f = F.when(F.pmod("l_orderkey", F.lit(10)) == 0, F.lit(1.05)).otherwise(F.lit(1.0))
    broken = valid_records(spark, sf_dir).withColumns({c: F.col(c) * f for c in ("A_FA", "B_Pb", "X_I")})
    return contracts.share_sum_violations(broken, SITE_NAMES)


@query("C11", """
SELECT 'o_totalprice' AS column_name, count(*) AS n_rows FROM orders WHERE false GROUP BY 1
UNION ALL SELECT 'empty_a', count(*) FROM orders UNION ALL SELECT 'empty_b', count(*) FROM orders""")
def contract_empty_columns(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        "o_totalprice", F.lit(None).cast("double").alias("empty_a"),
        F.when(F.col("o_orderkey") < 0, F.lit(1.0)).alias("empty_b"), "o_orderkey",
    )
    empty = contracts.all_null_columns(o, o.columns)
    return o.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.lit(empty)).alias("column_name"), "n_rows"
    )


@query("C12", """
SELECT 'all' AS subset, count(*) AS n FROM events WHERE value IS NOT NULL
UNION ALL SELECT 'le_30', count(*) FROM events WHERE value <= 30
UNION ALL SELECT 'le_28', count(*) FROM events WHERE value <= 28
UNION ALL SELECT 'gt_30', count(*) FROM events WHERE value > 30""")
def threshold_subsets(spark, sf_dir):
    out = None
    for name, rows in clean.threshold_subsets(table(spark, sf_dir, "events"), "value", [30, 28], [30]).items():
        part = rows.agg(F.count(F.lit(1)).alias("n")).withColumn("subset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("C13 J10", """
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1.5 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 50 <> 0)
SELECT count(*) FILTER (b.o_orderkey IS NOT NULL) AS n_matched, count(*) FILTER (b.o_orderkey IS NULL) AS n_only_left, CAST(0 AS BIGINT) AS n_only_right,
       count(*) FILTER (abs(o_totalprice - v) > 1e-6) AS n_different, round(max(abs(o_totalprice - v)), 6) AS max_abs_diff
FROM orders a LEFT JOIN b ON a.o_orderkey = b.o_orderkey""")
def alignment(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("v"))
    n = F.col("o_orderkey")
    other = o.filter((F.col("o_orderstatus") != "P") | (F.pmod(n, F.lit(50)) != 0)).withColumn(
        "v", F.when(F.pmod(n, F.lit(97)) == 0, F.col("v") + 1.5).otherwise(F.col("v"))
    )
    return rounded(match_difference(o, other, ["o_orderkey"], "v"), {"max_abs_diff": 6})


@query("C14", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1-') OR o_orderpriority = '5-LOW'""")
def label_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return o.filter(F.col("o_orderpriority").startswith("1-") | (F.col("o_orderpriority") == "5-LOW"))


@query("C15", f"WITH {RECORDS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM records WHERE gap IS NOT NULL AND module_flag IS NOT NULL")
def drop_nulls(spark, sf_dir):
    return records(spark, sf_dir).na.drop(subset=["gap", "module_flag"]).select(*RECORD_KEY)
