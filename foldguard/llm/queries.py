"""The operators' queries over the whole tables, and the SQL that they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, language_id, license_scan, merkle, mixing, ngram_join, packing, prefix_trie, quality_rules, simhash, suffix_dedup, token_counts
from .base import conversations, documents
from .sql_twins import manifest_sql, trie_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


@_query(r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT *, row_number() OVER (PARTITION BY body ORDER BY n_cp DESC, doc_id) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_cp DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


@_query()
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


_UNIFORM = "CAST(CAST(('0x' || substr(md5('0|copies|' || CAST(doc_id AS VARCHAR) || '|' || CAST(j AS VARCHAR)), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0"


@_query(f"""
WITH sizes AS (
  SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents GROUP BY source
), weighted AS (SELECT *, sqrt(CAST(greatest(n_bytes, 1) AS DOUBLE)) AS weight FROM sizes
), rates AS (
  SELECT source AS mix_source, weight / (SELECT sum(weight) FROM weighted) * (SELECT sum(n_bytes) FROM weighted) / greatest(n_bytes, 1) AS rate FROM weighted
), blocks AS (SELECT *, CAST(greatest(ceil(rate / 64), 1) AS BIGINT) AS blocks FROM rates
), terms AS (
  SELECT mix_source, rate, blocks, k, exp(k * ln(rate / blocks) - rate / blocks - lgamma(k + 1)) AS term FROM blocks, range(0, {mixing.BLOCK_TERMS}) AS r(k)
), below AS (
  SELECT mix_source, rate, blocks, list(c ORDER BY k) AS below
  FROM (SELECT *, sum(term) OVER (PARTITION BY mix_source ORDER BY k) AS c FROM terms) GROUP BY ALL
), draws AS (
  SELECT d.doc_id, d.source, sha256(coalesce(d.text, '')) AS text_sha256, b.rate, b.below, unnest(range(0, b.blocks)) AS j FROM documents d JOIN below b ON d.source IS NOT DISTINCT FROM b.mix_source
), uniform AS (SELECT *, {_UNIFORM} AS u FROM draws
), counts AS (
  SELECT doc_id, source, text_sha256, rate, CAST(sum(len(list_filter(below, lambda c: c <= u))) AS BIGINT) AS copies FROM uniform GROUP BY ALL
), copies AS (SELECT doc_id, source, text_sha256, rate, unnest(range(0, copies)) AS copy FROM counts)
SELECT doc_id, source, text_sha256, round(rate, 9) AS mix_rate, CAST(copy AS INTEGER) AS mix_copy, md5('0|order|' || CAST(doc_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS mix_order
FROM copies
""")
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rates = mixing.source_rates(docs)
    mixed = mixing.mix(docs, rates)  # whole rows; the digest is made of the text that was repeated and put in order
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    return mixed.select("doc_id", "source", text.alias("text_sha256"), F.round("mix_rate", 9).alias("mix_rate"), "mix_copy", "mix_order")


@_query()
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@_query()
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.quality_rules(docs, quality_rules.learn_references(docs))


_CONTROL = r"<\\*(?:/?s>|\|[A-Za-z0-9_]*\|>)|\[\\*/?INST\]"


def _marked(column: str) -> str:
    return f"(length({column}) + len(regexp_extract_all({column}, '{_CONTROL}')))"


@_query(f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), r AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_marked('text')} + CASE WHEN opens THEN {_marked('role')} + 23 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
""")
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations(spark, sf_dir).select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    formatted = chat_format.format_conversations(rows.unionByName(more))
    back = chat_format.read_back(formatted.withColumn("conv_id", F.struct("conv_id", F.char_length("formatted").cast("bigint").alias("chars"))))
    one = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id.conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(one, ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.col("conv_id.chars").alias("formatted_chars"),
    )


def _as_files(docs: DataFrame) -> DataFrame:
    """The table has no paths, so its documents are laid out as a tree by source, language and id; the first of every 64
    ids stands as its folder's licence file, and the first of every 4096 as its language's."""
    block, folder = F.floor(F.col("doc_id") / 4096), F.floor(F.col("doc_id") / 64)
    top = F.concat(F.lit("b"), block.cast("string"), F.lit("/"), F.coalesce("source", F.lit("none")))
    path = (
        F.when(F.col("doc_id") % 4096 == 0, F.concat(F.lit("b"), block.cast("string"), F.lit("/LICENSE")))
        .when(F.col("doc_id") % 64 == 0, F.concat(top, F.lit("/LICENSE.txt")))
        .otherwise(F.concat(top, F.lit("/f"), folder.cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def _license_sql() -> str:
    rows, unknown = license_scan.template_weights()
    weights = ", ".join(f"({t}, '{lic}', '{term}', {w!r}::DOUBLE)" for t, lic, term, w in rows)
    idf = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in license_scan.term_idf().items())
    return rf"""
WITH weights(template, licence, term, weight) AS (VALUES {weights}), idf(term, idf) AS (VALUES {idf}),
files AS (
  SELECT doc_id, text, 'b' || (doc_id // 4096) AS block, 'b' || (doc_id // 4096) || '/' || coalesce(source, 'none') AS top,
         CASE WHEN doc_id % 4096 = 0 THEN block || '/LICENSE' WHEN doc_id % 64 = 0 THEN top || '/LICENSE.txt'
              ELSE top || '/f' || (doc_id // 64) || '/' || doc_id || '.txt' END AS path
  FROM documents
), lines AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM files
), sentences AS (SELECT doc_id, unnest(range(0, len(s))) AS place, unnest(s) AS sentence FROM lines
), terms AS (
  SELECT doc_id, place, lower(unnest(regexp_extract_all(sentence, '{license_scan.TERM}'))) AS term FROM sentences
  WHERE regexp_matches(sentence, '(?i)(^|[^A-Za-z])({license_scan.LICENCE_WORDS})([^A-Za-z]|$)')
), sized AS (
  SELECT doc_id, place, term, count(*) * coalesce(any_value(idf), {unknown!r}::DOUBLE) AS size FROM terms LEFT JOIN idf USING (term) GROUP BY doc_id, place, term
), norms AS (SELECT doc_id, place, sqrt(sum(size * size)) AS norm FROM sized GROUP BY ALL
), scored AS (
  SELECT doc_id, licence, round(sum(size * weight) / any_value(norm), 6) AS cosine
  FROM sized JOIN weights USING (term) JOIN norms USING (doc_id, place) GROUP BY doc_id, place, template, licence
), own AS (
  SELECT doc_id, first(licence ORDER BY cosine DESC, licence) AS own_licence, max(cosine) AS own_cosine FROM scored WHERE cosine >= {license_scan.MIN_COSINE} GROUP BY doc_id
), known AS (
  SELECT doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, own_licence, own_cosine FROM files LEFT JOIN own USING (doc_id)
), by_dir AS (
  SELECT dir AS above, first(own_licence ORDER BY own_cosine DESC, own_licence) AS licence FROM known
  WHERE regexp_matches(name, '{license_scan.LICENCE_FILES}') AND own_licence IS NOT NULL GROUP BY dir
), near AS (
  SELECT d.dir, arg_max(above, length(above)) AS above, arg_max(licence, length(above)) AS licence
  FROM (SELECT DISTINCT dir FROM known) d JOIN by_dir ON d.dir = above OR starts_with(d.dir, above || '/') OR above = '' GROUP BY d.dir
)
SELECT doc_id, path, coalesce(own_licence, near.licence) AS licence, own_cosine AS cosine, CASE WHEN own_licence IS NULL THEN near.above END AS inherited_from
FROM known LEFT JOIN near USING (dir)
"""


@_query(_license_sql())
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_as_files(documents(spark, sf_dir)))


@_query()
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), ngram_join.NgramRule(words=4, percent=85))


@_query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


@_query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.train(docs))


@_query()
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))


@_query(manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_check(documents(spark, sf_dir))


@_query(trie_sql())
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_table(conversations(spark, sf_dir))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(turns)).drop("node")
