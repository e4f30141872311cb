"""From documents to packed training sequences: stages that each work on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldguard.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from foldguard.llm.base import documents
from foldguard.session import new_location


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references are learned from this stage's own input."""
    references = quality_rules.learn_references(docs)
    return quality_rules.quality_rules(docs, references, with_input=True).filter("kept").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, a similarity of 0.8): the one with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in random order."""
    return mixing.mix(docs, mixing.source_rates(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Learned references and tokenizers have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage is written before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = new_location(spark, f"pipeline-{name}")
        out.write.mode("errorifexists").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
