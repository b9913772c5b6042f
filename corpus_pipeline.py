"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing and
packing, in this order, each stage on all that its predecessor kept.

All stages but the last take and return the columns of ``documents``; their decisions
are in the rows: rejected documents and near copies are gone, repeated lines are cut from
the text, and a document that the mix takes twice is there twice. The last returns a row
for each packed piece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowcast.llm import line_dedup, mixing, packing, quality_rules, simhash
from flowcast.llm.common import materialise, read

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; n_chars follows the text."""
    out = line_dedup.remove_repeated_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that of the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, none to three times."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bin and place in it."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", reject_by_rules),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit", pack_bins),
]

# The fitted rules, the fingerprints and the packing are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written and read again."""
    docs = read(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
