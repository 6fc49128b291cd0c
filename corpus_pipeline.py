"""A training corpus from ``documents`` in five stages, each one operator of ``wordloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run`
writes it as Parquet into the shared folder and hands the reread table to the
next.  All stages but the last return the columns of ``documents``; the last
returns the packed sequences' parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontaminate, jaccard, langid, lines, packing
from wordloom.llm.frames import materialize, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or that no language explains (bits per symbol of the parse); learns from all labelled documents."""
    return langid.keep_identified(docs, F.col("lang").isNotNull())


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier line within two edits, and documents that lose every line."""
    return lines.remove_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every near-duplicate group."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item (or a whole shorter item)."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' places in sequences of 512 to 8192 words."""
    return packing.pack_documents(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("jaccard_join", dedup_documents),
    ("decontamination", drop_benchmark),
    ("best_fit_packing", pack),
]

# language identification, the join and the packing are not SQL: tested against brute force in tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), spark, name)
    return docs
