"""A training corpus from raw documents: language, repeated lines, near duplicates, benchmarks, mixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievenet.llm import decontaminate, jaccard, language, lines, mixing
from sievenet.llm.tables import saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without text or without a letter go.

    Labelled rows teach a model whose language and score don't decide here.  Without labels, texts with a letter stay.
    """
    return language.keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of two lines or more that came before; text and n_chars are what is left."""
    return lines.dedup_lines(docs, lines.without_runs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each group that shares at least 0.8 of its word 5-grams."""
    return jaccard.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows.

    Each row is judged by its own whole text: null and repeated ids need no care, null and empty texts stay,
    other columns are handed on, and an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: columns of documents and copy, from 1."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
]

ORACLE_SQL = None  # a trained model and iterated weights can't be put in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
