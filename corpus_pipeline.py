"""From documents to training data: quality rules, near-dedup, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and gives the documents that go on, with all their columns;
the last gives what the token files say of each. ``run`` writes every stage as a table in the
shared folder and reads it again, which cuts lineage.

All stages take whole texts, any further columns whatever their names, nulls in any column, and empty
tables (without rows they give none). A stage's docstring says what it makes of nulls and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import decontam, mixing, neardup, quality, tokens
from tidelog.llm.queries import vocabulary
from tidelog.llm.textkit import short_batches, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hard limits or the trees reject go.

    Null and empty texts fail the limits; repeated rows are judged alike and all stay or go; without
    labels the trees take every document that passes the limits.
    """
    short_batches(spark)
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays: five-word shingles, Jaccard similarity of 0.8 or more.

    It is the one with the smallest doc_id, a null one last; texts without words are copies of each other.
    """
    short_batches(spark)
    return neardup.leaders(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which any window of a test item occurs go.

    Null texts have no words and stay; items of fewer words than a window are one window; repeated rows go or stay together.
    """
    short_batches(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks; all at least once.

    A null source is a source of its own; documents without words come once; rows alike in id, source and text are taken alike.
    """
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and what they say of each: one row a row, null texts as the end id alone, null ids first."""
    return tokens.digest(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: Trees, components and a tokenizer can't be told in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
