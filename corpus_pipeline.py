"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourlake.llm import bpe, mixing, ngram_join, quality_rules, toxicity
from hourlake.llm.common import table
from hourlake.llm.queries import PATTERN, RANKS
from hourlake.session import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones of these, doesn't call toxic."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson counts, so that sources weigh by the root of their size, in random order."""
    return mixing.mix(docs).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of the ids and of what they decode to."""
    return bpe.digests(docs, RANKS, PATTERN, keep_ids=True)


STAGES = [("quality_rules", good), ("toxicity", civil), ("ngram_join", distinct), ("mixing", mixed), ("bpe", encoded)]

#: Learned scores, similarity classes by hash and BPE are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``: one row per kept document and repetition, with its token ids.

    Each stage is written to the shared folder and read again, so a lost executor repeats a stage at most. Null texts
    count as empty; such documents, and all of fewer than 20 words, go with the quality rules. Repeated rows are
    copies, of which one stays; rows without a key stay if their text does. Other columns, whatever their names,
    come through to the last stage, which gives ids and digests instead. An empty table gives an empty one.
    """
    docs, base = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
