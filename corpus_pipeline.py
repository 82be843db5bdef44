"""Corpus pipeline: quality, near duplicates, secrets, mixing, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutline.llm.bytenet import keep_good
from cutline.llm.common import stored, table
from cutline.llm.mixing import remixed
from cutline.llm.packing import packed_apart
from cutline.llm.secrets import masked
from cutline.llm.simhash import keep_one

#: Shares of the tokens: three to one, whatever mix the tables have. What is left of poor text stays as it is.
TARGETS = {"clean": 0.75, "clean_toxic": 0.25}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (5-word shingles, similarity 0.8): linked fingerprints are measured first, then bands."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is reached by repeating documents; none is lost."""
    return remixed(docs, table(spark, sf_dir, "labels"), TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the training sequences; neither repeats of a document nor near copies share one."""
    return packed_apart(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: A learnt classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
