"""Registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cutline.llm.bilinear import text_scores
from cutline.llm.bm25 import top_documents
from cutline.llm.bytenet import quality_scores
from cutline.llm.common import table
from cutline.llm.forest import nearest
from cutline.llm.mixing import mixture
from cutline.llm.packing import packed_apart
from cutline.llm.phrases import SQL as PHRASES_SQL
from cutline.llm.phrases import collocations
from cutline.llm.repair import damaged, repair_report
from cutline.llm.secrets import secret_spans
from cutline.llm.simhash import simhash_groups
from cutline.llm.tokenpack import packed_segments
from cutline.llm.warc import archived
from cutline.llm.wrappers import extract


def op1_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op2_bytenet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_apart(table(spark, sf_dir, "documents"))


def op6_tokenpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_segments(spark, table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_scores(table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_forest": op1_forest,
    "op2_bytenet": op2_bytenet,
    "op3_simhash": op3_simhash,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_tokenpack": op6_tokenpack,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_bm25": op9_bm25,
    "op10_wrappers": op10_wrappers,
    "op11_phrases": op11_phrases,
    "op12_bilinear": op12_bilinear,
    "op13_repair": op13_repair,
}
ORACLES: dict[str, str] = {"op11_phrases": PHRASES_SQL}
