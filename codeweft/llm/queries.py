"""Queries of this subpackage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import codefilter, docpairs, leakage, sentences, tokenize


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codefilter.not_hand_written(load(spark, sf_dir, "source_files")).select("rel_path")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codefilter.not_hand_written(load(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(load(spark, sf_dir, "symbols"), load(spark, sf_dir, "source_files"), with_body=False).select("symbol_id")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpairs.pairs(load(spark, sf_dir, "symbols"), load(spark, sf_dir, "source_files"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(load(spark, sf_dir, "documents"))


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(load(spark, sf_dir, "documents"), offsets=True)


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text encoded and decoded again."""
    return tokenize.decode(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p8_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items and the documents that hold them, per suite."""
    found = p8_found(spark, sf_dir).join(load(spark, sf_dir, "eval_items").select("item_id", "suite"), "item_id")
    return found.groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.units(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kinds, p2_found, p2_pairs, p7_ids, p7_offsets, p7_decoded, p8_found, p8_suites, p9_found)}
SQL: dict[str, str] = {"p7_decoded": "select doc_id, coalesce(text, '') as text from documents"}
