"""Queries of this folder, by problem, and SQL where it can state one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .copy_ledger import ledger_of
from .look_alike import look_alike_forms, look_alike_pairs
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .queries_sql import SQL  # noqa: F401
from .source_mix import document_tokens, mix_curve, mix_plan, mix_report, mixed_documents
from .split_overlap import overlap_report, split_overlap
from .stuffed_pages import page_stuffing
from .tokenize_corpus import token_ids
from .vector_neighbours import nearest_vectors, neighbour_pairs

_NEAR = {"unit": "char", "width": 7, "threshold": 0.60, "least": 80}
_SIDES = {"other": ["exemplar_bank"], "examined": ["validation", "test"]}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text"), **_NEAR)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text"), **_NEAR)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_pairs(nearest_vectors(_table(spark, folder, "row_vectors"), F.col("vec_id"), F.col("embedding")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = split_overlap(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text"), F.col("split"), **_SIDES)
    return pairs.select(F.least("examined_id", "other_id").alias("id_a"), F.greatest("examined_id", "other_id").alias("id_b")).distinct()


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text"), F.col("split"), F.col("family_id"), **_SIDES)


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    df = _table(spark, folder, "corpus_v7")
    rows = ledger_of(df, F.col("id"), F.col("loaded_at"), F.col("text")).records()
    return spark.createDataFrame([], "id string, keep_id string, copies long, first_id string") if rows is None else rows


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"))


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).groupBy("keep_id", "first_id").agg(F.max("copies").alias("copies"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_pairs(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text"))


def p5_forms(spark: SparkSession, folder: str) -> DataFrame:
    return look_alike_forms(_table(spark, folder, "corpus_v4"), F.col("id"), F.col("text")).select("id", "form", "shown")


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids(_table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    tokens = document_tokens(_table(spark, folder, "documents"), F.col("doc_id"), F.col("source"), F.col("text"))
    plan = mix_plan(tokens, _table(spark, folder, "mix_targets"))
    return mixed_documents(tokens, plan), plan


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return mix_report(*_mix(spark, folder))


def p7_curve(spark: SparkSession, folder: str) -> DataFrame:
    return mix_curve(*_mix(spark, folder))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return page_stuffing(_table(spark, folder, "documents"), F.col("doc_id"), F.col("text")).where("stuffed").select("doc_id").distinct()


def p8_measures(spark: SparkSession, folder: str) -> DataFrame:
    return page_stuffing(_table(spark, folder, "documents"), F.col("doc_id"), F.col("text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_groups, p2_found, p3_found, p3_report, p4_found, p4_counts, p5_found, p5_forms, p6_ids, p7_mix, p7_report, p7_curve, p8_found, p8_measures)
}
