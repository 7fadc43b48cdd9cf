"""The stored indexes that queries read: built from the tables at first use, once in a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import text
from corpuscle.operators.index import Index, build_code, build_texts
from corpuscle.sources import views
from corpuscle.sources.scratch import built


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as whole-file chunks; every tenth is a doc, every fifteenth an insight."""
    rows = views.files(spark, d)
    kind = F.expr("CASE WHEN doc_id % 10 = 0 THEN 'doc' WHEN doc_id % 15 = 1 THEN 'insight' ELSE 'code' END")
    return rows.withColumns({"chunk_id": text.short_hash("file_path", F.lit("0"), "symbol_name"), "chunk_type": kind})


def texts(spark: SparkSession, d: str) -> Index:
    return Index(spark, built(spark, [f"{d}/documents.parquet"], "texts", lambda folder: build_texts(chunks(spark, d), folder)))


def code(spark: SparkSession, d: str) -> Index:
    return Index(spark, built(spark, [f"{d}/part.parquet"], "code", lambda folder: build_code(views.spread_code(spark, d), folder)))
