"""Readers with given schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """UTF-8 CSV with a header, all columns text; a missing required column raises."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    first = df.columns[0] if df.columns else ""
    df = df.withColumnRenamed(first, first.lstrip("﻿"))
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_ndjson(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(company_number, data) lines, plain or gzip; data stays JSON text. limit: the quick mode's first lines."""
    lines = spark.read.text(path)
    if limit is not None:
        lines = lines.limit(limit)
    return lines.select(F.get_json_object("value", "$.company_number").alias("company_number"), F.get_json_object("value", "$.data").alias("data"))


def read_projection(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that the file has."""
    df = spark.read.parquet(path)
    return df.select(*[c for c in columns if c in df.columns])


def read_reference(spark: SparkSession, path: str) -> DataFrame | None:
    """An optional side table: None where there is none."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath):
        return None
    return spark.read.parquet(path)
