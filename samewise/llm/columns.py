"""Helpers that keep caller columns out of the operators' way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def bound_batches(df: DataFrame) -> None:
    """Rows of text are long: at most BATCH_ROWS go to a Python worker at once, unless the session says less."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing columns never matter."""
    bound_batches(df)
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
