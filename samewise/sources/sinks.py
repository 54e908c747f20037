"""Writers: typed, ordered, swapped in whole."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """zstd Parquet; columns without a type become text; sorted by ranges if an order is given; an old table is moved aside once the new one is whole, put back if that can't take its place, and only then deleted."""
    spark = df.sparkSession
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    building = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(building)
    new, to, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (building, path.rstrip("/"), f"{building}.old"))
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(to)
    if had and not fs.rename(to, aside):
        raise OSError(f"can't move {path} aside; the new table is at {building}")
    if not fs.rename(new, to):
        if had:
            fs.rename(aside, to)
        raise OSError(f"can't put the new table at {path}; it is at {building}")
    if had:
        fs.delete(aside, True)


def append_parquet(df: DataFrame, path: str) -> None:
    """Rows added to a table under that table's types; columns that df lacks are null."""
    spark = df.sparkSession
    old = spark.read.parquet(path).schema
    rows = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in old])
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
