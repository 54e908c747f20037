"""The published entities as numbered snapshots: a version is whole or not there, and none is changed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "record_id string, entity_id string, since long, until long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[8:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("version="))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """All memberships of the newest version: open ones have no until."""
    found = versions(spark, folder)
    return spark.read.schema(SCHEMA).parquet(f"{folder}/version={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def publish(folder: str, proposal: DataFrame, based_on: int | None, force: bool = False) -> int:
    """Write the next version from (record_id, entity_id): a changed membership is closed and a new one opened.

    based_on: the newest version when the proposal was made; a later one stops
    the publication unless forced. The version appears by one rename, which
    fails if another publication took its number.
    """
    spark = proposal.sparkSession
    found = versions(spark, folder)
    newest = found[-1] if found else None
    if newest != based_on and not force:
        raise ValueError(f"version {newest} was published meanwhile")
    n = (newest or 0) + 1
    old = members(spark, folder)
    new = proposal.select(F.col("record_id").cast("string").alias("record_id"), F.col("entity_id").cast("string").alias("n"))
    closed = old.where("until IS NOT NULL")
    live = old.where("until IS NULL").join(new, "record_id", "full_outer")
    kept = F.col("entity_id").eqNullSafe(F.col("n"))
    ended = live.where(F.col("entity_id").isNotNull()).select("record_id", "entity_id", "since", F.when(~kept, F.lit(n)).cast("long").alias("until"))
    begun = live.where(F.col("n").isNotNull() & ~kept).select("record_id", F.col("n").alias("entity_id"), F.lit(n).cast("long").alias("since"), F.lit(None).cast("long").alias("until"))
    building = f"{folder}/building-{uuid.uuid4().hex}"
    closed.unionByName(ended).unionByName(begun).write.option("compression", "zstd").parquet(building)
    fs, to = _fs(spark, f"{folder}/version={n}")
    if fs.exists(to) or not fs.rename(_fs(spark, building)[1], to):
        raise ValueError(f"version {n} is taken")
    return n
