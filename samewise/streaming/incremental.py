"""An extension: new records matched against published ones as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_new(new: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """(record_id, entity_id): the least entity that holds a record of the same key; null for none."""
    known = published.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("entity_id").alias("entity_id"))
    return new.join(known, key, "left").select("record_id", "entity_id")


def start(stream: DataFrame, published: Callable[[], DataFrame], key: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Match every micro-batch; the sink gets (rows, batch id) and may see a batch again after a failure."""
    return stream.writeStream.foreachBatch(lambda rows, n: sink(match_new(rows, published(), key), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
