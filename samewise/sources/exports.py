"""What people take away: entity ids beside the records, bulk lines, the label library as CSV and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.StructType([T.StructField("record_a", T.StringType()), T.StructField("record_b", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("note", T.StringType())])
#: How a verdict may be written.
YES, NO = ["TRUE", "T", "YES", "Y", "1"], ["FALSE", "F", "NO", "N", "0"]


def with_entities(records: DataFrame, entities: DataFrame, key: str, entity: str = "entity_id") -> DataFrame:
    """records with their entity's id and basis; every record stays, without an entity as basis none."""
    out = records.join(entities.select(key, entity).distinct(), key, "left")
    return out.withColumn("basis", F.when(F.col(entity).isNull(), "none").otherwise("matched"))


def bulk_lines(members: DataFrame, record: str, entity: str) -> DataFrame:
    """(record, part, line): for each record with an entity the action line and the document line of a bulk load."""
    r, e = F.col(record).cast("string"), F.col(entity).cast("string")
    line = lambda n, s: F.struct(F.lit(n).alias("part"), F.to_json(s).alias("line"))
    two = F.array(line(1, F.struct(F.struct(r.alias("_id")).alias("index"))), line(2, F.struct(r.alias("record_id"), e.alias("entity_id"))))
    return members.where(e.isNotNull()).select(record, F.explode(two).alias("x")).select(record, "x.*")


def write_bulk(members: DataFrame, path: str, record: str, entity: str) -> None:
    """The lines as text files: each record's two lines stay together and in order."""
    lines = bulk_lines(members, record, entity).groupBy(record).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("value"))
    lines.select("value").write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """(record_a, record_b, same, note) as CSV with a header; quotes inside are doubled."""
    out = labels.select("record_a", "record_b", F.when(F.col("same"), "TRUE").otherwise("FALSE").alias("verdict"), "note")
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, rejects): labels are (record_a, record_b, same, note); rejects (line, reason) keep the line as it stood.

    A line is rejected if it can't be read, if an id is missing or both are
    the same, or if its verdict is neither a yes nor a no.
    """
    schema = T.StructType([*LABELS.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    a, b, v = (F.trim(c) for c in ("record_a", "record_b", "verdict"))
    missing = lambda c: c.isNull() | (c == "")
    reason = F.when(F.col("_bad").isNotNull(), "unreadable").when(missing(a) | missing(b), "an id is missing").when(a == b, "both ids are the same").when(~F.coalesce(F.upper(v).isin(*YES, *NO), F.lit(False)), "no verdict")
    judged = raw.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(a.alias("record_a"), b.alias("record_b"), F.upper(v).isin(*YES).alias("same"), "note")
    bad = judged.where("reason IS NOT NULL").select(F.coalesce("_bad", F.concat_ws(",", "record_a", "record_b", "verdict", "note")).alias("line"), "reason")
    return good, bad
