"""Clusters with gates, entities and consensus."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.graph import connected_components


def import_stars(units: DataFrame, unit: str, label: str) -> DataFrame:
    """(src, dst): every labelled unit to the least unit of its label."""
    known = units.where(F.col(label).isNotNull()).select(F.col(unit).alias("dst"), F.col(label).alias("label"))
    heads = known.groupBy("label").agg(F.min("dst").alias("src"))
    return known.join(heads, "label").where("src <> dst").select("src", "dst")


def clusters(units: DataFrame, edges: DataFrame, unit: str = "unit_id") -> DataFrame:
    """(unit_id, cluster_id): `C-` and the least unit reachable over (src, dst)."""
    cc = connected_components(edges)
    return units.select(F.col(unit).alias("unit_id")).distinct().join(cc.withColumnRenamed("node", "unit_id"), "unit_id", "left").select("unit_id", F.concat(F.lit("C-"), F.coalesce("component", "unit_id")).alias("cluster_id"))


def gate(members: DataFrame, scored: DataFrame, max_units: int = 200, max_ids: int = 1, floor: float = 0.2) -> DataFrame:
    """(cluster_id, n_units, status, statuses): members (unit_id, cluster_id, existing_id), scored (src, dst, p).

    Clusters of one unit are never flagged. All statuses joined by `|` in a
    fixed order; the first is the main one.
    """
    per = members.groupBy("cluster_id").agg(F.count("*").alias("n_units"), F.count_distinct("existing_id").alias("n_ids"))
    l, r = (members.select(F.col("unit_id").alias(k), F.col("cluster_id").alias(f"c_{k}")) for k in ("src", "dst"))
    inside = scored.join(l, "src").join(r, "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("cluster_id")).agg(F.min("p").alias("weakest"))
    flags = [(F.col("n_units") > max_units, "too_large"), (F.col("weakest") < floor, "weak_link"), (F.col("n_ids") > max_ids, "mixed_ids")]
    names = F.filter(F.array(*[F.when((F.col("n_units") >= 2) & t, F.lit(n)) for t, n in flags]), lambda x: x.isNotNull())
    return per.join(inside, "cluster_id", "left").withColumn("f", names).select("cluster_id", "n_units", F.coalesce(F.get("f", F.lit(0)), F.lit("ok")).alias("status"), F.array_join("f", "|").alias("statuses"))


def consensus(rows: DataFrame, entity: str, column: str) -> DataFrame:
    """(entity, value, basis, n_votes): majority; equal counts are a tie that goes to the least value; a lone record keeps its own."""
    votes = rows.where(F.col(column).isNotNull()).groupBy(entity, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    best = votes.groupBy(entity).agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), F.max("n").alias("top"), F.sum("n").alias("n_votes"), F.collect_list("n").alias("ns"))
    tied = F.size(F.filter("ns", lambda x: x == F.col("top"))) > 1
    return best.select(entity, "value", F.when(F.col("n_votes") == 1, "single").when(tied, "tie").otherwise("majority").alias("basis"), "n_votes")


def mint(entities: DataFrame, key: str, prefix: str = "E") -> DataFrame:
    """(key, entity_id): consecutive numbers over the sorted keys, counted by ranges so no task sorts all of them."""
    spark = entities.sparkSession
    keys = entities.select(key).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)
    part = keys.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    from samewise.plans.materialize import save

    part = save(part, "mint")
    before = part.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).select("part", "first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.col("base") + F.col("at") - F.col("first") + 1
    return part.join(F.broadcast(before), "part").select(key, F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0")).alias("entity_id"))


def unit_profile(members: DataFrame, unit: str, aggregates: Mapping[str, Column], allowed: Sequence[str]) -> DataFrame:
    """(unit, <name>...): columns of a unit that a vote among its records would get wrong, by aggregates that a profile names.

    Only columns that records carry (`allowed`) may be made. Aggregates combine
    before the shuffle, so a unit of any size is never gathered.
    """
    foreign = sorted(set(aggregates) - set(allowed))
    if foreign:
        raise ValueError(f"records have no column {', '.join(foreign)}")
    return members.groupBy(unit).agg(*[a.alias(name) for name, a in aggregates.items()])


def controller_profile(members: DataFrame, unit: str, company: str, name: str = "n_companies") -> DataFrame:
    """(unit, n_companies): on how many companies a controller stands."""
    return unit_profile(members, unit, {name: F.count_distinct(company)}, [name])
