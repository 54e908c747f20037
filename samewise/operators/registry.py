"""Labels, overlays, the registry of entities and its publish plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.plans.materialize import save


def ordered_pair(a: Column, b: Column) -> Column:
    """struct(lo, hi) of two ids as text; null for blanks and for equal ids."""
    x, y = (F.trim(c.cast("string")) for c in (a, b))
    ok = (x != "") & (y != "") & (x != y)
    return F.when(ok, F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")))


def human_overlay(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs (id_l, id_r, bucket) under labels (id_l, id_r, same): TRUE accepts, FALSE rejects; labelled pairs that aren't there are added without a score."""
    l = labels.select("id_l", "id_r", "same")
    out = pairs.join(l, ["id_l", "id_r"], "full_outer")
    return out.withColumn("decided_by", F.when(F.col("same").isNotNull(), "human").otherwise("score")).withColumn("bucket", F.when(F.col("same"), "accept").when(~F.col("same"), "reject").otherwise(F.col("bucket"))).drop("same")


def decision_star(parts: DataFrame, part: str, member: str) -> DataFrame:
    """(src, dst): each part's least member to its others."""
    heads = parts.groupBy(part).agg(F.min(member).alias("src"))
    return parts.join(heads, part).where(F.col(member) != F.col("src")).select("src", F.col(member).alias("dst"))


def resolve_aliases(aliases: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, survivor): the end of each chain (id, alias_of), by doubling; a chain that never ends raises."""
    ends = save(aliases.select("id", F.col("alias_of").alias("survivor")), "aliases")
    for _ in range(rounds):
        nxt = ends.alias("a").join(ends.select(F.col("id").alias("survivor"), F.col("survivor").alias("further")), "survivor", "left")
        if nxt.where("further IS NOT NULL").isEmpty():
            return ends
        if not nxt.where("further = id").isEmpty():
            raise ValueError("aliases run in a circle")
        ends = save(nxt.select("id", F.coalesce("further", "survivor").alias("survivor")), "aliases")
    raise ValueError("an alias chain is too long")


def publish_plan(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """(record_id, action) from (record_id, entity_id): new, kept, moved or gone."""
    c, p = (d.select("record_id", F.col("entity_id").alias(n)) for d, n in ((current, "old"), (proposed, "new")))
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(F.col("old") == F.col("new"), "kept").otherwise("moved")
    return c.join(p, "record_id", "full_outer").select("record_id", action.alias("action"))
