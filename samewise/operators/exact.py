"""Exact-match grouping by tiered keys with guards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.operators.conditions import when_all
from samewise.operators.graph import connected_components
from samewise.plans.materialize import save

GROUPS = "record_id string, group_id string, status string, key_ids string, guard string"


@dataclass
class MatchKey:
    id: str
    columns: Sequence[str]
    tier: int = 1
    when: Sequence[dict] = field(default_factory=list)
    allow_null: bool = False
    blocked: Sequence[str] = field(default_factory=list)
    no_earlier_key: bool = False
    max_group_size: int | None = None
    max_distinct: tuple[str, int] | None = None
    review: bool = True
    require_any: Sequence[str] = field(default_factory=list)  # a passing group falls into parts that share a value in one of these


def eligible(records: DataFrame, key: MatchKey):
    ok = when_all(records, key.when)
    for c in key.columns:
        v = F.col(f"`{c}`").cast("string")
        if not key.allow_null:
            ok = ok & v.isNotNull() & (F.trim(v) != "")
        if key.blocked:
            ok = ok & ~F.coalesce(F.upper(F.trim(v)).isin([b.upper() for b in key.blocked]), F.lit(False))
    return ok


def key_members(records: DataFrame, keys: Sequence[MatchKey], id_col: str = "record_id") -> DataFrame:
    """(key_id, head, record_id, guard) for every group of at least two records of any key; guard says which limit failed, if any.

    Every key aggregates by its values before anything is joined; only the
    values of real groups are joined back, and a group's rows are never
    gathered.
    """
    keys = sorted(keys, key=lambda k: k.tier)
    if not keys:
        return records.sparkSession.createDataFrame([], "key_id string, head string, record_id string, guard string")
    out, earlier = None, {}
    for key in keys:
        before = [c for t, c in earlier.items() if t < key.tier]
        ok = eligible(records, key)
        own = ok
        if key.no_earlier_key:
            for c in before:
                own = own & ~c
        earlier[key.tier] = earlier.get(key.tier, F.lit(False)) | ok
        names = [f"k{i}" for i in range(len(key.columns))]
        extra = [F.col(f"`{key.max_distinct[0]}`").alias("distinct_of")] if key.max_distinct else []
        extra += [F.col(f"`{c}`").cast("string").alias(f"any{i}") for i, c in enumerate(key.require_any)]
        rows = records.where(own).select(F.col(id_col).cast("string").alias("record_id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(key.columns, names, strict=True)], *extra)
        agg = [F.count("*").alias("n"), F.min("record_id").alias("head")]
        if key.max_distinct:
            agg.append(F.count_distinct("distinct_of").alias("d"))
        groups = rows.groupBy(*names).agg(*agg).where("n >= 2")
        guard = F.lit(None).cast("string")
        if key.max_distinct:
            guard = F.when(F.col("d") > key.max_distinct[1], F.concat(F.lit(f"max_distinct:{key.max_distinct[0]}="), F.col("d"), F.lit(f">{key.max_distinct[1]}")))
        if key.max_group_size is not None:
            guard = F.when(F.col("n") > key.max_group_size, F.concat(F.lit("max_group_size:"), F.col("n"), F.lit(f">{key.max_group_size}"))).otherwise(guard)
        groups = groups.select(*names, "head", guard.alias("guard"))
        if not key.review:
            groups = groups.where("guard IS NULL")
        on = F.lit(True)
        for n in names:
            on = on & (F.col(f"r.{n}").eqNullSafe(F.col(f"g.{n}")) if key.allow_null else F.col(f"r.{n}") == F.col(f"g.{n}"))
        joined = rows.alias("r").join(groups.alias("g"), on)
        part = joined.select(F.lit(key.id).alias("key_id"), F.col("g.head").alias("head"), F.col("r.record_id").alias("record_id"), F.col("g.guard").alias("guard"))
        if key.require_any:
            part = part.where("guard IS NOT NULL").unionByName(_corroborated(joined.where(F.col("g.guard").isNull()), key))
        out = part if out is None else out.unionByName(part)
    return out


def _corroborated(joined: DataFrame, key: MatchKey) -> DataFrame:
    """The parts of passing groups that share a value in a corroborating column; a record that shares none leaves."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"r.any{i}").alias("v")) for i in range(len(key.require_any))]))
    long = joined.select(F.col("g.head").alias("head"), F.col("r.record_id").alias("record_id"), values.alias("x")).where("x.v IS NOT NULL AND trim(x.v) <> ''")
    per = long.groupBy("head", "x").agg(F.min("record_id").alias("first"))
    # one star per shared value: a record stands in one group of a key, so records alone name the nodes
    cc = connected_components(long.join(per, ["head", "x"]).where("record_id <> first"), "first", "record_id")
    return cc.select(F.lit(key.id).alias("key_id"), F.col("component").alias("head"), F.col("node").alias("record_id"), F.lit(None).cast("string").alias("guard"))


def exact_groups(records: DataFrame, keys: Sequence[MatchKey], id_col: str = "record_id") -> DataFrame:
    """(record_id, group_id, status, key_ids, guard): merged groups `X-<least id>` over all keys, held ones `H-<key>-<least id>`."""
    members = save(key_members(records, keys, id_col), "exact-members")
    passed = members.where("guard IS NULL")
    cc = connected_components(passed, "head", "record_id")
    order = {k.id: i for i, k in enumerate(keys)}
    rank = F.create_map(*[F.lit(x) for kv in (order or {"": 0}).items() for x in kv])
    per_key = passed.withColumn("o", F.element_at(rank, F.col("key_id")))
    ids = per_key.join(cc.withColumnRenamed("node", "record_id"), "record_id").groupBy("component").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("o", "key_id"))), lambda s: s["key_id"]), "|").alias("key_ids"))
    merged = cc.join(ids, "component").select(F.col("node").alias("record_id"), F.concat(F.lit("X-"), "component").alias("group_id"), F.lit("merged").alias("status"), "key_ids", F.lit(None).cast("string").alias("guard"))
    held = members.where("guard IS NOT NULL").select("record_id", F.concat(F.lit("H-"), "key_id", F.lit("-"), "head").alias("group_id"), F.lit("held").alias("status"), F.col("key_id").alias("key_ids"), "guard")
    return merged.unionByName(held)


def units(records: DataFrame, groups: DataFrame, id_col: str = "record_id") -> DataFrame:
    """(record_id, unit_id): a merged group is one unit named by its least id, everybody else one alone."""
    merged = groups.where("status = 'merged'").select("record_id", F.expr("substr(group_id, 3)").alias("unit"))
    return records.select(F.col(id_col).cast("string").alias("record_id")).join(merged, "record_id", "left").select("record_id", F.coalesce("unit", "record_id").alias("unit_id"))


def modal_values(rows: DataFrame, unit: str, column: str, id_col: str = "record_id") -> DataFrame:
    """(unit, column): the most frequent value that isn't null; of equals the one of the least id."""
    votes = rows.where(F.col(column).isNotNull()).groupBy(unit, column).agg(F.count("*").alias("n"), F.min(id_col).alias("first"))
    return votes.groupBy(unit).agg(F.min_by(column, F.struct(-F.col("n"), "first")).alias(column))
