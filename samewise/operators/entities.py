"""Edges, gates, parts and entities: from accepted pairs to ids that stay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.decisions import pair_figures, ratio
from samewise.operators.graph import connected_components

#: How strong a reason for a merge is; fixed values.
BASIS = {"single": 0, "exact_key": 1, "score": 2, "model": 2, "veto": 3, "import": 4, "human": 5}
#: The order in which a gate names its reasons; fixed values.
GATES = ["conflict", "too_large", "mixed_names", "weak_link", "mixed_ids", "cross_track_ids"]


def rank(basis: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BASIS.items() for x in kv]), basis), F.lit(0))


def edge_table(accepted: DataFrame, human: DataFrame, stars: DataFrame) -> DataFrame:
    """(src, dst, source): accepted pairs, then human TRUE ones, then import stars, each pair once by the first of these; without human FALSE.

    accepted (id_l, id_r), human (id_l, id_r, same), stars (src, dst); ids compare as text.
    """
    parts = [(accepted, "id_l", "id_r", "score"), (human.where("same"), "id_l", "id_r", "human"), (stars, "src", "dst", "import")]
    every = None
    for order, (df, a, b, source) in enumerate(parts):
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        part = df.select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"), F.lit(order).alias("o"), F.lit(source).alias("source")).where("src <> dst")
        every = part if every is None else every.unionByName(part)
    once = every.groupBy("src", "dst").agg(F.min_by("source", "o").alias("source"))
    x, y = F.col("id_l").cast("string"), F.col("id_r").cast("string")
    no = human.where("NOT same").select(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    return once.join(no, ["src", "dst"], "left_anti")


def full_gate(members: DataFrame, pairs: DataFrame, human: DataFrame, names: Sequence[Sequence[str]] = (), limit: int = 1, max_units: int = 200, max_ids: int = 1, floor: float = 0.2, merged: DataFrame | None = None) -> DataFrame:
    """(cluster_id, n_units, status, statuses, withheld).

    members (unit_id, cluster_id, track, existing_id, names' columns); pairs
    (id_l, id_r, p), human-decided ones not among them; human (id_l, id_r,
    same); names: lists of columns of which the values joined may not differ
    more often than limit; merged: clusters (cluster_id) that a reviewer
    merged, for which only conflict and cross_track_ids count. Clusters of one
    unit are never flagged.
    """
    aggs = [F.count("*").alias("n_units"), F.count_distinct("existing_id").alias("n_ids")]
    for i, cols in enumerate(names):
        aggs.append(F.count_distinct(F.when(_all_there(cols), F.concat_ws("\x1f", *[F.col(c).cast("string") for c in cols]))).alias(f"names{i}"))
    per = members.groupBy("cluster_id").agg(*aggs)
    at = {s: members.select(F.col("unit_id").alias(f"id_{s}"), F.col("cluster_id").alias(f"c_{s}")) for s in "lr"}
    inside = lambda df: df.join(at["l"], "id_l").join(at["r"], "id_r").where("c_l = c_r")
    weak = inside(pairs).groupBy(F.col("c_l").alias("cluster_id")).agg(F.min("p").alias("weakest"))
    clash = inside(human.where("NOT same")).select(F.col("c_l").alias("cluster_id"), F.lit(True).alias("clash")).distinct()
    known = members.where("existing_id IS NOT NULL")
    both = known.groupBy("existing_id").agg(F.count_distinct("track").alias("t")).where("t > 1")
    cross = known.join(both, "existing_id", "left_semi").select("cluster_id", F.lit(True).alias("cross")).distinct()
    per = per.join(weak, "cluster_id", "left").join(clash, "cluster_id", "left").join(cross, "cluster_id", "left")
    per = per.join(merged.select("cluster_id", F.lit(True).alias("by_hand")).distinct(), "cluster_id", "left") if merged is not None else per.withColumn("by_hand", F.lit(None).cast("boolean"))
    mixed = F.lit(False)
    for i in range(len(names)):
        mixed = mixed | (F.col(f"names{i}") > limit)
    tests = {"conflict": F.col("clash"), "too_large": F.col("n_units") > max_units, "mixed_names": mixed, "weak_link": F.col("weakest") < floor, "mixed_ids": F.col("n_ids") > max_ids, "cross_track_ids": F.col("cross")}
    stays = {"conflict", "cross_track_ids"}
    free = ~F.coalesce("by_hand", F.lit(False))
    flags = F.array(*[F.when((F.col("n_units") >= 2) & tests[g] & (F.lit(True) if g in stays else free), F.lit(g)) for g in GATES])
    shown = F.filter(flags, lambda x: x.isNotNull())
    return per.withColumn("f", shown).select("cluster_id", "n_units", F.coalesce(F.get("f", F.lit(0)), F.lit("ok")).alias("status"), F.array_join("f", "|").alias("statuses"), (F.size("f") > 0).alias("withheld"))


def _all_there(cols: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull()
    return out


def rebuild_withheld(members: DataFrame, gate: DataFrame, edges: DataFrame) -> DataFrame:
    """(unit_id, part): the cluster where it passed; inside withheld ones, components over import and human edges alone."""
    m = members.join(gate.select("cluster_id", "withheld"), "cluster_id").select("unit_id", "cluster_id", "withheld")
    held = m.where("withheld").select("unit_id")
    strong = edges.where(F.col("source").isin("import", "human"))
    for s in ("src", "dst"):
        strong = strong.join(held.select(F.col("unit_id").alias(s)), s, "left_semi")
    cc = connected_components(strong.select("src", "dst")).withColumnRenamed("node", "unit_id")
    own = F.concat(F.lit("C-"), F.coalesce(F.col("component").cast("string"), F.col("unit_id").cast("string")))
    return m.join(cc, "unit_id", "left").select("unit_id", F.when(F.col("withheld"), own).otherwise(F.col("cluster_id")).alias("part"))


def part_source(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, source): the strongest edge inside each part."""
    a, b = (parts.select(F.col("unit_id").alias(k), F.col("part").alias(f"p_{k}")) for k in ("src", "dst"))
    inside = edges.join(a, "src").join(b, "dst").where("p_src = p_dst")
    return inside.groupBy(F.col("p_src").alias("part")).agg(F.max_by("source", F.struct(rank(F.col("source")), "source")).alias("source"))


def proposed(records: DataFrame, sources: DataFrame) -> DataFrame:
    """records (record_id, unit_id, entity_key) with basis: single where alone, exact_key where one unit holds all, else the strongest edge's source."""
    sizes = records.groupBy("entity_key").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("u"))
    src = sources.select(F.col("part").alias("entity_key"), "source")
    basis = F.when(F.col("n") == 1, "single").when(F.col("u") == 1, "exact_key").otherwise(F.coalesce("source", F.lit("score")))
    return records.join(sizes, "entity_key").join(src, "entity_key", "left").select("record_id", "unit_id", "entity_key", basis.alias("basis"))


def resolve_ids(members: DataFrame, registry: DataFrame, minted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_key, entity_id, id_status), (absorbed, survivor) from members (record_id, entity_key), registry (record_id, entity_id), minted (entity_key, entity_id).

    One claim of the registry is kept; of several the least survives and the
    others become its aliases; none gets the minted id.
    """
    claims = members.join(registry.select("record_id", F.col("entity_id").alias("claim")), "record_id").select("entity_key", "claim").distinct()
    best = claims.groupBy("entity_key").agg(F.min("claim").alias("survivor"), F.count("*").alias("claims"))
    keys = members.select("entity_key").distinct().join(best, "entity_key", "left").join(minted.select("entity_key", F.col("entity_id").alias("fresh")), "entity_key", "left")
    ids = keys.select("entity_key", F.coalesce("survivor", "fresh", "entity_key").alias("entity_id"), F.when(F.col("claims") == 1, "kept").when(F.col("claims") > 1, "merged").otherwise("minted").alias("id_status"))
    absorbed = claims.join(best, "entity_key").where("claim <> survivor").select(F.col("claim").alias("absorbed"), "survivor").distinct()
    return ids, absorbed


def break_collisions(ids: DataFrame) -> DataFrame:
    """(entity_key, entity_id, id_status): every id once.

    ids (entity_key, entity_id, id_status, from_registry, n_records,
    smallest_record). An id of the registry stays with the part of the least
    record; a minted one with the larger part, then the lesser record. Losers
    get their least record's id, numbered from -2 on where that is taken. An id
    not yet claimed by anybody is found by joins; only ids that clash go round.
    """
    order = [F.desc("from_registry"), F.when(F.col("from_registry"), F.lit(0)).otherwise(-F.col("n_records")), "smallest_record"]
    seen = ids.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
    won = seen.where("r = 1").select("entity_key", "entity_id", "id_status")
    lost = seen.where("r > 1").select("entity_key", F.col("smallest_record").alias("base"))
    # suffixes in use: claimed ids that read as a base or base-number of a loser
    names = ids.select("entity_id").unionByName(lost.select(F.col("base").alias("entity_id")))
    numbered = names.select(F.regexp_extract("entity_id", r"^(.*)-(\d{1,9})$", 1).alias("base"), F.regexp_extract("entity_id", r"-(\d{1,9})$", 1).try_cast("int").alias("k")).where("k >= 2")
    taken = numbered.unionByName(ids.select(F.col("entity_id").alias("base"), F.lit(1).alias("k")))
    used = taken.distinct().join(lost.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("k").alias("used"))
    nth = lost.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("entity_key"))).join(used, "base", "left").withColumn("used", F.coalesce("used", F.array().cast("array<int>")))
    # the n-th number from 1 that is not in use
    free = F.get(F.array_except(F.sequence(F.lit(1), F.col("n") + F.size("used")), "used"), F.col("n") - 1)
    named = nth.withColumn("k", free).select("entity_key", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("k").cast("string"))).alias("entity_id"), F.lit("minted_after_collision").alias("id_status"))
    return won.unionByName(named)


def mint_agreed(members: DataFrame, key: str, number: str, valid: str) -> DataFrame:
    """(key, agreed): the one number of the right form that all records agree on, else null."""
    good = F.when(F.col(number).rlike(valid), F.col(number))
    return members.groupBy(key).agg(F.count_distinct(good).alias("n"), F.min(good).alias("v")).select(key, F.when(F.col("n") == 1, F.col("v")).alias("agreed"))


def number_order(c: Column, trust: str = "TR") -> Column:
    """Ids in the order numbers, trusts' numbers after equal ones, then text; for min and sorting."""
    digits = F.regexp_replace(c, rf"^{trust}", "")
    n = digits.try_cast("long")
    return F.struct(n.isNull().alias("other"), n.alias("n"), c.startswith(trust).alias("trust"), c.alias("id"))


def vote_tally(rows: DataFrame, entity: str, column: str, top: int = 5) -> DataFrame:
    """(entity, votes): JSON of the most frequent values where there is more than one."""
    n = rows.where(F.col(column).isNotNull()).groupBy(entity, F.col(column).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(entity).orderBy(F.desc("n"), "value")
    ranked = n.withColumns({"r": F.row_number().over(w), "of": F.count("*").over(Window.partitionBy(entity))}).where((F.col("of") > 1) & (F.col("r") <= top))
    return ranked.groupBy(entity).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "n"))), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n")))).alias("votes"))


def invariants(entities: DataFrame) -> DataFrame:
    """One row (missing, repeated, crossed): records without an id, records named twice, ids on two tracks; all must be 0."""
    missing = entities.agg(F.count_if(F.col("entity_id").isNull()).alias("missing"))
    repeated = entities.groupBy("record_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
    crossed = entities.groupBy("entity_id").agg(F.count_distinct("track").alias("n")).agg(F.count_if(F.col("n") > 1).alias("crossed"))
    return missing.crossJoin(repeated).crossJoin(crossed)  # one row each


def plan_kinds(current: DataFrame, proposal: DataFrame) -> DataFrame:
    """(entity_id, kind): new, kept, merged (records of several old ones), split (old ones that gave records to several) or gone."""
    c = current.select("record_id", F.col("entity_id").alias("old"))
    p = proposal.select("record_id", F.col("entity_id").alias("new"))
    both = c.join(p, "record_id", "full_outer")
    by_new = both.where("new IS NOT NULL").groupBy("new").agg(F.count_distinct("old").alias("olds"))
    made = by_new.select(F.col("new").alias("entity_id"), F.when(F.col("olds") == 0, "new").when(F.col("olds") > 1, "merged").otherwise("kept").alias("kind"))
    by_old = both.where("old IS NOT NULL").groupBy("old").agg(F.count_distinct("new").alias("news"))
    lost = by_old.where("news <> 1").select(F.col("old").alias("entity_id"), F.when(F.col("news") == 0, "gone").otherwise("split").alias("kind"))
    return made.unionByName(lost)


def provenance(groups: DataFrame, accepted: DataFrame, members: DataFrame) -> DataFrame:
    """(entity_id, record_a, record_b, source): exact groups as stars from their least record, and accepted pairs whose sides share an entity."""
    heads = groups.groupBy("group_id").agg(F.min("record_id").alias("head"))
    stars = groups.join(heads, "group_id").where("record_id <> head").select(F.col("head").alias("record_a"), F.col("record_id").alias("record_b"), F.lit("exact_key").alias("source"))
    every = stars.unionByName(accepted.select("record_a", "record_b", "source"))
    a, b = (members.select(F.col("record_id").alias(f"record_{s}"), F.col("entity_id").alias(f"e{s}")) for s in "ab")
    return every.join(a, "record_a").join(b, "record_b").where("ea = eb").select(F.col("ea").alias("entity_id"), "record_a", "record_b", "source")


def provenance_chain(edges: DataFrame) -> DataFrame:
    """(entity_id, step, source, n) from the weakest source to the strongest."""
    n = edges.groupBy("entity_id", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("entity_id").orderBy(rank(F.col("source")), "source")
    return n.select("entity_id", F.row_number().over(w).alias("step"), "source", "n")


def dissolve(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """(record_id, group_id, split): merged groups under labels (record_a, record_b, same).

    A group with a TRUE and a FALSE label inside falls into the components of
    its TRUE labels; who is left alone has no group (null). One with FALSE
    alone stays, to be shown as a contradiction.
    """
    a, b = (groups.select(F.col("record_id").alias(f"record_{s}"), F.col("group_id").alias(f"g{s}")) for s in "ab")
    inside = labels.join(a, "record_a").join(b, "record_b").where("ga = gb").select("record_a", "record_b", "same", F.col("ga").alias("group_id"))
    split = inside.groupBy("group_id").agg(F.bool_or("same").alias("t"), F.bool_or(~F.col("same")).alias("f")).where("t AND f").select("group_id", F.lit(True).alias("split"))
    cc = connected_components(inside.where("same").join(split, "group_id", "left_semi"), "record_a", "record_b").withColumnRenamed("node", "record_id")
    out = groups.join(split, "group_id", "left").join(cc, "record_id", "left")
    fresh = F.when(F.col("component").isNotNull(), F.concat(F.lit("X-"), "component"))
    return out.select("record_id", F.when(F.col("split"), fresh).otherwise(F.col("group_id")).alias("group_id"), F.coalesce("split", F.lit(False)).alias("split"))


def against_earlier(members: DataFrame, record: str = "record_id", entity: str = "entity_id", earlier: str = "existing_id") -> DataFrame:
    """(entity, n_records, n_earlier, verdict): how each entity stands to the earlier ids of its records.

    identical: the records of just one earlier id, all of them; grown: those and
    new ones; divided: only some records of one; joined: records of several;
    new: of none. By counts of (entity, earlier id), no member list is gathered.
    """
    both = members.groupBy(entity, earlier).agg(F.count_distinct(record).alias("n"))
    whole = both.where(F.col(earlier).isNotNull()).groupBy(earlier).agg(F.sum("n").alias("of"))
    per = both.join(whole, earlier, "left").groupBy(entity).agg(
        F.sum("n").alias("n_records"), F.count(earlier).alias("n_earlier"), F.sum(F.when(F.col(earlier).isNull(), F.col("n")).otherwise(0)).alias("fresh"), F.bool_and(F.coalesce(F.col("n") == F.col("of"), F.lit(True))).alias("all_of")
    )
    ids = F.col("n_earlier")
    verdict = F.when(ids == 0, "new").when(ids > 1, "joined").when(~F.col("all_of"), "divided").when(F.col("fresh") > 0, "grown").otherwise("identical")
    return per.select(entity, "n_records", "n_earlier", verdict.alias("verdict"))


def entity_figures(members: DataFrame, record: str = "record_id", entity: str = "entity_id", earlier: str = "existing_id") -> DataFrame:
    """One row: pairs and precision and recall of entities against earlier ids, entities by verdict and the share that is identical."""
    figures = pair_figures(members, entity, earlier)
    verdicts = against_earlier(members, record, entity, earlier)
    names = ("identical", "grown", "divided", "joined", "new")
    counts = verdicts.agg(F.count("*").alias("entities"), *[F.count_if(F.col("verdict") == v).alias(v) for v in names])
    known = F.col("entities") - F.col("new")
    return figures.crossJoin(counts).withColumn("identical_share", ratio(F.col("identical"), known))  # one row each
