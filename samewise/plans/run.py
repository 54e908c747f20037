"""One run from raw records to entities: clean, exact match, units, blocking, scores, overlays, clusters, gates, ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators import blocking, clusters, decisions, entities, exact, overlays, scoring
from samewise.operators.conditions import clean
from samewise.plans.materialize import save


@dataclass
class Ruleset:
    """What a run does. Records have record_id; `columns` are what a unit has of its records, by vote."""

    columns: Sequence[str]
    match_keys: Sequence[exact.MatchKey]
    rules: Sequence[Sequence[str]]
    comparisons: Sequence[scoring.Comparison]
    steps: Sequence[dict] = field(default_factory=list)
    vetoes: Callable[[], Sequence[tuple[str, Column, str]]] = list  # over <column>_l and <column>_r
    existing: str | None = None  # the column of earlier ids
    track: str | None = None
    review: float = 0.5
    accept: float = 0.9
    prior: float = 0.01
    floor: float = 0.2
    max_units: int = 200
    max_ids: int = 1
    max_block_size: int = 5_000
    max_pairs: int = 500_000_000
    model: scoring.Model | None = None  # a trained one is used as it is


@dataclass
class Run:
    """The tables of a run, each written once."""

    records: DataFrame
    groups: DataFrame
    units: DataFrame
    members: DataFrame
    pairs: DataFrame
    gate: DataFrame
    entities: DataFrame
    absorbed: DataFrame
    model: scoring.Model


def make_units(records: DataFrame, groups: DataFrame, columns: Sequence[str], existing: str | None) -> tuple[DataFrame, DataFrame]:
    """(record_id, unit_id) and units (unit_id, unit_size, <columns>, existing_id): most frequent values, ties to the least record."""
    members = save(exact.units(records, groups), "run-members")
    rows = records.withColumn("record_id", F.col("record_id").cast("string")).join(members, "record_id")
    out = rows.groupBy("unit_id").agg(F.count("*").alias("unit_size"))
    for c in columns:
        out = out.join(exact.modal_values(rows, "unit_id", c), "unit_id", "left")
    if existing is None:
        return members, out.withColumn("existing_id", F.lit(None).cast("string"))
    return members, out.join(overlays.existing_ids(rows, "unit_id", existing).select("unit_id", "existing_id"), "unit_id", "left")


def score_pairs(units: DataFrame, rules: Ruleset) -> tuple[DataFrame, scoring.Model]:
    """(id_l, id_r, match_weight, match_probability): pairs of all rules, once each, after their number has been counted and found bearable."""
    blocking.check_budget(units, rules.rules, rules.max_pairs, rules.max_block_size)
    made = blocking.pairs(units, rules.rules, "unit_id", sorted({c.column for c in rules.comparisons}))
    levels = save(scoring.gammas(made, rules.comparisons), "run-levels")
    model = rules.model or scoring.train(scoring.gamma_counts(levels, rules.comparisons), rules.comparisons, rules.prior)
    return scoring.score(levels, rules.comparisons, model).select("id_l", "id_r", "match_weight", "match_probability"), model


def decide(pairs: DataFrame, units: DataFrame, rules: Ruleset, labels: DataFrame) -> DataFrame:
    """pairs with bucket, veto_id and decided_by: the lines, then vetoes, then one earlier id on both sides, then people (id_l, id_r, same)."""
    wide = overlays.of_units(pairs, units, [*rules.columns, "existing_id"])
    wide = wide.withColumn("bucket", decisions.bucket(F.col("match_probability"), rules.review, rules.accept))
    laid = overlays.import_overlay(decisions.apply_vetoes(wide, list(rules.vetoes())))
    people = labels.groupBy("id_l", "id_r").agg(F.bool_and("same").alias("same"))
    out = laid.select("id_l", "id_r", "match_probability", "bucket", "veto_id", "decided_by").join(people, ["id_l", "id_r"], "left")
    told = F.col("same").isNotNull()
    return out.withColumns({"bucket": F.when(told, F.when(F.col("same"), "accept").otherwise("reject")).otherwise(F.col("bucket")), "decided_by": F.when(told, "human").otherwise(F.col("decided_by"))}).drop("same")


def resolve(raw: DataFrame, rules: Ruleset, labels: DataFrame | None = None, registry: DataFrame | None = None) -> Run:
    """All tables of a run over raw records.

    labels: (record_a, record_b, same) by people. registry: (record_id,
    entity_id) as published, whose ids stay where they can. Without pairs or
    labels every unit is an entity; no records give empty tables.
    """
    spark = raw.sparkSession
    records = save(clean(raw, rules.steps).withColumn("record_id", F.col("record_id").cast("string")), "run-records")
    groups = save(exact.exact_groups(records, rules.match_keys), "run-groups")
    members, units = make_units(records, groups, rules.columns, rules.existing)
    units = save(units, "run-units")
    pairs, model = score_pairs(units, rules)
    labels = spark.createDataFrame([], "record_a string, record_b string, same boolean") if labels is None else labels
    told = overlays.label_unit_pairs(labels, members).where("NOT same_unit").select("id_l", "id_r", "same").distinct()
    pairs = save(decide(pairs, units, rules, told), "run-pairs")
    # what people or earlier ids decide has edges of their own, which hold where a cluster is withheld
    accepted = pairs.where("bucket = 'accept' AND decided_by NOT IN ('human', 'import')")
    edges = save(entities.edge_table(accepted, told, clusters.import_stars(units, "unit_id", "existing_id")), "run-edges")
    own = units.select("unit_id", "existing_id", (F.col(rules.track) if rules.track else F.lit("all")).alias("track"))
    grouped = save(clusters.clusters(own, edges).join(own, "unit_id"), "run-clusters")
    scored = pairs.where("decided_by <> 'human'").select("id_l", "id_r", F.col("match_probability").alias("p"))
    gate = save(entities.full_gate(grouped, scored, told, max_units=rules.max_units, max_ids=rules.max_ids, floor=rules.floor), "run-gate")
    parts = save(entities.rebuild_withheld(grouped.select("unit_id", "cluster_id"), gate.select("cluster_id", "withheld"), edges), "run-parts")
    placed = members.join(parts, "unit_id").select("record_id", "unit_id", F.col("part").alias("entity_key"))
    proposed = save(entities.proposed(placed, entities.part_source(parts, edges)), "run-proposed")
    published = spark.createDataFrame([], "record_id string, entity_id string") if registry is None else registry.select(F.col("record_id").cast("string").alias("record_id"), F.col("entity_id").cast("string").alias("entity_id"))
    minted = clusters.mint(proposed, "entity_key")
    ids, absorbed = entities.resolve_ids(proposed, published, minted)
    sizes = proposed.groupBy("entity_key").agg(F.count("*").alias("n_records"), F.min("record_id").alias("smallest_record"))
    named = entities.break_collisions(ids.join(sizes, "entity_key").withColumn("from_registry", F.col("id_status") != "minted"))
    out = save(proposed.join(named, "entity_key").select("record_id", "unit_id", "entity_key", "entity_id", "id_status", "basis"), "run-entities")
    return Run(records, groups, units, members, pairs, gate, out, absorbed, model)
