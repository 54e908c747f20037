"""What lies over scored pairs: lines of tracks and models, earlier ids, labels, reasons, reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import key_text
from samewise.operators.decisions import apply_vetoes, bucket


def track_bucket(p: Column, track: Column, review: float, accept: float, accept_by_track: Mapping[str, float]) -> Column:
    """The three-way bucket with a line of its own for some tracks."""
    out = bucket(p, review, accept)
    for name, line in sorted(accept_by_track.items()):
        out = F.when(track == name, bucket(p, review, line)).otherwise(out)
    return out


def model_bucket(pairs: DataFrame, score: str, review: float, accept: float) -> DataFrame:
    """A model's lines decide where it scored; elsewhere the bucket stays. decided_by tells which."""
    scored = F.col(score).isNotNull() & ~F.isnan(score)
    return pairs.withColumns({"bucket": F.when(scored, bucket(F.col(score), review, accept)).otherwise(F.col("bucket")), "decided_by": F.when(scored, "model").otherwise("score")})


def of_units(pairs: DataFrame, units: DataFrame, columns: Sequence[str], unit: str = "unit_id") -> DataFrame:
    """pairs with <c>_l and <c>_r of both units; two joins on the ids."""
    for s in "lr":
        side = units.select(F.col(unit).alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        pairs = pairs.join(side, f"id_{s}", "left")
    return pairs


def import_overlay(pairs: DataFrame, existing: str = "existing_id") -> DataFrame:
    """Pairs with <existing>_l/_r, bucket and veto_id: one earlier id on both sides accepts, even against a veto; two different ones are only flagged."""
    a, b = F.col(f"{existing}_l"), F.col(f"{existing}_r")
    agrees, differs = F.coalesce(a == b, F.lit(False)), F.coalesce(a != b, F.lit(False))
    vetoed = F.col("veto_id").isNotNull()
    return pairs.select(
        *[c for c in pairs.columns if c not in ("bucket", "decided_by")],
        F.when(agrees, "accept").otherwise(F.col("bucket")).alias("bucket"),
        F.when(agrees, "import").when(vetoed, "veto").otherwise(F.col("decided_by") if "decided_by" in pairs.columns else F.lit("score")).alias("decided_by"),
        differs.alias("import_disagrees"),
        (vetoed & agrees).alias("veto_conflicts_import"),
    )


LAID = ["bucket", "decided_by", "veto", "veto_id", "import_disagrees", "veto_conflicts_import"]


def rebucket(pairs: DataFrame, review: float, accept: float, vetoes: Sequence[tuple[str, Column, str]] = (), score: str = "match_probability", model: str | None = None, existing: str | None = None) -> DataFrame:
    """pairs with all that was laid over their scores made anew under other lines and vetoes; nothing is scored again.

    Stored scores, a stored model's too, come first; then vetoes; then earlier
    ids, where `existing` names their columns.
    """
    out = pairs.drop(*[c for c in LAID if c in pairs.columns]).withColumn("bucket", bucket(F.col(score), review, accept))
    out = model_bucket(out, model, review, accept) if model else out.withColumn("decided_by", F.lit("score"))
    out = apply_vetoes(out, vetoes)
    if existing:
        return import_overlay(out, existing)
    return out.withColumn("decided_by", F.when(F.col("veto_id").isNotNull(), "veto").otherwise(F.col("decided_by")))


def held_tag(pairs: DataFrame, held: str = "held_group_id") -> DataFrame:
    """The held group that both sides stand in, or null."""
    l, r = F.col(f"{held}_l"), F.col(f"{held}_r")
    return pairs.withColumn(held, F.when(l == r, l))


def priority(left: Column, right: Column) -> Column:
    n = lambda c: F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
    return n(left) + n(right)


def veto_reason(template: str, left: Column, right: Column) -> Column:
    """The template with {left} and {right} filled in; whole numbers lose their .0, nulls read as nothing."""
    text = lambda c: F.coalesce(F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0$", "$1"), F.lit(""))
    return F.replace(F.replace(F.lit(template), F.lit("{left}"), text(left)), F.lit("{right}"), text(right))


def veto_report(pairs: DataFrame, vetoes: Sequence[tuple[str, Column]], bucket_col: str = "bucket", examples: int = 3) -> DataFrame:
    """(veto_id, hits, would_accept, examples): one pass; a veto that never hits has a row of zeros."""
    hit = F.array(*[F.struct(F.lit(v).alias("veto_id"), F.coalesce(t, F.lit(False)).alias("hit")) for v, t in vetoes])
    name = F.concat_ws("|", "id_l", "id_r")
    long = pairs.select(name.alias("pair"), F.col(bucket_col).alias("b"), F.explode(hit).alias("v")).select("pair", "b", "v.veto_id", "v.hit")
    counted = long.groupBy("veto_id").agg(F.count_if("hit").alias("hits"), F.count_if(F.col("hit") & (F.col("b") == "accept")).alias("would_accept"))
    first = long.where("hit").withColumn("r", F.row_number().over(Window.partitionBy("veto_id").orderBy("pair"))).where(F.col("r") <= examples)
    shown = first.groupBy("veto_id").agg(F.array_join(F.array_sort(F.collect_list("pair")), " ").alias("examples"))
    return counted.join(shown, "veto_id", "left").select("veto_id", "hits", "would_accept", F.coalesce("examples", F.lit("")).alias("examples"))


def label_unit_pairs(labels: DataFrame, members: DataFrame) -> DataFrame:
    """labels (record_a, record_b, same) as (id_l, id_r, same, same_unit) of units; labels with an unknown record go."""
    m = members.select(F.col("record_id").cast("string").alias("record_id"), F.col("unit_id").cast("string").alias("unit_id"))
    a, b = (m.select(F.col("record_id").alias(f"record_{s}"), F.col("unit_id").alias(f"u{s}")) for s in "ab")
    text = labels.select(*[c for c in labels.columns if c not in ("record_a", "record_b")], *[F.col(c).cast("string").alias(c) for c in ("record_a", "record_b")])
    out = text.join(a, "record_a").join(b, "record_b")
    return out.withColumns({"id_l": F.least("ua", "ub"), "id_r": F.greatest("ua", "ub"), "same_unit": F.col("ua") == F.col("ub")}).drop("ua", "ub")


def label_outcome(same: Column, same_unit: Column) -> Column:
    """applied between units; inside one, satisfied by TRUE and contradicted by FALSE."""
    return F.when(~same_unit, "applied").when(same, "satisfied").otherwise("contradiction")


def forced_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled pairs of different units that no score has, with a null score and bucket reject."""
    new = labels.where(F.col("id_l") != F.col("id_r")).select("id_l", "id_r").distinct().join(pairs.select("id_l", "id_r"), ["id_l", "id_r"], "left_anti")
    return new.select("id_l", "id_r", F.lit(None).cast("double").alias("match_probability"), F.lit("reject").alias("bucket"))


def repoint(pairs: DataFrame, moved: DataFrame) -> DataFrame:
    """pairs (id_l, id_r, match_probability, rescored) after units moved (old, new): pairs inside one unit go, of doubles the best score stays, rescored holds if it held for all."""
    new = pairs
    for s in "lr":
        new = new.join(moved.select(F.col("old").alias(f"id_{s}"), F.col("new").alias(f"n_{s}")), f"id_{s}", "left").withColumn(f"n_{s}", F.coalesce(f"n_{s}", f"id_{s}"))
    lo, hi = F.least("n_l", "n_r"), F.greatest("n_l", "n_r")
    return new.where("n_l <> n_r").groupBy(lo.alias("id_l"), hi.alias("id_r")).agg(F.max("match_probability").alias("match_probability"), F.every("rescored").alias("rescored"))


def usefulness(p: Column, model: Column | None, total: Column, largest: Column) -> Column:
    """Uncertainty and disagreement of two scores, weighed by the log of the priority over that of the largest; without a largest the weight is one."""
    best = p if model is None else F.coalesce(model, p)
    doubt = 1 - F.abs(2 * F.coalesce(best, F.lit(0.0)) - 1)
    apart = F.lit(0.0) if model is None else F.coalesce(F.abs(model - p), F.lit(0.0))
    share = F.when(largest > 0, F.log1p(F.greatest(total, F.lit(0.0))) / F.log1p(largest)).otherwise(1.0)
    return (0.5 * doubt + 0.5 * apart) * (0.5 + 0.5 * F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def agreement(left: Column, right: Column) -> Column:
    """agrees, disagrees or unknown from two single earlier ids."""
    a, b = key_text(left), key_text(right)
    return F.coalesce(F.when(a == b, "agrees").when(a != b, "disagrees"), F.lit("unknown"))


def never_scored(units: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """Units that were not there, or were of another size, when pairs were scored."""
    return units.select("unit_id", "unit_size").join(fingerprint.select("unit_id", "unit_size"), ["unit_id", "unit_size"], "left_anti")


def existing_ids(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """(unit, ids, existing_id): the distinct trimmed earlier ids, sorted; a single one only where there is exactly one."""
    v = F.trim(F.col(label).cast("string"))
    per = rows.groupBy(unit).agg(F.array_sort(F.collect_set(F.when(v != "", v))).alias("s"))
    return per.select(unit, F.when(F.size("s") > 0, F.array_join("s", " | ")).alias("ids"), F.when(F.size("s") == 1, F.get("s", F.lit(0))).alias("existing_id"))


def test_set(labels: DataFrame, n: int, verdict: str = "same", order: str = "label_id") -> DataFrame:
    """labels with held_out: of each verdict the newest, at most half of its labels and half of n."""
    newest = Window.partitionBy(verdict).orderBy(F.desc(order))
    counts = labels.groupBy(verdict).agg(F.count("*").alias("of"))
    picked = labels.join(F.broadcast(counts), verdict).withColumn("r", F.row_number().over(newest))
    return picked.withColumn("held_out", (F.col("r") <= F.expr("of div 2")) & (F.col("r") <= n // 2)).drop("r", "of")


def label_log(log: DataFrame, keys: Sequence[str] = ("record_a", "record_b"), order: str = "label_id") -> DataFrame:
    """The append-only log with active, superseded_by and the held-out mark that a pair keeps once it has it."""
    by = Window.partitionBy(*keys).orderBy(order)
    nxt = F.lead(order).over(by)
    kept = F.max(F.coalesce(F.col("held_out"), F.lit(False))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumns({"superseded_by": nxt, "active": nxt.isNull(), "held_out": kept})


def decision_labels(parts: DataFrame) -> DataFrame:
    """parts (scope, part, record_id) as (scope, record_a, record_b, same): a TRUE star in each part, FALSE between the parts' least records."""
    p = parts.select("scope", "part", F.trim(F.col("record_id").cast("string")).alias("record_id")).where("record_id <> ''").distinct()
    heads = p.groupBy("scope", "part").agg(F.min("record_id").alias("head"))
    stars = p.join(heads, ["scope", "part"]).where("record_id <> head").select("scope", F.col("head").alias("record_a"), F.col("record_id").alias("record_b"), F.lit(True).alias("same"))
    a, b = (heads.select("scope", F.col("head").alias(f"record_{s}")) for s in "ab")
    apart = a.join(b, "scope").where("record_a < record_b").withColumn("same", F.lit(False))
    return stars.unionByName(apart)
