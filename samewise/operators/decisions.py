"""Buckets, vetoes, overlays, evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import blank_to_null, trim


def bucket(p: Column, review: float, accept: float) -> Column:
    """accept, review or reject; nulls and NaN are rejected."""
    known = F.when(~F.isnan(p), p)
    return F.when(known >= accept, "accept").when(known >= review, "review").otherwise("reject")


def veto(kind: str, left: Column, right: Column, value: float = 0.0, values: Sequence[str] = ()) -> Column:
    a, b = (F.upper(blank_to_null(trim(c.cast("string")))) for c in (left, right))
    gap = F.abs(left.cast("string").try_cast("double") - right.cast("string").try_cast("double"))
    sets = [F.filter(F.split(c, r"\s*\|\s*"), lambda x: x != "") for c in (a, b)]
    test = {
        "differs": lambda: a != b,
        "not_equal_or_missing": lambda: ~F.coalesce(a == b, F.lit(False)),
        "abs_diff_gt": lambda: gap > value,
        "abs_diff_gte": lambda: gap >= value,
        "both_in_and_differ": lambda: a.isin([v.upper() for v in values]) & b.isin([v.upper() for v in values]) & (a != b),
        "no_overlap": lambda: ~F.arrays_overlap(*sets),
    }[kind]()
    return F.coalesce(test, F.lit(False))


def apply_vetoes(pairs: DataFrame, vetoes: Sequence[tuple[str, Column, str]], bucket_col: str = "bucket") -> DataFrame:
    """bucket and veto_id after vetoes (id, test, action): reject beats review, the first of the strongest names it; review only takes acceptance back."""
    strong = F.lit(None).cast("string")
    for action in ("review", "reject"):
        for vid, test, act in reversed([v for v in vetoes if v[2] == action]):
            strong = F.when(test, F.lit(f"{act}:{vid}")).otherwise(strong)
    act = F.substring_index("veto", ":", 1)
    out = F.when(act == "reject", "reject").when((act == "review") & (F.col(bucket_col) == "accept"), "review").otherwise(F.col(bucket_col))
    return pairs.withColumn("veto", strong).withColumn(bucket_col, out).withColumn("veto_id", F.expr("substr(veto, instr(veto, ':') + 1)")).drop("veto")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.round(a / b, 6))


def pair_figures(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Pair precision and recall of groups against labels, by counting: n(n-1)/2 of each."""
    n2 = lambda d: d.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("p"))
    known = rows.where(F.col(label).isNotNull())
    both = n2(known.where(F.col(group).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))).withColumnRenamed("p", "true_pairs")
    found = n2(known.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))).withColumnRenamed("p", "found_pairs")
    real = n2(known.groupBy(label).agg(F.count("*").alias("n"))).withColumnRenamed("p", "label_pairs")
    one = both.crossJoin(found).crossJoin(real)  # one row each
    return one.withColumns({"precision": ratio(F.col("true_pairs"), F.col("found_pairs")), "recall": ratio(F.col("true_pairs"), F.col("label_pairs"))})


def histogram(rows: DataFrame, score: str, bins: int) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return rows.where(F.col(score).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The score interval of a share, within 0 and 1; nothing seen leaves all of it open."""
    p, zz = hits / n, z * z
    centre, spread = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - spread)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + spread)).otherwise(1.0)


def threshold_grid(rows: DataFrame, score: str, truth: str, steps: int = 20) -> DataFrame:
    """(threshold, predicted, hits, precision, precision_low, recall): counts by step, then sums from above; scores 0..1."""
    step = F.least(F.floor(F.col(score) * steps), F.lit(steps)).cast("long")
    counted = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum(F.col(truth).cast("long")).alias("h"))
    above = Window.orderBy(F.desc("step"))  # at most steps + 1 rows
    got = counted.select("step", F.sum("n").over(above).alias("predicted"), F.sum("h").over(above).alias("hits"), F.sum("h").over(Window.partitionBy(F.lit(1))).alias("every"))
    low, _ = wilson(F.col("hits"), F.col("predicted"))
    return got.select((F.col("step") / steps).alias("threshold"), "predicted", "hits", ratio(F.col("hits"), F.col("predicted")).alias("precision"), F.round(low, 6).alias("precision_low"), ratio(F.col("hits"), F.col("every")).alias("recall"))


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key that comes last."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(whole, F.col(order)).alias("row")).select("row.*")
