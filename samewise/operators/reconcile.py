"""Do two names mean the same company? Rules on names and their core words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.companies import company_name, core_tokens
from samewise.plans.materialize import shuffle_partitions


#: verdict, confidence and reason of each rule, in order; the last if none holds.
TOLD = [
    ("TRUE", "high", "Exact match after normalization"),
    ("FALSE", "low", "Insufficient core tokens"),
    ("TRUE", "high", "Core tokens match"),
    ("TRUE", "medium", "One name subset of other"),
    ("FALSE", "medium", "Different core content"),
    ("TRUE", "medium", "High token overlap"),
    ("FALSE", "high", "Different core name tokens"),
    ("FALSE", "high", "Core names differ"),
]


def _rule(l: Column, r: Column, a: Column, b: Column, both: Column) -> Column:
    """The index in TOLD for two clean names, the numbers of their core words and of those they share."""
    tests = [l == r, (a == 0) | (b == 0), (both == a) & (both == b), ((both == a) | (both == b)) & (F.abs(a - b) <= 2), (both == a) | (both == b), both >= 0.8 * F.least(a, b), (both > 0) & (a > 1) & (b > 1)]
    out = F.lit(len(tests))
    for i, test in reversed(list(enumerate(tests))):
        out = F.when(test, i).otherwise(out)
    return out.cast("byte")


def _told(rule: Column) -> dict[str, Column]:
    return {n: F.element_at(F.array(*[F.lit(t[k]) for t in TOLD]), rule + 1) for k, n in enumerate(("verdict", "confidence", "reason"))}


def verdicts(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with verdict (TRUE / FALSE), confidence and reason."""
    rows = pairs.withColumns({"_l": company_name(F.col(left)), "_r": company_name(F.col(right))}).withColumns({"_a": core_tokens(F.col("_l")), "_b": core_tokens(F.col("_r"))})
    rule = _rule(F.col("_l"), F.col("_r"), F.size("_a"), F.size("_b"), F.size(F.array_intersect("_a", "_b")))
    return rows.withColumn("_v", rule).withColumns(_told(F.col("_v"))).select(*pairs.columns, "verdict", "confidence", "reason")


def _met(l: DataFrame, r: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of a block, id_l < id_r; dealt out in a given number of parts, since few bytes of rows make many pairs."""
    n = shuffle_partitions(l.sparkSession)
    return l.repartition(n, *by).hint("merge").join(r.repartition(n, *by), list(by)).where("id_l < id_r")


def _block_rules(rows: DataFrame, by: Sequence[str], id_col: str, left: str, right: str) -> DataFrame:
    """(id_l, id_r, rule) of the pairs of a block.

    The rules are applied to different names only: a left row brings the rule
    for each different name on the right, a byte each, and a pair takes its own.
    """
    side = lambda c, s: rows.select(*by, F.col(id_col).alias(f"id_{s}"), F.col(c).alias("name"))
    l, r = side(left, "l"), side(right, "r")
    clean = lambda d: d.select(*by, "name").distinct().withColumn("clean", company_name(F.col("name"))).withColumn("core", core_tokens(F.col("clean")))
    named = clean(r).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("name", "clean", "core"))).alias("names"))
    shared = lambda x: F.struct(x["clean"].alias("clean"), F.size(x["core"]).alias("b"), F.size(F.array_intersect(F.col("core"), x["core"])).alias("both"))
    judged = clean(l).join(named, list(by)).withColumn("names", F.transform("names", shared))
    rules = judged.select(*by, "name", F.transform("names", lambda x: _rule(F.col("clean"), x["clean"], F.size("core"), x["b"], x["both"])).alias("rules"))
    places = named.select(*by, F.posexplode("names").alias("place", "x")).select(*by, "place", F.col("x.name").alias("name"))
    of = lambda d, other: d.alias("d").join(other.alias("o"), [F.col(f"d.{c}") == F.col(f"o.{c}") for c in by] + [F.col("d.name").eqNullSafe(F.col("o.name"))])
    keys = [f"d.{c}" for c in by]
    pairs = _met(of(l, rules).select(*keys, "id_l", "rules"), of(r, places).select(*keys, "id_r", "place"), by)
    return pairs.select("id_l", "id_r", F.get("rules", F.col("place")).alias("rule"))


def block_verdicts(rows: DataFrame, by: Sequence[str], id_col: str, left: str, right: str) -> DataFrame:
    """(id_l, id_r, verdict, confidence, reason): verdicts() of the pairs of rows that agree in `by`, id_l < id_r."""
    return _block_rules(rows, by, id_col, left, right).select("id_l", "id_r", *[c.alias(n) for n, c in _told(F.col("rule")).items()])


def block_first_true(rows: DataFrame, by: Sequence[str], id_col: str, left: str, right: str) -> DataFrame:
    """(id_l, id_r, verdict): first_true() of block_verdicts() by id_l.

    The smallest id_r that is TRUE is sought first, one row an id; a second
    pass marks it, so no pair is ever shuffled. Where ids repeat they don't
    tell which of equal pairs is the first, so those go by first_true().
    """
    judged = _block_rules(rows, by, id_col, left, right)
    if not rows.groupBy(id_col).count().where("count > 1").isEmpty():
        return first_true(judged.select("id_l", "id_r", _told(F.col("rule"))["verdict"].alias("verdict")), "id_l", "id_r")
    yes = [i for i, t in enumerate(TOLD) if t[0] == "TRUE"]
    first = judged.where(F.col("rule").isin(yes)).groupBy(F.col("id_l").alias("of")).agg(F.min("id_r").alias("first"))
    l, r = (rows.select(*by, F.col(id_col).alias(f"id_{s}")) for s in "lr")
    marked = l.join(first, F.col("id_l") == F.col("of"), "left").select(*by, "id_l", "first")
    hit = F.coalesce(F.col("id_r") == F.col("first"), F.lit(False))
    return _met(marked, r, by).select("id_l", "id_r", F.when(hit, "TRUE").otherwise("FALSE").alias("verdict"))


def first_true(judged: DataFrame, group: str, order: str) -> DataFrame:
    """Of each group only its first TRUE stays TRUE."""
    w = Window.partitionBy(group, "verdict").orderBy(order)
    keep = (F.col("verdict") != "TRUE") | (F.row_number().over(w) == 1)
    return judged.withColumn("_keep", keep).withColumn("verdict", F.when(F.col("_keep"), F.col("verdict")).otherwise("FALSE")).drop("_keep")
