"""Features of pairs. A null says there is no evidence, and is never a zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SET = r"\s*\|\s*"


def parts(c: Column) -> Column:
    """The members of a ` | ` set."""
    return F.filter(F.split(c, SET), lambda x: x != "")


def both(l: Column, r: Column, value: Column) -> Column:
    return F.when(l.isNotNull() & r.isNotNull(), value)


def equal(l: Column, r: Column) -> Column:
    return (l == r).cast("double")


def differs(l: Column, r: Column) -> Column:
    return (l != r).cast("double")


def one_sided(l: Column, r: Column) -> Column:
    return (l.isNull() != r.isNull()).cast("double")


def set_jaccard(l: Column, r: Column) -> Column:
    a, b = parts(l), parts(r)
    union = F.size(F.array_union(a, b))
    return both(l, r, F.when(union > 0, F.size(F.array_intersect(a, b)) / union))


def shared(l: Column, r: Column) -> Column:
    return both(l, r, F.size(F.array_intersect(parts(l), parts(r))).cast("double"))


def any_shared(l: Column, r: Column) -> Column:
    return both(l, r, F.arrays_overlap(parts(l), parts(r)).cast("double"))


def single_conflict(l: Column, r: Column) -> Column:
    return both(l, r, ((F.size(parts(l)) == 1) & (F.size(parts(r)) == 1) & (l != r)).cast("double"))


def span_gap(first_l: Column, last_l: Column, first_r: Column, last_r: Column) -> Column:
    """Years between two spans; 0 where they meet."""
    known = first_l.isNotNull() & last_l.isNotNull() & first_r.isNotNull() & last_r.isNotNull()
    return F.when(known, F.greatest(F.lit(0), F.greatest(first_l, first_r) - F.least(last_l, last_r)).cast("double"))


def spans_overlap(first_l: Column, last_l: Column, first_r: Column, last_r: Column) -> Column:
    return (span_gap(first_l, last_l, first_r, last_r) == 0).cast("double")


def value_ratio(l: Column, r: Column) -> Column:
    return F.when((l > 0) & (r > 0), F.least(l, r) / F.greatest(l, r))


def quantile_distance(l: Column, r: Column, n: int = 5) -> Column:
    """The mean distance of two arrays of quantiles."""
    return both(l, r, F.aggregate(F.zip_with(l, r, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / n)


def kind_code(l: Column, r: Column, codes: dict[str, int], unknown: int, mixed: int) -> Column:
    """The code of the kind that both sides share, or the one for mixed kinds."""
    table = F.create_map(*[F.lit(x) for kv in sorted(codes.items()) for x in kv])
    a, b = (F.coalesce(F.try_element_at(table, F.lower(F.trim(c))), F.lit(unknown)) for c in (l, r))
    return F.when(a == b, a).otherwise(mixed).cast("double")


def log_sizes(l: Column, r: Column) -> tuple[Column, Column]:
    return F.log10(1 + F.least(l, r)), F.log10(1 + F.greatest(l, r))


def shared_features(l: str = "l", r: str = "r") -> dict[str, Column]:
    """The features that all tracks have, over <column>_l and <column>_r of unit profiles."""
    c = lambda n: (F.col(f"{n}_{l}"), F.col(f"{n}_{r}"))
    years = [F.col(f"{n}_{s}") for s in (l, r) for n in ("first_year", "last_year")]
    small, large = log_sizes(*c("unit_size"))
    n_l, n_r = c("n")
    share_l, share_r = c("share_round")
    return {
        "party_jaccard": set_jaccard(*c("parties")),
        "single_party_conflict": single_conflict(*c("parties")),
        "year_gap": span_gap(*years),
        "years_overlap": spans_overlap(*years),
        "median_ratio": value_ratio(*c("median_value")),
        "modal_equal": equal(*c("modal_value")),
        "shared_amounts": shared(*c("top_values")),
        "round_share_gap": F.abs(share_l - share_r),
        "quantile_distance": quantile_distance(*c("quantiles")),
        "both_single": ((n_l == 1) & (n_r == 1)).cast("double"),
        "log_size_min": small,
        "log_size_max": large,
    }


def amount_profile(rows: DataFrame, unit: str, value: str, round_to: int = 1000, top: int = 5) -> DataFrame:
    """(unit, n, median_value, modal_value, top_values, share_round, quantiles).

    Amounts are counted first, so the ranking sorts distinct amounts of a unit
    and never its rows; equal counts go to the larger amount.
    """
    v = F.col(value)
    counted = rows.where(v.isNotNull()).groupBy(unit, value).agg(F.count("*").alias("k"))
    best = counted.withColumn("r", F.row_number().over(Window.partitionBy(unit).orderBy(F.desc("k"), F.desc(value)))).where(F.col("r") <= top)
    tops = best.groupBy(unit).agg(F.max(F.when(F.col("r") == 1, v)).alias("modal_value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda s: F.format_number(s[value], 2)), " | ").alias("top_values"))
    logs = F.when(v > 0, F.log10(v + 1))
    whole = rows.groupBy(unit).agg(F.count(v).alias("n"), F.median(v).alias("median_value"), F.avg(F.when((v > 0) & (v % round_to == 0), 1.0).otherwise(0.0)).alias("share_round"), F.percentile(logs, F.array(*[F.lit(q) for q in (0.1, 0.25, 0.5, 0.75, 0.9)])).alias("quantiles"))
    return whole.join(tops, unit, "left")


def name_frequencies(rows: DataFrame, forename: str, surname: str) -> DataFrame:
    """(kind, forename, surname, n): forenames, surnames, pairs and the three totals, from one pass over the names."""
    f, s = F.col(forename), F.col(surname)
    sets = rows.select(f.alias("forename"), s.alias("surname")).groupingSets([("forename",), ("surname",), ("forename", "surname")], "forename", "surname")
    n = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # grouping_id: 1 has the forename alone, 2 the surname alone, 0 both
    kind = F.when(F.col("g") == 1, "forename").when(F.col("g") == 2, "surname").otherwise("full")
    keep = F.when(F.col("g") == 1, F.col("forename").isNotNull()).when(F.col("g") == 2, F.col("surname").isNotNull()).otherwise(F.col("forename").isNotNull() & F.col("surname").isNotNull())
    known = n.where(keep).select(kind.alias("kind"), "forename", "surname", "n")
    totals = known.groupBy("kind").agg(F.sum("n").alias("n")).select(F.concat(F.lit("total_"), "kind").alias("kind"), F.lit(None).cast("string").alias("forename"), F.lit(None).cast("string").alias("surname"), "n")
    return known.unionByName(totals)


def log_frequency(pairs: DataFrame, frequencies: DataFrame, left: str, right: str, kind: str) -> DataFrame:
    """pairs with <kind>_log_n: log10 of how often a name that both sides share occurs; null where they differ."""
    n = frequencies.where(F.col("kind") == kind).select(F.col(kind).alias("_name"), F.col("n").alias("_n"))
    out = pairs.withColumn("_name", F.when(F.col(left) == F.col(right), F.col(left))).join(n, "_name", "left")
    return out.withColumn(f"{kind}_log_n", F.when(F.col("_name").isNotNull(), F.log10(F.greatest(F.coalesce("_n", F.lit(1)), F.lit(1))))).drop("_name", "_n")


def co_controlled(pairs: DataFrame, holdings: DataFrame, unit: str, company: str) -> DataFrame:
    """pairs (id_l, id_r) with co: whether a third unit shares a company with each of both.

    Works on the companies of the pairs' units alone; both sides' neighbours
    meet in a join, and nothing is gathered or capped.
    """
    h = holdings.select(F.col(unit).alias("u"), F.col(company).alias("c")).distinct()
    ends = pairs.select(F.explode(F.array("id_l", "id_r")).alias("u")).distinct()
    reach = h.join(ends, "u", "left_semi").join(h.withColumnRenamed("u", "third"), "c").where("u <> third").select("u", "third").distinct()
    l, r = (reach.select(F.col("u").alias(f"id_{s}"), "third") for s in "lr")
    found = pairs.select("id_l", "id_r").join(l, "id_l").join(r, ["id_r", "third"]).select("id_l", "id_r", F.lit(1.0).alias("co")).distinct()
    return pairs.join(found, ["id_l", "id_r"], "left").withColumn("co", F.coalesce("co", F.lit(0.0)))


def training_set(sources: Sequence[tuple[str, DataFrame, float]], held_out: DataFrame) -> DataFrame:
    """(id_l, id_r, same, source, weight, split) of labelled pairs: the first source that has a pair names it; held-out pairs are test."""
    every = None
    for order, (name, df, weight) in enumerate(sources):
        part = df.select("id_l", "id_r", "same", F.lit(name).alias("source"), F.lit(weight).alias("weight"), F.lit(order).alias("o"))
        every = part if every is None else every.unionByName(part)
    one = every.groupBy("id_l", "id_r").agg(F.min_by(F.struct("same", "source", "weight"), "o").alias("x")).select("id_l", "id_r", "x.*")
    frozen = held_out.select("id_l", "id_r", F.lit("test").alias("split")).distinct()
    return one.join(frozen, ["id_l", "id_r"], "left").withColumn("split", F.coalesce("split", F.lit("train")))


def cap_by_hash(rows: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The n rows of the least hash: the same rows whatever the partitions. The cap is the operator's meaning."""
    return rows.orderBy(F.xxhash64(*keys), *keys).limit(n)
