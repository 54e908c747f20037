"""Linking two tables: exact first, then by blocks; ambiguity, merged table, reviewed overrides."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import collapse_spaces

UNKNOWN = "UNKNOWN"


def map_categories(rows: DataFrame, column: str, categories: Mapping[str, str], target: str = "category") -> DataFrame:
    """target by the map, blanks UNKNOWN; a value that the map lacks stops the run and is named."""
    key = F.upper(collapse_spaces(F.col(column)))
    table = F.create_map(*[F.lit(x) for k, v in sorted(categories.items()) for x in (k.upper(), v)])
    blank = key.isNull() | (key == "")
    missing = rows.where(~blank & F.try_element_at(table, key).isNull()).select(key.alias("v")).distinct().orderBy("v").limit(20).collect()
    if missing:
        raise ValueError(f"categories without a place: {', '.join(r.v for r in missing)}")
    return rows.withColumn(target, F.when(blank, UNKNOWN).otherwise(F.try_element_at(table, key)))


def exact_link(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matched rows, and what is left of both sides; nulls match nothing."""
    return left.join(right, list(on)), left.join(right.select(*on).distinct(), list(on), "left_anti"), right.join(left.select(*on).distinct(), list(on), "left_anti")


def link_pairs(left: DataFrame, right: DataFrame, category: str = "category", core: str = "core") -> DataFrame:
    """(id_l, id_r): of one category that is known, or of one core name that isn't blank; each pair once, by two equality joins."""
    l, r = (d.select(F.col("id").alias(f"id_{s}"), F.col(category).alias(f"{category}_{s}"), F.col(core).alias(f"{core}_{s}")) for d, s in ((left, "l"), (right, "r")))
    cat = (F.col(f"{category}_l") == F.col(f"{category}_r")) & (F.col(f"{category}_l") != UNKNOWN)
    by_core = l.join(r, (F.col(f"{core}_l") == F.col(f"{core}_r")) & (F.col(f"{core}_l") != "")).where(~F.coalesce(cat, F.lit(False)))
    return l.join(r, cat).unionByName(by_core).select("id_l", "id_r")


def linked_classes(left: DataFrame, right: DataFrame, key: Callable[[Column], Column], category: str = "category", core: str = "core") -> tuple[DataFrame, DataFrame]:
    """The pairs of link_pairs() between classes of rows: (id_l, class) for every left row, and (class, id_l, id_r, n).

    Rows of one category, core name and key(id) are a class; id_l and id_r are
    the smallest ids of two classes that meet, n the rows of the right one. So
    rows are made for classes that meet, however many pairs stand behind them.
    """
    side = lambda d, s: d.select("id", F.col(category).alias(f"category_{s}"), F.col(core).alias(f"core_{s}"), key(F.col("id")).alias(f"key_{s}"))
    of = F.struct("category_l", "core_l", "key_l").alias("class")
    ids, rows = side(left, "l"), side(right, "r")
    l = ids.groupBy("category_l", "core_l", "key_l").agg(F.min("id").alias("id_l"))
    r = rows.groupBy("category_r", "core_r", "key_r").agg(F.min("id").alias("id_r"), F.count("*").alias("n"))
    whole = r.groupBy("category_r", "key_r").agg(F.min("id_r").alias("id_r"), F.sum("n").alias("n"))
    cat = (F.col("category_l") == F.col("category_r")) & (F.col("category_l") != UNKNOWN)
    by_core = l.join(r, (F.col("core_l") == F.col("core_r")) & (F.col("core_l") != "")).where(~F.coalesce(cat, F.lit(False)))
    met = l.join(whole, cat).select(of, "id_l", "id_r", "n").unionByName(by_core.select(of, "id_l", "id_r", "n"))
    return ids.select(F.col("id").alias("id_l"), of), met


def _best(rows: DataFrame, group: str) -> DataFrame:
    """The best of each group's rows (id_r, p, m, n, n_high), m rows of a score in one: with the p that comes next, and n and n_high of the whole group."""
    w, every = Window.partitionBy(group).orderBy(F.desc("p"), "id_r"), Window.partitionBy(group)
    after = F.when(F.col("m") > 1, F.col("p")).otherwise(F.lead("p").over(w))
    return rows.withColumns({"r": F.row_number().over(w), "next": after, "n": F.sum("n").over(every), "n_high": F.sum("n_high").over(every)}).where("r = 1")


def _bucketed(best: DataFrame, high: float, review: float, gap: float) -> DataFrame:
    near = (F.col("n_high") > 1) & (F.col("p") - F.col("next") < gap)
    return best.select("id_l", "id_r", "p", F.when(F.col("p") >= high, "high").when(F.col("p") >= review, "review").otherwise("low").alias("bucket"), F.col("n").alias("n_candidates"), F.coalesce(near, F.lit(False)).alias("ambiguous"))


def best_candidates(scored: DataFrame, high: float = 0.7, review: float = 0.4, gap: float = 0.05) -> DataFrame:
    """(id_l, id_r, p, bucket, n_candidates, ambiguous): the best of each left row; ambiguous with two high ones too near."""
    one = F.lit(1).cast("long")
    rows = scored.select("id_l", "id_r", "p", one.alias("m"), one.alias("n"), F.when(F.col("p") >= high, one).otherwise(0).alias("n_high"))
    return _bucketed(_best(rows, "id_l"), high, review, gap)


def best_of_classes(ids: DataFrame, scored: DataFrame, high: float = 0.7, review: float = 0.4, gap: float = 0.05) -> DataFrame:
    """best_candidates() of the pairs that stand behind linked_classes(): ids (id_l, class), scored (class, id_r, p, n).

    p has to be that of all pairs of two classes. A left row only needs its
    class's best candidate, what comes next and the numbers of all; an id that
    stands in several classes has those of each.
    """
    top = _best(scored.select("class", "id_r", "p", F.col("n").alias("m"), "n", F.when(F.col("p") >= high, F.col("n")).otherwise(0).alias("n_high")), "class")
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long").alias("m")
    first = F.struct("id_r", "p", one, "n", "n_high")
    second = F.struct("id_r", F.col("next").alias("p"), one, none.alias("n"), none.alias("n_high"))
    two = top.select("class", F.explode(F.when(F.col("next").isNull(), F.array(first)).otherwise(F.array(first, second))).alias("c"))
    return _bucketed(_best(ids.join(two, "class").select("id_l", "c.*"), "id_l"), high, review, gap)


def merged(left: DataFrame, exact: DataFrame, best: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(id_l, match, method): every left row; a reviewed TRUE pair beats exact, exact beats the score; without any the method is none.

    exact (id_l, id_r), best (id_l, id_r), reviewed (id_l, id_r, same).
    """
    yes = reviewed.where("same").groupBy("id_l").agg(F.min("id_r").alias("by_hand"))
    one = exact.groupBy("id_l").agg(F.min("id_r").alias("by_name"))
    out = left.select(F.col("id").alias("id_l")).join(yes, "id_l", "left").join(one, "id_l", "left").join(best.select("id_l", F.col("id_r").alias("by_score")), "id_l", "left")
    method = F.when(F.col("by_hand").isNotNull(), "reviewed").when(F.col("by_name").isNotNull(), "exact").when(F.col("by_score").isNotNull(), "score").otherwise("none")
    return out.select("id_l", F.coalesce("by_hand", "by_name", "by_score").alias("match"), method.alias("method"))
