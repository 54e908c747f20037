"""Pages, facets, queues and details over the tables of a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.overlays import agreement, of_units


def page(rows: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 50, where: Column | None = None, columns: Sequence[str] = (), costly: bool = False) -> DataFrame:
    """One page in a given order, its last key unique so that pages neither overlap nor leave gaps; the limit is the page.

    costly: what `where` reads is worked out once a row. As a filter it would
    be pushed below that, with all of it anew at each mention; so rows that it
    leaves out come after all others, and go from the page.
    """
    if where is not None and costly:
        marked = rows.withColumn("_in", F.coalesce(where, F.lit(False)))
        return marked.orderBy(F.desc("_in"), *order).offset(offset).limit(limit).where("_in").select(*(columns or rows.columns))
    out = rows if where is None else rows.where(where)
    return (out.select(*columns, *[c for c in _names(order) if c not in columns]) if columns else out).orderBy(*order).offset(offset).limit(limit).select(*(columns or out.columns))


def _names(order: Sequence[Column | str]) -> list[str]:
    return [c for c in order if isinstance(c, str)]


def facets(rows: DataFrame, tests: Mapping[str, Column], distinct: Mapping[str, str] | None = None) -> DataFrame:
    """One row for the whole run: total, a count for each test, distinct values of a column."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(t).alias(n) for n, t in tests.items()], *[F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()])


def by_kind(rows: DataFrame, kind: str, sums: Mapping[str, str] | None = None, total: str | None = None) -> DataFrame:
    """(kind, n, ...): rows and sums for each kind; with `total`, a row of that name for all kinds together."""
    aggs = [F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()]]
    if total is None:
        return rows.groupBy(kind).agg(*aggs)
    out = rows.rollup(kind).agg(F.grouping(kind).alias("_all"), *aggs)
    return out.withColumn(kind, F.when(F.col("_all") == 1, total).otherwise(F.col(kind))).drop("_all")


def queue(members: DataFrame, group: str, member: str, least: int = 2) -> DataFrame:
    """(group, n_units, representative): groups of at least so many members, their smallest member for a face."""
    return members.groupBy(group).agg(F.count("*").alias("n_units"), F.min(member).alias("representative")).where(F.col("n_units") >= least)


def held_queue(members: DataFrame, group: str, track: str, over: int) -> DataFrame:
    """(group, track, n_records) of groups that are too large to be taken whole."""
    return members.groupBy(group).agg(F.min(track).alias("track"), F.count("*").alias("n_records")).where(F.col("n_records") > over)


def detail(members: DataFrame, group: str, order: Sequence[Column | str], shown: int) -> DataFrame:
    """members of every group, as many as a page shows, with `truncated` where it has more."""
    w = Window.partitionBy(group).orderBy(*order)
    out = members.withColumns({"_r": F.row_number().over(w), "truncated": F.count("*").over(Window.partitionBy(group)) > shown})
    return out.where(F.col("_r") <= shown).drop("_r")


def representatives(members: DataFrame, group: str, member: str, newest: str) -> DataFrame:
    """(group, representative, n_records, latest)."""
    return members.groupBy(group).agg(F.min(member).alias("representative"), F.count("*").alias("n_records"), F.to_date(F.max(newest)).alias("latest"))


def group_list(members: DataFrame, group: str, label: str, most: int, least: int = 2) -> DataFrame:
    """(group, n_records, n_labels, agreement) of groups: a conflict from more than `most` different labels on."""
    out = members.groupBy(group).agg(F.count("*").alias("n_records"), F.count_distinct(label).alias("n_labels")).where(F.col("n_records") >= least)
    return out.withColumn("agreement", F.when(F.col("n_labels") > most, "conflict").otherwise("consistent"))


def entities(members: DataFrame, entity: str, values: Mapping[str, str], largest: str, separator: str = " | ") -> DataFrame:
    """(entity, n_records, <values>, largest): what the list of entities shows."""
    joined = [F.array_join(F.array_sort(F.collect_set(c)), separator).alias(n) for n, c in values.items()]
    return members.groupBy(entity).agg(F.count("*").alias("n_records"), *joined, F.max(largest).alias("largest"))


def by_decision(labels: DataFrame, decision: Column, label_id: Column, truth: Column) -> DataFrame:
    """(decision, n, n_true): labels of one decision together, every other label by itself."""
    key = F.coalesce(decision, F.concat(F.lit("label:"), label_id))
    return labels.groupBy(key.alias("decision")).agg(F.count("*").alias("n"), F.count_if(truth).alias("n_true"))


def library_counts(labels: DataFrame, same: str = "same", record: str = "record_a") -> DataFrame:
    """One row: labels, those that say yes and no, and the records that they are about."""
    return labels.agg(F.count("*").alias("total"), F.count_if(F.col(same)).alias("n_true"), F.count_if(~F.col(same)).alias("n_false"), F.count_distinct(record).alias("records"))


def latest_override(events: DataFrame, scope: str, value: str, order: str) -> DataFrame:
    """(scope, value, override_id, superseded): the override that holds and how many it took the place of."""
    return events.groupBy(scope).agg(F.max_by(value, order).alias("value"), F.max(order).alias("override_id"), (F.count("*") - 1).alias("superseded"))


def union_tracks(tracks: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of all tracks under the columns of all: what a track lacks is null."""
    out = None
    for name, rows in tracks.items():
        rows = rows.withColumn("track", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def pairs_index(pairs: DataFrame, units: DataFrame, names: Sequence[str], existing: str = "existing_id", unit: str = "unit_id") -> DataFrame:
    """pairs with both units' names and whether their earlier ids agree: what the list of pairs is read from, sorted by score for range reads."""
    wide = of_units(pairs, units, [*names, existing], unit)
    out = wide.withColumn("agreement", agreement(F.col(f"{existing}_l"), F.col(f"{existing}_r")))
    return out.drop(f"{existing}_l", f"{existing}_r")


def band(score: Column, edges: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> Column:
    """The number of the band that a score lies in, from 0; an edge belongs to the band above it."""
    out = F.lit(0)
    for k, e in enumerate(sorted(edges), 1):
        out = F.when(score >= e, k).otherwise(out)
    return F.when(score.isNotNull(), out)


def batches(sizes: Sequence[tuple[str, int]], about: int) -> list[list[str]]:
    """Whole groups, in the given order, put together until a batch has about so many rows: a batch ends before the group that would take it over, unless that is its first."""
    out, held = [], 0
    for name, n in sizes:
        if not out or held + n > about:
            out.append([])
            held = 0
        out[-1].append(name)
        held += n
    return out
