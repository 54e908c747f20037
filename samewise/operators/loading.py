"""From raw rows to records and events: what is dropped, ids, projections, what a record says of its events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import id_text, trim


def drop_counts(rows: DataFrame, reasons: Mapping[str, Column]) -> DataFrame:
    """One row: total, and dropped_<reason> for each, counted in one pass; a null test drops nothing."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(test).alias(f"dropped_{name}") for name, test in reasons.items()])


def stable_key(parts: Sequence[Column], length: int = 16) -> Column:
    """A key that a row keeps from one delivery to the next: the start of a digest over its parts, nulls as empty text."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def json_fields(rows: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """rows with a text column for each path into a JSON column; null where the path leads nowhere."""
    return rows.withColumns({name: F.get_json_object(F.col(column), path) for name, path in fields.items()})


def projected(rows: DataFrame, columns: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """The columns of a record under their own names; the scan reads no more than they need."""
    return (rows if where is None else rows.where(where)).select(*[c.alias(name) for name, c in columns.items()])


def namespaced_id(number: Column, kind: Column, spaces: Mapping[str, str]) -> Column:
    """The id text of a number behind the prefix of its kind; null without a number, so equal numbers of two kinds stay two records."""
    n = id_text(number)
    prefix = F.lit("")
    for name, p in spaces.items():
        prefix = F.when(F.lower(trim(kind)) == name.lower(), p).otherwise(prefix)
    return F.when(n != "", F.concat(F.coalesce(prefix, F.lit("")), n))


def review_state(earlier: Column, blanks: Sequence[str] = ("", "0", "TR0")) -> Column:
    """unlabelled where no earlier id stands."""
    return F.when(F.coalesce(F.upper(id_text(earlier)).isin(*blanks), F.lit(True)), "unlabelled").otherwise("labelled")


def event_projection(events: DataFrame, unit: str, columns: Mapping[str, Column], newest: str, key: str, most: int | None = None) -> DataFrame:
    """The columns of a unit's events with their position, the newest first; `most` is a page's size and no cap on what is kept."""
    w = Window.partitionBy(unit).orderBy(F.desc_nulls_last(newest), key)
    out = events.select(unit, key, *[c.alias(n) for n, c in columns.items() if n not in (unit, key)], F.row_number().over(w).alias("position"))
    return out if most is None else out.where(F.col("position") <= most)


def repeated_ids(rows: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """The first ids that more than one row has, to be named in a complaint."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").orderBy(key).limit(shown)


def distinct_join(rows: DataFrame, unit: str, columns: Mapping[str, str], separator: str = " | ") -> DataFrame:
    """(unit, <name>...): the distinct values of each column, sorted and joined."""
    return rows.groupBy(unit).agg(*[F.array_join(F.array_sort(F.collect_set(c)), separator).alias(name) for name, c in columns.items()])


def year_range(rows: DataFrame, unit: str, day: str, amount: str | None = None) -> DataFrame:
    """(unit, first_year, last_year, n[, total]); the sum is exact to four places."""
    y = F.year(day).cast("long")
    total = [F.sum(F.col(amount).cast("decimal(28,4)")).cast("double").alias("total")] if amount else []
    return rows.groupBy(unit).agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"), F.count("*").alias("n"), *total)


def unit_sum(rows: DataFrame, unit: str, amount: str, name: str = "priority") -> DataFrame:
    """(unit, name): an exact sum whatever the order of rows."""
    return rows.groupBy(unit).agg(F.round(F.sum(F.col(amount).cast("decimal(28,4)")).cast("double"), 2).alias(name))
