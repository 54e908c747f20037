"""What a pair's features are: each has its value, what it says and how it may push a score, in one place."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import jaro_winkler_col
from samewise.functions.text import fingerprint, house_number, words
from samewise.operators import features as X


@dataclass(frozen=True)
class Feature:
    """monotone: 1 may only raise a score, -1 only lower it, 0 either. A category has words for its codes and no direction."""

    name: str
    value: Column
    label: str
    group: str
    monotone: int = 0
    null_when: str | None = None
    categories: tuple[str, ...] = ()
    kind: str = "number"

    def __post_init__(self):
        if self.categories and self.monotone:
            raise ValueError(f"{self.name}: codes have no order, so no direction")
        if self.kind not in WORDS:
            raise ValueError(f"{self.name}: no way to say a {self.kind}")

    def say(self, value: float | None) -> str:
        """The value in words."""
        if value is None or value != value:
            return f"nothing: {self.null_when}" if self.null_when else "nothing"
        if self.categories:
            return self.categories[int(value)] if 0 <= int(value) < len(self.categories) else f"code {int(value)}"
        return WORDS[self.kind](value)


def _times(n: float, one: str) -> str:
    return f"{n:.0f} {one}" if round(n) == 1 else f"{n:.0f} {one}s"


WORDS: Mapping[str, Callable[[float], str]] = {
    "number": lambda v: f"{v:.2f}",
    "bits": lambda v: f"{v:.2f} bits",
    "similarity": lambda v: f"{v:.2f} of 1",
    "share": lambda v: f"{100 * v:.0f} %",
    "flag": lambda v: "yes" if v else "no",
    "count": lambda v: f"{v:.0f}",
    "years": lambda v: "no gap" if not v else _times(v, "year"),
    "log_records": lambda v: _times(10**v - 1, "record"),
    "log_people": lambda v: f"{10**v - 1:.0f} people",
    "category": lambda v: f"code {v:.0f}",
}


def build(pairs: DataFrame, wanted: Sequence[Feature], keys: Sequence[str] = ("id_l", "id_r")) -> DataFrame:
    """The keys and a double for each feature; a feature whose columns the pairs lack can't be built and is named."""
    names = [f.name for f in wanted]
    if len(set(names)) < len(names):
        raise ValueError("two features of one name")
    return pairs.select(*keys, *[f.value.cast("double").alias(f.name) for f in wanted])


def generic(pairs: DataFrame, weight: str = "match_weight", prefix: str = "gamma_") -> list[Feature]:
    """The match weight and the comparison levels that say anything: a level that is null in every pair is left out, by one pass over the pairs."""
    levels = [c for c in pairs.columns if c.startswith(prefix)]
    seen = pairs.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in levels]).head().asDict() if levels else {}
    own = [Feature(weight, F.col(weight), "Match weight", "score", 1, kind="bits")] if weight in pairs.columns else []
    return own + [Feature(c, F.col(f"`{c}`"), c.removeprefix(prefix), "score", kind="count") for c in levels if seen[c]]


def _sides(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}_l"), F.col(f"{name}_r")


def alike(name: str) -> Column:
    """Jaro-Winkler of both sides; what is equal needs no Python."""
    l, r = _sides(name)
    return F.when(l == r, 1.0).otherwise(jaro_winkler_col(F.when(l != r, l), r))


def _flag(test: Column) -> Column:
    return test.cast("double")


def _initials(name: str) -> tuple[Column, Column]:
    l, r = _sides(name)
    return F.substring(l, 1, 1), F.substring(r, 1, 1)


def _table(values: Mapping[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv]), c) if values else F.lit(None).cast("string")


def _jaccard(l: Column, r: Column) -> Column:
    union = F.size(F.array_union(l, r))
    return F.when(l.isNotNull() & r.isNotNull() & (union > 0), F.size(F.array_intersect(l, r)) / union)


def donor_person(genders: Mapping[str, str]) -> list[Feature]:
    """Features of two donors who are people. genders: of titles. The pairs have <kind>_n_l and _r, how many bear the name, from with_frequencies()."""
    fl, fr = _sides("forename")
    short = ((F.length(fl) == 1) | (F.length(fr) == 1)) & (F.substring(fl, 1, 1) == F.substring(fr, 1, 1))
    il, ir = _initials("middle_names")
    gl, gr = (_table(genders, c) for c in _sides("title"))
    pl, pr = (words(c) for c in _sides("post_nominals"))
    return [
        Feature("name_similarity", alike("name"), "Whole name similarity", "name", 1, "one side has no name", kind="similarity"),
        Feature("forename_equal", X.equal(fl, fr), "Same forename", "name", 1, "one side has no forename", kind="flag"),
        Feature("forename_initial", X.both(fl, fr, _flag(short)), "One forename is the other's initial", "name", 0, "one side has no forename", kind="flag"),
        Feature("forename_canon_equal", X.equal(*_sides("forename_canon")), "Same forename after nicknames", "name", 1, "one side has no forename", kind="flag"),
        Feature("middle_initial_equal", X.equal(il, ir), "Same middle initial", "name", 1, "one side has no middle name", kind="flag"),
        Feature("middle_initial_differs", X.differs(il, ir), "Middle initials differ", "name", -1, "one side has no middle name", kind="flag"),
        Feature("gender_differs", X.differs(gl, gr), "Titles of different gender", "name", -1, "a title says no gender", kind="flag"),
        Feature("post_nominals_shared", X.both(*_sides("post_nominals"), _flag(F.arrays_overlap(pl, pr))), "Shared letters after the name", "name", 1, "one side has none", kind="flag"),
        Feature("surname_log_n", _rarity("surname", ("surname",)), "How common the commoner surname is", "name", -1, "a surname is missing, or there is no table of names", kind="log_people"),
        Feature("full_log_n", _rarity("full", ("surname", "forename")), "How common the commoner full name is", "name", -1, "a name is missing, or there is no table of names", kind="log_people"),
    ]


def _rarity(kind: str, needs: Sequence[str]) -> Column:
    there = F.lit(True)
    for n in needs:
        l, r = _sides(n)
        there = there & l.isNotNull() & r.isNotNull()
    l, r = (F.coalesce(c, F.lit(0)) for c in _sides(f"{kind}_n"))
    return F.when(there & F.col("has_frequencies"), F.log10(1 + F.greatest(l, r)))


def with_frequencies(pairs: DataFrame, frequencies: DataFrame | None) -> DataFrame:
    """pairs with surname_n and full_n of both sides, from (kind, forename, surname, n), and has_frequencies; without a table the features are null, not zero."""
    out = pairs.withColumn("has_frequencies", F.lit(frequencies is not None))
    for side in "lr":
        for kind, by in (("surname", ["surname"]), ("full", ["forename", "surname"])):
            name = f"{kind}_n_{side}"
            if frequencies is None:
                out = out.withColumn(name, F.lit(None).cast("long"))
                continue
            n = frequencies.where(F.col("kind") == kind).select(*[F.col(c).alias(f"{c}_{side}") for c in by], F.col("n").alias(name))
            out = out.join(n, [f"{c}_{side}" for c in by], "left")
    return out


def natures(events: DataFrame, unit: str, nature: str) -> DataFrame:
    """(unit, natures): the distinct natures of each unit's events, blanks left out; distinct rows first, so a unit's events are never gathered."""
    n = F.col(nature).cast("string")
    return events.where(n.isNotNull() & (F.trim(n) != "")).select(unit, n.alias("n")).distinct().groupBy(unit).agg(F.array_sort(F.collect_list("n")).alias("natures"))


def donor_organisation() -> list[Feature]:
    """Features of two donors that are organisations; name_tfidf is the pairs' own column, from training.cosine()."""
    cl, cr = _sides("company_number")
    tl, tr = (F.array_distinct(words(c)) for c in _sides("name_core"))
    return [
        Feature("core_similarity", alike("name_core"), "Core name similarity", "name", 1, "one side has no name", kind="similarity"),
        Feature("core_jaccard", X.both(*_sides("name_core"), _jaccard(tl, tr)), "Shared words of the core names", "name", 1, "one side has no name", kind="share"),
        Feature("core_tfidf", F.col("core_tfidf"), "Shared words, rare ones weighted", "name", 1, kind="similarity"),
        Feature("postcode_equal", X.equal(*_sides("postcode")), "Same postcode", "place", 1, "one side has no postcode", kind="flag"),
        Feature("district_equal", X.equal(*_sides("district")), "Same postcode district", "place", 1, "one side has no postcode", kind="flag"),
        Feature("number_equal", X.equal(cl, cr), "Same company number", "number", 1, "one side has none", kind="flag"),
        Feature("number_differs", X.differs(cl, cr), "Company numbers differ", "number", -1, "one side has none", kind="flag"),
        Feature("number_one_sided", X.one_sided(cl, cr), "One side alone has a company number", "number", kind="flag"),
        Feature("form_equal", X.equal(*_sides("legal_form")), "Same legal form", "kind", 1, "one side has no legal form", kind="flag"),
        Feature("status_equal", X.equal(*_sides("status")), "Same kind of donor", "kind", 1, "one side has no status", kind="flag"),
        Feature("nature_jaccard", _jaccard(*_sides("natures")), "Shared natures of donations", "gifts", 1, "one side has no natures", kind="share"),
    ]


def shared_companies(pairs: DataFrame, holdings: DataFrame, unit: str, company: str) -> DataFrame:
    """pairs with shared_companies: on how many companies both sides stand.

    Both sides' companies meet in equality joins; no unit's set is gathered, so none is cut.
    """
    h = holdings.select(F.col(unit).alias("u"), F.col(company).alias("c")).where("u IS NOT NULL AND c IS NOT NULL").distinct()
    l, r = (h.select(F.col("u").alias(f"id_{s}"), "c") for s in "lr")
    n = pairs.select("id_l", "id_r").distinct().join(l, "id_l").join(r, ["id_r", "c"]).groupBy("id_l", "id_r").agg(F.count("*").alias("_n"))
    return pairs.join(n, ["id_l", "id_r"], "left").withColumn("shared_companies", F.coalesce("_n", F.lit(0)).cast("double")).drop("_n")


def _both_kinds() -> list[Feature]:
    """What both kinds of controllers have at the end."""
    return [
        Feature("same_company", _flag(F.col("shared_companies") > 0), "Both control one company", "companies", 1, kind="flag"),
        Feature("shared_companies", F.col("shared_companies"), "Companies that both control", "companies", 1, kind="count"),
        Feature("size_min", F.least(*_sides("unit_size")), "Records of the smaller side", "size", kind="count"),
        Feature("size_max", F.greatest(*_sides("unit_size")), "Records of the larger side", "size", kind="count"),
    ]


def controller_person() -> list[Feature]:
    """Features of two people with control of companies; the pairs have shared_companies and co, and the frequencies of with_frequencies()."""
    full = [F.trim(F.concat_ws(" ", F.col(f"forename_{s}"), F.col(f"surname_{s}"))) for s in "lr"]
    same_surname, same_fore = (F.coalesce(alike(n) >= 1, F.lit(False)) for n in ("surname", "forename"))
    known = lambda kind: F.log10(F.greatest(F.coalesce(F.col(f"{kind}_n_l"), F.lit(1)), F.lit(1)))
    year_l, year_r = _sides("birth_year")
    return [
        Feature("surname_similarity", alike("surname"), "Surname similarity", "name", 1, "one side has no surname", kind="similarity"),
        Feature("forename_similarity", alike("forename"), "Forename similarity", "name", 1, "one side has no forename", kind="similarity"),
        Feature("middle_similarity", alike("middle"), "Middle name similarity", "name", 0, "one side has no middle name", kind="similarity"),
        Feature("middle_differs", X.differs(*_sides("middle")), "Middle names differ", "name", -1, "one side has no middle name", kind="flag"),
        Feature("letters_equal", _flag(F.coalesce((fingerprint(full[0]) == fingerprint(full[1])) & (full[0] != ""), F.lit(False))), "Same words in any order", "name", 1, kind="flag"),
        Feature("surname_log_n", F.when(same_surname & F.col("has_frequencies"), known("surname")), "How common the shared surname is", "name", -1, "the surnames differ, or there is no table of names", kind="log_people"),
        Feature("full_log_n", F.when(same_surname & same_fore & F.col("has_frequencies"), known("full")), "How common the shared full name is", "name", -1, "the names differ, or there is no table of names", kind="log_people"),
        Feature("birth_month_equal", X.equal(*_sides("birth_month")), "Same birth month", "birth", 1, "one side has no date of birth", kind="flag"),
        Feature("birth_year_gap", F.abs(year_l - year_r), "Years between the birth years", "birth", -1, "one side has no birth year", kind="years"),
        Feature("birth_missing", _flag(year_l.isNull() | year_r.isNull()), "One side has no birth year", "birth", kind="flag"),
        Feature("nationality_equal", X.equal(*_sides("nationality")), "Same nationality", "person", 1, "one side has none", kind="flag"),
        Feature("residence_equal", X.equal(*_sides("residence")), "Same country of residence", "person", 1, "one side has none", kind="flag"),
        Feature("postcode_equal", X.equal(*_sides("postcode")), "Same postcode", "place", 1, "one side has no postcode", kind="flag"),
        Feature("district_equal", X.equal(*_sides("district")), "Same postcode district", "place", 1, "one side has no postcode", kind="flag"),
        Feature("address_similarity", alike("address"), "First address line similarity", "place", 1, "one side has no address line", kind="similarity"),
        Feature("co_controller", F.col("co"), "They share a co-controller", "companies", 1, kind="flag"),
        Feature("notified_gap", F.abs(F.date_diff(*_sides("notified_on"))), "Days between the notifications", "companies", 0, "one side has no date", kind="number"),
        *_both_kinds(),
    ]


def controller_organisation() -> list[Feature]:
    """Features of two organisations with control of companies; core_tfidf and shared_companies are the pairs' own columns."""
    holding_l, holding_r = (F.coalesce(c.rlike(r"\bHOLDINGS?\b"), F.lit(False)) for c in _sides("name"))
    letters = [fingerprint(c) for c in _sides("name_core")]
    nl, nr = _sides("number")
    return [
        Feature("core_similarity", alike("name_core"), "Core name similarity", "name", 1, "one side has no name", kind="similarity"),
        Feature("core_tfidf", F.col("core_tfidf"), "Shared words, rare ones weighted", "name", 1, kind="similarity"),
        Feature("letters_equal", _flag(F.coalesce(letters[0] == letters[1], F.lit(False))), "Same words in any order", "name", 1, kind="flag"),
        Feature("number_equal", X.equal(nl, nr), "Same registration number", "number", 1, "one side has none", kind="flag"),
        Feature("number_differs", X.differs(nl, nr), "Registration numbers differ", "number", -1, "one side has none", kind="flag"),
        Feature("number_one_sided", X.one_sided(nl, nr), "One side alone has a registration number", "number", kind="flag"),
        Feature("country_equal", X.equal(*_sides("country")), "Same country of registration", "number", 1, "one side has none", kind="flag"),
        Feature("country_differs", X.differs(*_sides("country")), "Registered in different countries", "tells apart", -1, "one side has no country", kind="flag"),
        Feature("form_equal", X.equal(*_sides("legal_form")), "Same legal form", "tells apart", 1, "one side has no legal form", kind="flag"),
        Feature("form_differs", X.differs(*_sides("legal_form")), "Legal forms differ", "tells apart", -1, "one side has no legal form", kind="flag"),
        Feature("suffix_differs", X.differs(*_sides("numeric_suffix")), "Numbered differently", "tells apart", -1, "one side has no number in its name", kind="flag"),
        Feature("subject_differs", X.differs(*_sides("subject")), "Different subject", "tells apart", -1, "one side names no subject", kind="flag"),
        Feature("holding_one_sided", F.when(alike("name_core") > 0.95, _flag(holding_l != holding_r)), "One side alone is a holding", "tells apart", -1, "the core names are not nearly equal", kind="flag"),
        Feature("house_differs", X.differs(*(house_number(c) for c in _sides("address"))), "Different house number", "tells apart", -1, "one side has none", kind="flag"),
        Feature("postcode_equal", X.equal(*_sides("postcode")), "Same postcode", "place", 1, "one side has no postcode", kind="flag"),
        Feature("district_equal", X.equal(*_sides("district")), "Same postcode district", "place", 1, "one side has no postcode", kind="flag"),
        *_both_kinds(),
    ]
