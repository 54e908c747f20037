"""Comparison levels, Fellegi-Sunter parameters by EM, and match weights."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.similarity import damerau_col, jaro_col, jaro_winkler_col
from samewise.functions.text import blank_to_null


@dataclass
class Comparison:
    """Levels of one column: -1 null, 0 else, then up to len(thresholds)+1 for exact."""

    column: str
    kind: str = "exact"  # exact, numeric, levenshtein, damerau, jaccard, jaro, jaro_winkler, arrays, postcode, names
    thresholds: Sequence[float] = ()

    second: str | None = None  # the other column of a name ladder

    @property
    def levels(self) -> int:
        """How many levels there are with 0; null is none of them."""
        if self.kind == "postcode":
            return 5
        if self.kind == "names":
            return 5
        return len(self.thresholds) + (1 if self.kind in ("numeric", "arrays") else 2)

    def gamma(self) -> Column:
        a, b = F.col(f"{self.column}_l"), F.col(f"{self.column}_r")
        t = list(self.thresholds)
        if self.kind == "postcode":
            tests = [a == b] + [part(a) == part(b) for part in (sector, district, area)]
        elif self.kind == "names":
            c, d = F.col(f"{self.second}_l"), F.col(f"{self.second}_r")
            tests = [F.coalesce(x, F.lit(False)) for x in ((a == b) & (c == d), (a == d) & (b == c), (c == d) & (jaro_winkler_col(a, b) >= 0.9), c == d)]
        elif self.kind == "arrays":
            tests = [F.size(F.array_intersect(a, b)) >= x for x in sorted(t, reverse=True)]
        elif self.kind == "numeric":
            tests = [F.abs(a - b) <= x for x in sorted(t)]
        else:
            close = {
                "exact": lambda x: F.lit(False),
                "levenshtein": lambda x: F.levenshtein(a, b, int(x)) >= 0,  # -1 beyond x, found without going on
                "damerau": lambda x: damerau_col(a, b) <= x,
                "jaccard": lambda x: jaccard(a, b) >= x,
                "jaro": lambda x: jaro_col(a, b) >= x,
                "jaro_winkler": lambda x: jaro_winkler_col(a, b) >= x,
            }[self.kind]
            tests = [a == b] + [close(x) for x in sorted(t, reverse=self.kind not in ("levenshtein", "damerau"))]
        out = F.lit(0)
        for i, test in enumerate(reversed(tests)):
            out = F.when(test, i + 1).otherwise(out)
        if self.kind == "levenshtein" and t:  # most pairs are beyond the loosest limit, so that is tried first, once
            out = F.when(~(a == b) & (F.levenshtein(a, b, int(max(t))) < 0), 0).otherwise(out)
        return F.when(a.isNull() | b.isNull(), -1).otherwise(out).alias(f"gamma_{self.column}")


def sector(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"^([A-Z]{1,2}[0-9][A-Z0-9]? [0-9])", 1))


def district(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"^([A-Z]{1,2}[0-9][A-Z0-9]?)( |$)", 1))


def area(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"^([A-Z]{1,2})[0-9]", 1))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    return F.size(F.array_intersect(chars(a), chars(b))) / F.size(F.array_union(chars(a), chars(b)))


def gammas(pairs: DataFrame, comparisons: Sequence[Comparison], keep: Sequence[str] = ("id_l", "id_r")) -> DataFrame:
    return pairs.select(*keep, *[c.gamma() for c in comparisons])


def gamma_counts(scored: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """Pairs for each vector of levels: what EM works on, a few hundred rows for any number of pairs."""
    return scored.groupBy(*[f"gamma_{c.column}" for c in comparisons]).agg(F.count("*").alias("n"))


@dataclass
class Model:
    prior: float
    m: dict[str, list[float]]
    u: dict[str, list[float]]

    def weight(self, column: str, level: int) -> float:
        return math.log2(self.m[column][level] / self.u[column][level])


def train(counts: DataFrame, comparisons: Sequence[Comparison], prior: float = 0.01, rounds: int = 25, u: dict[str, list[float]] | None = None) -> Model:
    """EM over the counted vectors; u is kept if given. The vectors are bounded by the product of the levels."""
    names = [c.column for c in comparisons]
    rows = [([r[f"gamma_{n}"] for n in names], r["n"]) for r in counts.collect()]
    rows.sort()
    size = {c.column: c.levels for c in comparisons}
    m = {n: [(1 + 4 * i) / sum(1 + 4 * j for j in range(k)) for i in range(k)] for n, k in size.items()}
    fixed = u is not None
    u = u or {n: [(k - i) / sum(k - j for j in range(k)) for i in range(k)] for n, k in size.items()}
    for _ in range(rounds):
        sums = {side: {n: [1e-6] * k for n, k in size.items()} for side in "mu"}
        matched = total = 0.0
        for g, n in rows:
            pm, pu = prior, 1 - prior
            for name, level in zip(names, g, strict=True):
                if level >= 0:
                    pm, pu = pm * m[name][level], pu * u[name][level]
            p = pm / (pm + pu) if pm + pu else 0.0
            matched, total = matched + n * p, total + n
            for name, level in zip(names, g, strict=True):
                if level >= 0:
                    sums["m"][name][level] += n * p
                    sums["u"][name][level] += n * (1 - p)
        m = {n: [x / sum(v) for x in v] for n, v in sums["m"].items()}
        if not fixed:
            u = {n: [x / sum(v) for x in v] for n, v in sums["u"].items()}
        prior = min(max(matched / total, 1e-9), 1 - 1e-9) if total else prior
    return Model(prior, m, u)


def score(scored: DataFrame, comparisons: Sequence[Comparison], model: Model) -> DataFrame:
    """match_weight (log2 odds) and match_probability; null levels weigh nothing."""
    weight = F.lit(math.log2(model.prior / (1 - model.prior)))
    for c in comparisons:
        g = F.col(f"gamma_{c.column}")
        own = F.lit(0.0)
        for level in range(c.levels):
            own = F.when(g == level, model.weight(c.column, level)).otherwise(own)
        weight = weight + own
    odds = F.pow(F.lit(2.0), F.col("match_weight"))
    return scored.withColumn("match_weight", weight).withColumn("match_probability", odds / (1 + odds))


def frequencies(units: DataFrame, column: str) -> DataFrame:
    """(value, tf): the share of each value among those that aren't null."""
    known = units.where(F.col(column).isNotNull())
    total = known.agg(F.count("*").alias("total"))  # one row
    return known.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("value", (F.col("n") / F.col("total")).alias("tf"))


def adjust(scored: DataFrame, comparison: Comparison, model: Model, tf: DataFrame) -> DataFrame:
    """match_weight with the exact level of one comparison weighed by how rare the value is; match_probability follows.

    scored has <column>_l beside its gammas. Numeric differences have no such
    level and are refused.
    """
    if comparison.kind in ("numeric", "arrays"):
        raise ValueError(f"{comparison.column} has no exact level")
    top = comparison.levels - 1
    hit = F.col(f"gamma_{comparison.column}") == top
    out = scored.join(tf.select(F.col("value").alias(f"{comparison.column}_l"), F.col("tf").alias("_tf")), f"{comparison.column}_l", "left")
    weight = F.col("match_weight") + F.when(hit & F.col("_tf").isNotNull(), F.log2(F.lit(model.u[comparison.column][top]) / F.col("_tf"))).otherwise(0.0)
    odds = F.pow(F.lit(2.0), F.col("match_weight"))
    return out.withColumn("match_weight", weight).withColumn("match_probability", odds / (1 + odds)).drop("_tf")


def prior(units: DataFrame, deterministic: DataFrame, recall: float, default: float = 1e-4) -> float:
    """Chance that two units match: pairs (id_l, id_r) of the sure rules over recall and all pairs; the default where that is no chance."""
    n, k = units.count(), deterministic.select("id_l", "id_r").distinct().count()
    every = n * (n - 1) / 2
    p = k / recall / every if every else 0.0
    return p if 0 < p < 1 else default


def random_pairs(units: DataFrame, id_col: str, n: int, carry: Sequence[str], seed: int = 1) -> DataFrame:
    """About n pairs of units that fall together by chance: units dealt to cells at random, joined within a cell.

    A cell holds a few units whatever the table's size, so no key is hot. Of a
    table with more units than n pairs need, a share chosen by hash is dealt:
    sampling is what this operator is for.
    """
    total = units.count()
    per = max(2, min(total, 32))
    needed = max(2 * n / (per - 1), (1 + math.sqrt(1 + 8 * n)) / 2 if n < per * (per - 1) / 2 else 0)
    share = min(1.0, needed / max(1, total))
    cells = max(1, int(total * share) // per)
    copies = max(1, math.ceil(n / (cells * per * (per - 1) / 2)))
    rows = units.select(F.col(id_col).cast("string").alias("id"), *carry)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    dealt = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("cell", F.pmod(F.xxhash64("id", "turn", F.lit(seed)), F.lit(cells)))
    l, r = (dealt.select("turn", "cell", F.col("id").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carry]) for s in "lr")
    return l.join(r, ["turn", "cell"]).where("id_l < id_r").drop("turn", "cell")


def level_shares(sampled: DataFrame, comparisons: Sequence[Comparison]) -> dict[str, list[float]]:
    """u: how often pairs by chance reach each level; a level never seen gets a small share."""
    counts = gamma_counts(gammas(sampled, comparisons), comparisons).collect()
    out = {}
    for c in comparisons:
        n = [1e-6] * c.levels
        for r in counts:
            if r[f"gamma_{c.column}"] >= 0:
                n[r[f"gamma_{c.column}"]] += r["n"]
        out[c.column] = [x / sum(n) for x in n]
    return out


def untrainable(comparisons: Sequence[Comparison], em_rules: Sequence[Sequence[str]]) -> list[str]:
    """Comparisons whose column every EM rule holds equal, so no rule can train them."""
    return [c.column for c in comparisons if em_rules and all(c.column in r for r in em_rules)]


def untrained(counts: DataFrame, comparisons: Sequence[Comparison]) -> DataFrame:
    """(column, level) that no counted pair reaches."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(c.column, k) for c in comparisons for k in range(c.levels)], "column string, level int")
    seen = counts.select(F.explode(F.array(*[F.struct(F.lit(c.column).alias("column"), F.col(f"gamma_{c.column}").alias("level")) for c in comparisons])).alias("x")).select("x.*").distinct()
    return every.join(seen, ["column", "level"], "left_anti")


def fingerprint(comparisons: Sequence[Comparison], rules: Sequence[Sequence[str]], **settings) -> str:
    """sha256 of all that shapes training: equal fingerprints may share a model."""
    said = {"comparisons": [[c.column, c.kind, list(c.thresholds), c.second] for c in comparisons], "rules": [list(r) for r in rules], "settings": settings}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def explain(scored: DataFrame, comparisons: Sequence[Comparison], model: Model) -> DataFrame:
    """(id_l, id_r, column, level, m, u, weight): what each comparison adds to a pair; null levels add nothing and have no row."""
    rows = [(c.column, k, model.m[c.column][k], model.u[c.column][k], round(model.weight(c.column, k), 4)) for c in comparisons for k in range(c.levels)]
    table = scored.sparkSession.createDataFrame(rows, "column string, level int, m double, u double, weight double")  # levels of the rules
    long = scored.select("id_l", "id_r", F.explode(F.array(*[F.struct(F.lit(c.column).alias("column"), F.col(f"gamma_{c.column}").alias("level")) for c in comparisons])).alias("x")).select("id_l", "id_r", "x.*")
    return long.join(F.broadcast(table), ["column", "level"])
