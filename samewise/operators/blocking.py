"""Candidate pairs by blocking: pricing, hot-key control, generation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.plans.materialize import shuffle_partitions

SPREAD = 8  # shares of a block whose pairs are made in tasks of their own


def block_sizes(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    known = rows.dropna(subset=list(columns))
    return known.groupBy(*columns).agg(F.count("*").alias("n"))


def price(rows: DataFrame, columns: Sequence[str], differ: str | None = None) -> DataFrame:
    """(pairs): what a rule makes, counted without making a pair; with differ, less the pairs that agree there."""
    pairs = lambda d: d.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("pairs"))
    if differ is None:
        return pairs(block_sizes(rows, columns))
    known = rows.dropna(subset=[differ])
    every = block_sizes(known, columns).select("n", F.lit(1).alias("sign"))
    alike = block_sizes(known, [*columns, differ]).select("n", F.lit(-1).alias("sign"))
    return every.unionByName(alike).agg(F.coalesce(F.sum(F.expr("sign * (n * (n - 1) div 2)")), F.lit(0)).cast("long").alias("pairs"))


def control_hot_keys(rows: DataFrame, columns: Sequence[str], max_block_size: int, refine: Sequence[str] = (), drop_above: int | None = None) -> DataFrame:
    """rows with `block`, a text key; oversized blocks make no pairs, or are keyed again by more columns.

    Dropping is the operator's declared meaning here: a rule says which blocks
    are too common to tell anything.
    """
    sizes = block_sizes(rows, columns).where(F.col("n") > max_block_size).select(*columns, F.lit(True).alias("hot"))
    marked = rows.dropna(subset=list(columns)).join(sizes, list(columns), "left")
    key = lambda cs: F.concat_ws("\x1f", *[F.col(c).cast("string") for c in cs])
    cold = marked.where("hot IS NULL").withColumn("block", key(columns))
    if not refine:
        return cold.drop("hot")
    fine = marked.where("hot").dropna(subset=list(refine)).withColumn("block", key([*columns, *refine]))
    if drop_above is not None:
        large = fine.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > drop_above)
        fine = fine.join(large, "block", "left_anti")
    return cold.unionByName(fine).drop("hot")


def pairs(rows: DataFrame, rules: Sequence[Sequence[str]], id_col: str, carry: Sequence[str] = (), of: Column | None = None) -> DataFrame:
    """(id_l, id_r, match_key, <c>_l, <c>_r): each pair once, by the first rule that makes it.

    of: only pairs for whose left row (<c>_l) it holds; the others are not
    made. Left rows of a block are then dealt out in SPREAD shares, each with
    all right rows of the block, and by a given number of parts, since few
    blocks and few bytes of rows make many pairs.
    """
    out, parts = None, shuffle_partitions(rows.sparkSession)
    needed = sorted({c for r in rules for c in r} | set(carry))
    side = lambda s: rows.select(F.col(id_col).cast("string").alias(f"id_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in needed])
    for i, rule in enumerate(rules):
        on = [F.col(f"{c}_l") == F.col(f"{c}_r") for c in rule] + [F.col("id_l") < F.col("id_r")]
        if of is None:
            made = side("l").join(side("r"), on)
        else:
            l = side("l").where(of).withColumn("share_l", F.pmod(F.xxhash64("id_l"), F.lit(SPREAD)))
            r = side("r").withColumn("share_r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
            dealt = [d.repartition(parts, *[f"{c}_{s}" for c in (*rule, "share")]) for d, s in ((l, "l"), (r, "r"))]
            made = dealt[0].hint("merge").join(dealt[1], [*on, F.col("share_l") == F.col("share_r")])
        for earlier in rules[:i]:
            same = F.lit(True)
            for c in earlier:
                same = same & F.coalesce(F.col(f"{c}_l") == F.col(f"{c}_r"), F.lit(False))
            made = made.where(~same)
        made = made.withColumn("match_key", F.lit(i).cast("long"))
        out = made if out is None else out.unionByName(made)
    return out.select("id_l", "id_r", "match_key", *[f"{c}_{s}" for c in carry for s in "lr"])


@dataclass
class Rule:
    """A blocking rule taken apart: keys that join, columns that must differ, filters of one side, what is left."""

    keys: list[str] = field(default_factory=list)
    differ: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    residual: list[str] = field(default_factory=list)


def top_level(text: str, word: str) -> list[str]:
    """The parts of an expression between a word outside brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for m in re.finditer(rf"['\"()]|\b{word}\b", text, re.IGNORECASE):
        t = m.group()
        if quote:
            quote = "" if t == quote else quote
        elif t in "'\"":
            quote = t
        elif t in "()":
            depth += 1 if t == "(" else -1
        elif depth == 0:
            parts.append(text[start : m.start()].strip())
            start = m.end()
    return [*parts, text[start:].strip()]


def parse_rule(text: str) -> Rule:
    """`l.a = r.a AND l.b <> r.b AND ...` as a Rule; with an OR on top all of it is residual."""
    out = Rule()
    if len(top_level(text, "OR")) > 1:
        return Rule(residual=[text])
    for part in top_level(text, "AND"):
        m = re.fullmatch(r"([lr])\.(\w+)\s*(=|<>|!=)\s*([lr])\.(\w+)", part, re.IGNORECASE)
        if m and m[2] == m[5] and m[1].lower() != m[4].lower():
            (out.keys if m[3] == "=" else out.differ).append(m[2])
        elif len({s.lower() for s in re.findall(r"\b([lr])\.", part, re.IGNORECASE)}) == 1:
            out.filters.append(part)
        else:
            out.residual.append(part)
    return out


def report(rows: DataFrame, rules: Sequence[Sequence[str]], max_block_size: int, refine: Sequence[str] = ()) -> DataFrame:
    """(rule, before, after): pairs that each rule would make without and with hot-key control."""
    out = None
    for i, rule in enumerate(rules):
        before = price(rows, rule).select(F.lit(i).alias("rule"), F.col("pairs").alias("before"))
        after = price(control_hot_keys(rows, rule, max_block_size, refine), ["block"]).select(F.col("pairs").alias("after"))
        one = before.crossJoin(after)  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def check_budget(rows: DataFrame, rules: Sequence[Sequence[str]], max_pairs: int, max_block_size: int) -> DataFrame:
    """The report; raises before any pair is made where all rules together would make too many."""
    got = report(rows, rules, max_block_size)
    total = got.agg(F.sum("after").alias("n")).head()["n"] or 0
    if total > max_pairs:
        raise ValueError(f"blocking would make {total} pairs, over {max_pairs}")
    return got


def numeric_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number-like columns as doubles, so that '1985' and '1985.0' fall into one block; other text is null."""
    return rows.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})
