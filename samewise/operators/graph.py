"""Connected components on DataFrames: alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from samewise.plans.materialize import discard, save


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return (node, component) for every node of an undirected edge list.

    component is the smallest node id reachable. Ids may be of any type that
    can be ordered. Self-loops keep their node as a component of its own;
    edges with a null end are ignored; an empty edge list gives an empty table.

    Every round only takes minima per node and joins them back, so no
    neighbour list is ever gathered; a hub costs rows, not memory. The rounds
    needed grow with the logarithm of the longest path.
    """
    raw = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = raw.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cur, before = _round(raw.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("m").alias("v"), F.col("v").alias("m")))
        # large-star: every larger neighbour of u is hung on u's smallest neighbour
        low = both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low"))
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        # small-star: u and its smaller neighbours are hung on the smallest of them
        low2 = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low2, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct(F.col("v").alias("v"), F.col("low").alias("m")))).alias("e")
        )
        nxt, after = _round(small.select("e.v", "e.m").where("v <> m").distinct())
        discard(cur)
        cur = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return nodes.join(cur.withColumnRenamed("v", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def _round(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges written and read again; their number and an order-free digest, taken while writing, to tell whether a round changed anything."""
    seen = Observation()
    out = save(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)")).alias("h")), "cc")
    return out, (seen.get["n"], seen.get["h"])
