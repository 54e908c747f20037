"""Links among things that share a key, in groups of bounded size.

Things that keys connect, directly or by others, make a part. A part of up to
`cell` things is compared at once, all pairs of it. A larger one is dealt out
in cells, each with the part's head in it: a dense group of copies, of
whatever size, is then one class already. Only where a key still holds things
of several classes are those outside its main class compared with all of the
key, cell by cell. So every two things that share a key end up in one class or
meet, no cell is over its size, and a group of copies costs its rows, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.operators.graph import connected_components
from samewise.plans.materialize import discard, save, shuffle_partitions


def met(entries: DataFrame) -> DataFrame:
    """(key, head, node) from (key, node) in order of keys and nodes: every node but the first of its key, and that first one."""

    def run(batches):
        held, head = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, nodes = b.column(0).to_numpy(), b.column(1)
            starts = np.concatenate([[True], keys[1:] != keys[:-1]])
            goes_on = keys[0] == held
            first = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
            later = np.flatnonzero(~starts)
            heads = nodes.take(pa.array(first[later])).to_pylist()
            if goes_on:
                lead = int((first == 0).sum())  # rows of the key that the last batch ended with
                later = np.concatenate([[0], later])
                heads = [head] * lead + heads[lead - 1 :]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(later)), pa.array(heads, pa.binary()), nodes.take(pa.array(later))], names=["key", "head", "node"])
            if not (goes_on and first[-1] == 0):
                head = nodes[int(first[-1])].as_py()
            held = keys[-1]

    return entries.mapInArrow(run, "key long, head binary, node binary")


def stars(shared: DataFrame) -> DataFrame:
    """(head, node) that connect what the heads and nodes of shared connect: a node hangs on the smallest of its heads, and so do its other heads.

    In a dense group the nodes of many keys have a few heads, so it has about
    as many edges as nodes, not as nodes and keys. A node has at most as many heads as keys.
    """
    heads = shared.groupBy("node").agg(F.sort_array(F.collect_set("head")).alias("heads"))
    edges = F.transform("heads", lambda h, i: F.struct(F.col("heads")[0].alias("head"), F.when(i == 0, F.col("node")).otherwise(h).alias("node")))
    return heads.select(F.explode(edges).alias("e")).select("e.head", "e.node").distinct()


def forests(cells: DataFrame, make: Callable, forest: Callable) -> DataFrame:
    """(a, b): for each cell of (cell, node, payload), in order of cells, the edges (places of two) that forest gives for [make(payload), ...]."""

    def run(batches):
        held, nodes = None, {}

        def close():
            names = list(nodes)
            edges = forest(list(nodes.values())) if len(names) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[e[s]] for e in edges], pa.binary()) for s in (0, 1)], names=["a", "b"])

        for b in batches:
            for cell, node, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cell != held:
                    yield close()
                    held, nodes = cell, {}
                if node not in nodes:
                    nodes[node] = make(payload)
        yield close()

    return cells.mapInArrow(run, "a binary, b binary")


def spanning_links(entries: DataFrame, compare: Callable[[DataFrame], DataFrame], cell: int) -> DataFrame:
    """(a, b): links that connect what all alike pairs of nodes that share a key connect.

    entries: (key long, node binary), once each. compare: from (cell, node)
    the saved (a, b) of a spanning forest of each cell's alike pairs.
    """
    spark = entries.sparkSession
    shared = save(met(entries.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "node")), "meeting-met")
    parts = save(connected_components(stars(shared), "head", "node"), "meeting-parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).withColumn("m", F.ceil(F.col("size") / cell).cast("int"))
    dealt = parts.join(sizes, "component").select("node", "component", "m")
    name = lambda salt: F.concat_ws("-", F.hex("component"), salt)
    own = dealt.select(name(_salt("m")).alias("cell"), "node")
    # a part's head, its smallest node, stands in each of its cells
    heads = sizes.where("m > 1").select("component", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("salt")).select(name(F.col("salt")).alias("cell"), F.col("component").alias("node"))
    first = compare(own.unionByName(heads))
    large = dealt.where("m > 1").select("node")
    if large.isEmpty():
        found = first
    else:
        classes = save(large.join(connected_components(first, "a", "b"), "node", "left").select("node", F.coalesce("component", "node").alias("class")), "meeting-classes")
        keyed = shared.select("key", "node").unionByName(shared.select("key", F.col("head").alias("node")).distinct()).join(classes, "node")
        by_class = keyed.groupBy("key", "class").agg(F.count("*").alias("n"))
        main = by_class.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "class")).alias("main")).where("n > main.n")
        half = max(1, cell // 2)
        open_keys = save(main.select("key", F.col("main.class").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / half).cast("int").alias("mu"), F.ceil(F.col("main.n") / half).cast("int").alias("ml")), "meeting-open")
        rows = keyed.join(open_keys, "key")
        upper = rows.where("class <> main").withColumn("own", _salt("mu"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("with")
        cells = (
            upper.select("key", "node", "own", every("mu")).select(F.concat_ws("-", "key", F.lit("u"), F.least("own", "with"), F.greatest("own", "with")).alias("cell"), "node")
            .unionByName(upper.select("key", "node", "own", every("ml")).select(F.concat_ws("-", "key", F.lit("l"), "own", "with").alias("cell"), "node"))
            .unionByName(rows.where("class = main").withColumn("own", _salt("ml")).select("key", "node", "own", every("mu")).select(F.concat_ws("-", "key", F.lit("l"), "with", "own").alias("cell"), "node"))
        )
        found = first.unionByName(compare(cells))
        discard(classes)
        discard(open_keys)
    discard(shared)
    discard(parts)
    return found


def _salt(m: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(m)).cast("int")
