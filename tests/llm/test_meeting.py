import random

import pytest

from samewise.llm import meeting
from samewise.operators.graph import connected_components
from samewise.plans.materialize import save


def run(spark, keys, alike, cell):
    """Classes by spanning_links, by brute force, and the rows of cells that were compared. keys: {node: keys}."""
    rows = [(k, bytes([n // 256, n % 256])) for n, own in keys.items() for k in sorted(own)]
    sent = []

    def forest(nodes):
        return [(i, j) for i in range(len(nodes)) for j in range(i) if alike(nodes[i], nodes[j])]

    def compare(cells):
        cells = save(cells, "test-cells")
        sent.append(cells.count())
        assert not cells.groupBy("cell").count().where(f"count > {2 * cell + 2}").head()
        laid = cells.selectExpr("cell", "node", "node AS payload").repartition(4, "cell").sortWithinPartitions("cell")
        return save(meeting.forests(laid, lambda p: p[0] * 256 + p[1], forest), "test-forests")

    found = meeting.spanning_links(spark.createDataFrame(rows, "key long, node binary"), compare, cell)
    got = {int.from_bytes(r.node, "big"): int.from_bytes(r.component, "big") for r in connected_components(found, "a", "b").collect()}
    root = {n: n for n in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if b < a and keys[a] & keys[b] and alike(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: got.get(n, n) for n in keys}, {n: find(n) for n in keys}, sum(sent)


@pytest.mark.parametrize("cell", [1000, 20])
def test_as_brute_force(spark, cell):
    rng = random.Random(5)
    keys = {n: {rng.randrange(25) for _ in range(3)} for n in range(300)}
    got, want, _ = run(spark, keys, lambda a, b: a % 7 == b % 7 and abs(a - b) < 60, cell)
    # comparing more than the pairs that share a key may link more, never less
    for n in keys:
        assert got[n] <= want[n] and got[want[n]] == got[n]
        assert got[n] % 7 == n % 7


def test_two_groups_in_one_key_lose_no_link(spark):
    # all share one key; the head is alike to the even ones only, the odd ones are alike among themselves
    keys = {n: {1} for n in range(200)}
    got, want, _ = run(spark, keys, lambda a, b: a % 2 == b % 2, 16)
    assert got == want == {n: n % 2 for n in keys}


def test_a_dense_group_costs_its_rows(spark):
    keys = {n: {1, 2, 3} for n in range(1000)}
    got, want, sent = run(spark, keys, lambda a, b: True, 50)
    assert got == want and sent <= 1100


def test_dense_groups_have_about_an_edge_a_node(spark):
    """Nodes of a dozen keys each: the edges grew with nodes times keys."""
    rows = [(k * 3 + n % 3 if n % 2 else k * 3, b"%04d" % n) for n in range(300) for k in range(12)]
    entries = spark.createDataFrame(rows, "key long, node binary")
    shared = meeting.met(entries.repartition(4, "key").sortWithinPartitions("key", "node"))
    edges = meeting.stars(shared)
    assert edges.count() < 310
    cc = lambda e: sorted(map(tuple, connected_components(e, "head", "node").collect()))
    assert cc(edges) == cc(shared.select("head", "node").distinct())
