import pytest

from samewise.operators import blocking as B
from samewise.operators import linking as L
from samewise.operators import scoring as W


def test_rules_are_taken_apart():
    r = B.parse_rule("l.a = r.a AND l.b <> r.b and l.kind = 'x AND y' AND (l.c = r.d OR l.e > r.e)")
    assert (r.keys, r.differ, r.filters, r.residual) == (["a"], ["b"], ["l.kind = 'x AND y'"], ["(l.c = r.d OR l.e > r.e)"])
    assert B.parse_rule("l.a = r.a OR l.b = r.b").residual == ["l.a = r.a OR l.b = r.b"]


def test_a_budget_stops_before_pairs(spark):
    df = spark.createDataFrame([(i, "k") for i in range(50)], "id long, a string")
    with pytest.raises(ValueError):
        B.check_budget(df, [["a"]], 1000, 100)
    assert B.check_budget(df, [["a"]], 2000, 100).head().after == 1225


@pytest.mark.parametrize("n", [100, 5000])
def test_pairs_by_chance_come_near_their_number(spark, n):
    got = W.random_pairs(spark.range(2000), "id", n, [])
    assert 0.5 * n < got.count() < 2 * n + 600
    assert got.where("id_l >= id_r").isEmpty()


def test_levels_told_apart():
    c = [W.Comparison("a"), W.Comparison("b")]
    assert W.untrainable(c, [["a"], ["a", "b"]]) == ["a"]
    assert W.fingerprint(c, [["a"]]) != W.fingerprint(c, [["b"]]) and W.fingerprint(c, [["a"]], prior=1) == W.fingerprint(c, [["a"]], prior=1)
    with pytest.raises(ValueError):
        W.adjust(None, W.Comparison("a", "numeric", [1]), None, None)


def test_unmapped_categories_stop_the_run(spark):
    df = spark.createDataFrame([("a",), (None,), (" ",)], "c string")
    assert [r.category for r in L.map_categories(df, "c", {"a": "x"}).collect()] == ["x", "UNKNOWN", "UNKNOWN"]
    with pytest.raises(ValueError, match="B"):
        L.map_categories(df.union(spark.createDataFrame([("b",)], "c string")), "c", {"a": "x"})
