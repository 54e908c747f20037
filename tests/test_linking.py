import pytest
from harness import compare, connect
from pyspark.sql import functions as F

from samewise import queries as catalogue
from samewise.operators import linking as L

SF = "/root/testdata/sf0.001"
LEFT = [(1, "b", "x"), (1, "o", "y"), (1, "o", "y"), (2, "UNKNOWN", "x"), (3, None, "y"), (4, "b", None), (5, "b", ""), (6, "o", "z"), (104, "b", "y"), (7, "UNKNOWN", "w")]
RIGHT = [(10, "b", "x"), (110, "b", "x"), (210, "b", "y"), (11, "UNKNOWN", "x"), (12, None, "y"), (13, "o", ""), (14, "s", "y"), (14, "s", "y"), (15, "b", None), (115, "o", "x")]


def test_classes_have_the_best_candidates_of_their_rows(spark):
    l, r = (spark.createDataFrame(x, "id long, category string, core string") for x in (LEFT, RIGHT))
    p = F.expr("((id_l * 7 + id_r * 13) % 100) / 100")
    want = L.best_candidates(L.link_pairs(l, r).withColumn("p", p))
    ids, met = L.linked_classes(l, r, lambda c: c % 100)
    got = L.best_of_classes(ids, met.withColumn("p", p))
    assert got.dtypes == want.dtypes
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(got) == rows(want)
    assert any(x[-1] for x in rows(want)) and {x[3] for x in rows(want)} >= {"high", "low"}


def test_classes_cost_no_row_for_each_pair(spark):
    l, r = (spark.range(n).selectExpr("id", "'b' AS category", "'x' AS core") for n in (3000, 2000))
    assert L.linked_classes(l, r, lambda c: c % 100)[1].count() == 100 * 100


@pytest.mark.parametrize("name", ["j_ambiguity", "j_merged_dataset"])
def test_query_makes_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(L, "link_pairs", lambda *a, **k: pytest.fail("pairs of rows made"))
    got, want = compare(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLE_SQL[name])
    assert got == want
