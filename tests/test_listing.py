import pytest
from pyspark.sql import functions as F

from samewise import queries as catalogue
from samewise.operators import clusters as G
from samewise.operators import listing as I
from samewise.operators import loading as N
from samewise.sources import exports as K


def test_pages_neither_overlap_nor_leave_gaps(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(20)], "id int, k int")
    seen = [r.id for at in range(0, 20, 7) for r in I.page(rows, [F.desc("k"), "id"], at, 7).collect()]
    assert sorted(seen) == list(range(20)) and seen[0] == 2
    assert I.page(rows, ["id"], 0, 2, F.col("k") == 1, ["k"]).columns == ["k"]


def test_groups_into_batches_of_about_a_size():
    assert I.batches([("a", 3), ("b", 3), ("c", 5), ("d", 20), ("e", 1)], 6) == [["a", "b"], ["c"], ["d"], ["e"]]
    assert I.batches([], 5) == []


def test_namespaced_ids(spark):
    rows = spark.createDataFrame([("7.0", " Trust "), ("7", "company"), ("", "Trust"), (None, "x"), ("9", None)], "n string, kind string")
    assert [r.i for r in rows.select(N.namespaced_id(F.col("n"), F.col("kind"), {"trust": "TR"}).alias("i")).collect()] == ["TR7", "7", None, None, "9"]


def test_a_profile_may_only_make_columns_of_records(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "unit int, c string")
    assert G.unit_profile(rows, "unit", {"c": F.max("c")}, ["c"]).collect()[0].c == "b"
    with pytest.raises(ValueError, match="other"):
        G.unit_profile(rows, "unit", {"other": F.max("c")}, ["c"])


def test_labels_as_csv_and_back(spark, tmp_path):
    rows = [("1", "2", True, 'a "quoted", note'), ("3", "4", False, None)]
    K.write_labels(spark.createDataFrame(rows, "record_a string, record_b string, same boolean, note string"), f"{tmp_path}/labels")
    good, bad = K.read_labels(spark, f"{tmp_path}/labels")
    assert sorted(tuple(r) for r in good.collect()) == rows and bad.count() == 0
    (tmp_path / "by_hand.csv").write_text("record_a,record_b,verdict,note\n5,6,yes,\n5,5,yes,\n,6,no,x\n7,8,maybe,hm\n9,10,F,ok\n")
    good, bad = K.read_labels(spark, f"{tmp_path}/by_hand.csv")
    assert sorted((r.record_a, r.same) for r in good.collect()) == [("5", True), ("9", False)]
    assert sorted((r.reason, r.line) for r in bad.collect()) == [("an id is missing", "6,no,x"), ("both ids are the same", "5,5,yes"), ("no verdict", "7,8,maybe,hm")]


def test_bulk_lines_stay_in_pairs(spark, tmp_path):
    K.write_bulk(spark.createDataFrame([(1, "E1"), (2, None), (3, "E1")], "r int, e string"), f"{tmp_path}/bulk", "r", "e")
    lines = [x for f in sorted((tmp_path / "bulk").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(lines) == 4 and all('"index"' in a and '"entity_id":"E1"' in b for a, b in zip(lines[::2], lines[1::2], strict=True))


def test_page_of_costly_conditions(spark):
    rows = spark.range(40).selectExpr("id", "CASE WHEN id % 7 > 0 THEN (id % 5) / 4 END AS p")
    p = F.col("p")
    for offset, limit in ((0, 4), (3, 50), (30, 5)):
        order = [F.desc_nulls_last("p"), "id"]
        want = I.page(rows, order, offset, limit, p.between(0.2, 0.8), ["id", "p"]).collect()
        assert I.page(rows, order, offset, limit, p.between(0.2, 0.8), ["id", "p"], costly=True).collect() == want


def test_pairs_page_scores_once_and_joins_no_unit_to_pairs(spark):
    plan = catalogue.QUERIES["r_pairs_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein") <= 6  # three in each of two rules; as a filter on the score they stood there anew at each mention
    above = plan[: plan.index("Union")]
    assert "Join" not in above
