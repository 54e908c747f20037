import pytest
from pyspark.sql import functions as F

from samewise.operators import contract as C


def test_values_in_words(spark):
    say = lambda kind, v, **k: C.Feature("x", F.lit(1), "X", "g", kind=kind, **k).say(v)
    assert [say("flag", 1.0), say("years", 0.0), say("years", 1.0), say("log_people", 2.0), say("share", 0.256)] == ["yes", "no gap", "1 year", "99 people", "26 %"]
    assert say("category", 1.0, categories=("trust", "company")) == "company" and say("category", 7.0, categories=("trust",)) == "code 7"
    assert say("flag", None, null_when="one side has none") == "nothing: one side has none"


def test_a_contract_that_makes_no_sense_is_refused(spark):
    with pytest.raises(ValueError, match="no direction"):
        C.Feature("x", F.lit(1), "X", "g", monotone=1, categories=("a", "b"))
    with pytest.raises(ValueError, match="no way"):
        C.Feature("x", F.lit(1), "X", "g", kind="smell")
    f = C.Feature("x", F.lit(1), "X", "g")
    with pytest.raises(ValueError, match="one name"):
        C.build(spark.range(1).selectExpr("id AS id_l", "id AS id_r"), [f, f])


def test_rarity_is_null_without_a_table_and_zero_for_an_unseen_name(spark):
    pairs = spark.createDataFrame([(1, 2, "ANN", "LEE", "ANN", "LEE"), (3, 4, "ANN", None, "ANN", "LEE")], "id_l int, id_r int, forename_l string, surname_l string, forename_r string, surname_r string")
    names = spark.createDataFrame([("surname", None, "KOE", 9)], "kind string, forename string, surname string, n long")
    value = {f.name: f.value for f in C.donor_person({})}
    got = [[r.s for r in C.with_frequencies(pairs, t).select("id_l", value["surname_log_n"].alias("s")).orderBy("id_l").collect()] for t in (None, names)]
    assert got == [[None, None], [0.0, None]]


def test_shared_companies_are_counted_whole(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_l int, id_r int")
    held = spark.createDataFrame([(u, c) for u in (1, 2) for c in range(500)] + [(1, 1), (3, 900), (3, None)], "u int, c int")
    got = {r.id_r: r.shared_companies for r in C.shared_companies(pairs, held, "u", "c").collect()}
    assert got == {2: 500.0, 3: 0.0}
