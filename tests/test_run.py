"""A whole run, and the golden cases of units, gates and ids in it."""

from pyspark.sql import functions as F

from samewise.operators import decisions, scoring
from samewise.operators.exact import MatchKey
from samewise.plans import run

SCHEMA = "record_id string, name string, surname string, postcode string, year int, number string, earlier string"


def rules(**more):
    c = scoring.Comparison
    model = scoring.Model(0.1, {"name": [0.05, 0.95], "postcode": [0.1, 0.9]}, {"name": [0.98, 0.02], "postcode": [0.97, 0.03]})
    own = {
        "columns": ["name", "surname", "postcode", "year"],
        "steps": [{"source": "name", "target": "name", "op": "upper"}, {"source": "postcode", "target": "postcode", "op": "normalise_postcode"}],
        "match_keys": [MatchKey("number", ["number"], 1, max_group_size=3), MatchKey("name_year", ["name", "year"], 2)],
        "rules": [["surname"], ["postcode"]],
        "comparisons": [c("name"), c("postcode")],
        "existing": "earlier",
        "vetoes": lambda: [("years", decisions.veto("abs_diff_gt", F.col("year_l"), F.col("year_r"), 20), "reject")],
        "model": model,
    }
    return run.Ruleset(**own | more)


def raw(spark):
    rows = [
        ("r01", "Ann Lee", "LEE", "le1 1fb", 1970, "N1", None),
        ("r02", "ann lee", "LEE", "LE1 1FB", 1970, None, None),  # the same name and year: one unit with r01
        ("r03", "Ann Lee", "LEE", "LE1 1FB", 1971, "N1", None),  # the same number: one unit too
        ("r04", "Ann Lee", "LEE", "LE11FB", 1975, None, "E9"),  # scored with the unit
        ("r05", "Ann Lee", "LEE", "LE1 1FB", 1999, None, None),  # vetoed by its year
        ("r06", "Bob Ray", "RAY", "M1 1AE", 1960, None, "E5"),
        ("r07", "Rob Ray", "RAY", "M2 2AE", 1961, None, "E5"),  # an earlier id alone
        ("r08", "Cat Fox", "FOX", None, None, None, None),
        ("r09", "Dan Fox", "FOX", None, None, None, None),  # people say so
        *[(f"h{i}", f"Held {i}", f"H{i}", None, None, "N7", None) for i in range(5)],  # a group over its guard is held apart
        ("r99", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_from_records_to_entities(spark):
    labels = spark.createDataFrame([("r08", "r09", True)], "record_a string, record_b string, same boolean")
    registry = spark.createDataFrame([("r04", "E9"), ("r06", "E5"), ("r07", "E5")], "record_id string, entity_id string")
    got = run.resolve(raw(spark), rules(), labels, registry)
    units = {r.record_id: r.unit_id for r in got.members.collect()}
    assert units["r01"] == units["r02"] == units["r03"] == "r01" and len({units[f"h{i}"] for i in range(5)}) == 5
    assert {r.status for r in got.groups.where("record_id LIKE 'h%'").collect()} == {"held"}
    one = got.units.where("unit_id = 'r01'").head()
    assert (one.unit_size, one.name, one.postcode, one.year) == (3, "ANN LEE", "LE1 1FB", 1970)
    pairs = {(r.id_l, r.id_r): (r.bucket, r.veto_id, r.decided_by) for r in got.pairs.collect()}
    assert pairs["r01", "r04"][0] == "accept" and pairs["r01", "r05"] == ("reject", "years", "veto") and pairs["r06", "r07"] == ("accept", None, "import") and pairs["r08", "r09"] == ("accept", None, "human")
    who = {r.record_id: r for r in got.entities.collect()}
    assert len(who) == 15 and {who[r].entity_id for r in ("r01", "r02", "r03", "r04")} == {"E9"} and who["r05"].entity_id != "E9"
    assert who["r06"].entity_id == who["r07"].entity_id == "E5" and who["r08"].entity_id == who["r09"].entity_id
    assert (who["r08"].basis, who["r06"].basis, who["r99"].basis, who["r99"].id_status) == ("human", "import", "single", "minted")
    # the earlier id's link is weak by its score, so that cluster is rebuilt on the id alone
    assert sorted(r.status for r in got.gate.where("n_units > 1").collect()) == ["ok", "ok", "weak_link"]


def test_a_weak_chain_is_withheld_and_rebuilt_on_what_is_sure(spark):
    rows = [("r04", "Ann Lee", "LEE", "LE1 1FB", 1975, None, "E1"), ("r05", "Ann Lee", "LEE", "LE1 1FB", 1975, None, None), ("r06", "Ann Lee", "LEE", None, 1990, None, "E1")]
    # r04-r05 by score; r05-r06 is vetoed down and far under the floor; r04-r06 share an earlier id
    weak = scoring.Model(0.1, {"name": [0.05, 0.95], "postcode": [0.1, 0.9]}, {"name": [0.98, 0.02], "postcode": [0.97, 0.03]})
    got = run.resolve(spark.createDataFrame(rows, SCHEMA), rules(match_keys=[], model=weak, floor=0.99), None, None)
    gate = got.gate.collect()
    assert [r.withheld for r in gate] == [True] and "weak_link" in gate[0].statuses
    key = {r.record_id: r.entity_key for r in got.entities.collect()}
    assert key["r04"] == key["r06"] != key["r05"]


def test_em_trains_where_no_model_is_given_and_nothing_gives_nothing(spark):
    got = run.resolve(raw(spark), rules(model=None))
    assert 0 < got.model.prior < 1 and got.entities.count() == 15
    empty = run.resolve(raw(spark).limit(0), rules())
    assert empty.entities.count() == 0 and empty.pairs.count() == 0
