import pytest
from pyspark.sql import functions as F

from samewise.functions import text as X
from samewise.operators import conditions as P
from samewise.operators import rules


@pytest.mark.parametrize(
    ("text", "position", "want"),
    [
        ("Rt Hon Sir John Smith", "leading", ("John Smith", "Rt Hon Sir")),
        ("Sir", "leading", ("Sir", None)),
        ("Sir Sir", "leading", ("Sir", "Sir")),
        ("John Sir Rt Hon Smith", "anywhere", ("John Smith", "Sir Rt Hon")),
        ("John Sir Rt Hon", "trailing", ("John", "Sir Rt Hon")),
        ("  ", "anywhere", (None, None)),
        (None, "leading", (None, None)),
    ],
)
def test_taken_tokens_are_kept(spark, text, position, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(X.strip_and_keep(F.col("t"), ["sir", "Rt  Hon", "hon"], position).alias("x")).head().x
    assert (got.rest, got.removed) == want


@pytest.mark.parametrize(("word", "sound"), [("Smith", "SM0"), ("Knight", "NT"), ("Philip", "FLP"), ("Wright", "RT"), ("Xavier", "SFR"), ("Which", "WX"), ("Lamb", "LM"), ("Edge", "EJ"), ("Nation", "NXN"), ("van Dyke", "FN TK"), ("", "")])
def test_words_for_sounds(word, sound):
    assert X.metaphone_of(word) == sound


def test_tokens_stand_alone(spark):
    df = spark.createDataFrame([("Acme (Trust)",), ("Trustees",), ("trust, Acme.",), (None,)], "t string")
    ask = lambda op, *v: [r[0] for r in df.select(P.condition(df, {"column": "t", "op": op, "values": list(v)})).collect()]
    assert ask("contains_token", "trust") == [True, False, True, False]
    assert ask("starts_with_token", "trust") == [False, False, True, False]
    assert ask("ends_with_token", "acme", "trust)") == [True, False, True, False]
    assert ask("contains_token") == [False] * 4
    assert ask("not_equals", "trustees") == [True, False, True, True]


def test_what_steps_read_and_write():
    got = P.lineage(["a"], {"p": [{"source": "a", "target": "b", "op": "upper"}, {"source": "b", "target": "a", "op": "lower", "keep_as": "c"}]})
    assert got == {"p": {"readable": ["a", "b", "c"], "written": ["b", "a", "c"]}}


def test_faults_are_named_with_their_place():
    good = {
        "tracks": ["p"], "default_track": "p",
        "track_rules": [{"track": "p", "when": [{"column": "a", "op": "equals", "value": "x"}]}],
        "cleaning": {"p": [{"source": "a", "target": "b", "op": "upper"}, {"source": "b", "target": "c", "op": "trim"}]},
        "match_keys": [{"id": "k", "columns": ["c"]}],
        "vetoes": [{"action": "review", "when": [{"op": "differs", "column": "b"}]}],
    }
    assert rules.validate(good, ["a"]) == []
    bad = good | {
        "default_track": "q",
        "cleaning": {"p": [{"source": "zz", "target": "b", "op": "no"}, {"source": "a", "target": "c", "op": "regex_replace", "args": {"pattern": "("}}]},
        "match_keys": [{"id": "k", "columns": ["d"]}, {"id": "k", "columns": []}],
        "vetoes": [{"action": "x", "when": [{"op": "y", "column": "b"}]}],
    }
    assert {p for p, _ in rules.validate(bad, ["a"])} == {"default_track", "cleaning.p[0].op", "cleaning.p[0].source", "cleaning.p[1].args.pattern", "match_keys[0].columns", "match_keys[1].id", "match_keys[1].columns", "vetoes[0].action", "vetoes[0].when[0].op"}


def test_postcodes_as_the_rules_have_them(spark):
    cases = [("GIR 0AA", "GIR 0AA", None), ("sw1a 1aa", "SW1A 1AA", "SW1A"), ("le1-1fb", "LE1 1FB", "LE1"), ("75008", None, None), (None, None, None), ("", None, None)]
    df = spark.createDataFrame(cases, "raw string, code string, district string")
    assert [(r.c, r.d) for r in df.select(X.postcode(F.col("raw")).alias("c"), X.postcode_district(X.postcode(F.col("raw"))).alias("d")).collect()] == [(c, d) for _, c, d in cases]
    part = spark.createDataFrame([("SW1A whatever",), ("m1 ",), ("le1 x",)], "raw string").select(X.postcode_district(F.col("raw")).alias("d")).collect()
    assert [r.d for r in part] == ["SW1A", None, "LE1"]


def test_nothing_is_cut_at_a_thousand(spark):
    name = "SMITH, " + " ".join(f"N{i}" for i in range(1500))
    middle = spark.createDataFrame([(name,)], "n string").select(X.person_name(F.col("n"))["middle_names"].alias("m")).head().m
    assert len(middle.split()) == 1499
    from samewise.operators.exact import units

    ids = ["a" * 1500 + "1", "a" * 1500 + "2"]
    records = spark.createDataFrame([(i,) for i in ids], "record_id string")
    groups = spark.createDataFrame([(i, f"X-{i}", "merged") for i in ids], "record_id string, group_id string, status string")
    assert {r.unit_id for r in units(records, groups).collect()} == set(ids)


def test_bounds_of_a_share(spark):
    from samewise.operators.decisions import wilson

    low, high = wilson(F.col("x"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (3, 3), (0, 5)], "x int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (got[0].l, got[0].h) == (0.0, 1.0) and round(got[1].l, 2) == 0.44 and got[1].h == 1.0 and got[2].l == 0.0
