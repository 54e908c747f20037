import gzip
import random

import pytest
from pyspark.sql import functions as F

from samewise.functions import text as X
from samewise.operators import blocking, decisions, exact, registry, scoring
from samewise.operators.graph import connected_components
from samewise.sources import files, sinks
from samewise.streaming import incremental


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components_match_union_find(spark, shape):
    rng = random.Random(3)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "path": [(i, i + 1) for i in range(120)], "star": [(7, i) for i in range(100)]}[shape]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(1, 1), (None, 2)], "src long, dst long")).collect()[0].component == 1


def test_cleaning_steps(spark):
    df = spark.createDataFrame([("  Smith, John  Paul ",), ("Jane Doe",), ("Cher",), (" ",), (None,)], "n string")
    got = [r[0] for r in df.select(X.person_name(X.collapse_spaces(F.col("n")))).collect()]
    assert [(g.forename, g.middle_names, g.surname, g.forename_initial) for g in got[:3]] == [("John", "Paul", "Smith", "J"), ("Jane", None, "Doe", "J"), (None, None, "Cher", None)]
    codes = spark.createDataFrame([("sw1a1aa",), ("M1 1AE",), ("nope",), (None,)], "p string")
    assert [r[0] for r in codes.select(X.postcode(F.col("p"))).collect()] == ["SW1A 1AA", "M1 1AE", None, None]
    one = spark.createDataFrame([("ACME Holdings LTD Ltd", "LTD")], "a string, b string")
    assert one.select(X.strip_tokens(F.col("a"), ["ltd"]), X.strip_tokens(F.col("b"), ["ltd"])).head() == ("ACME Holdings", "LTD")
    with pytest.raises(ValueError):
        X.step("nonsense", F.col("a"))


def test_guards_hold_groups(spark):
    rows = [(str(i), "k", str(i % 3)) for i in range(5)] + [("8", "m", "1"), ("9", "m", "1"), ("7", None, "1")]
    df = spark.createDataFrame(rows, "record_id string, k string, v string")
    got = exact.exact_groups(df, [exact.MatchKey("k", ["k"], max_distinct=("v", 2))]).collect()
    assert {(r.record_id, r.status) for r in got} == {(str(i), "held") for i in range(5)} | {("8", "merged"), ("9", "merged")}
    assert {r.guard for r in got if r.status == "held"} == {"max_distinct:v=3>2"}


def test_priced_pairs_are_the_pairs_made(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.choice(["x", "y", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    for rule in (["a"], ["a", "b"], ["b"]):
        assert blocking.price(df, rule).head().pairs == blocking.pairs(df, [rule], "id").count()
    both = blocking.pairs(df, [["a"], ["b"]], "id")
    assert both.count() == both.select("id_l", "id_r").distinct().count()


def test_em_raises_the_likelihood(spark):
    c = [scoring.Comparison("a"), scoring.Comparison("b")]
    counts = spark.createDataFrame([(1, 1, 90), (0, 0, 880), (1, 0, 20), (0, 1, 10), (-1, 1, 5)], "gamma_a int, gamma_b int, n long")
    m = scoring.train(counts, c, rounds=50)
    assert 0.05 < m.prior < 0.2 and m.m["a"][1] > 0.8 > 0.2 > m.u["a"][1]


def test_buckets_and_aliases(spark):
    df = spark.createDataFrame([(0.9,), (0.5,), (0.1,), (float("nan"),), (None,)], "p double")
    assert [r[0] for r in df.select(decisions.bucket(F.col("p"), 0.4, 0.8)).collect()] == ["accept", "review", "reject", "reject", "reject"]
    with pytest.raises(ValueError):
        registry.resolve_aliases(spark.createDataFrame([(1, 2), (2, 1)], "id long, alias_of long"))


def test_sources_and_sinks(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"company_number": "01", "data": {"kind": "x"}}\n' * 3)
    got = files.read_ndjson(spark, str(tmp_path / "a.jsonl.gz"))
    assert got.count() == 3 and got.head() == ("01", '{"kind":"x"}')
    (tmp_path / "a.csv").write_text("﻿id,name\n1,Ä\n", encoding="utf-8")
    assert files.read_csv(spark, str(tmp_path / "a.csv"), ["id"]).head() == ("1", "Ä")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "a.csv"), ["other"])
    out = str(tmp_path / "t.parquet")
    sinks.write_parquet(spark.createDataFrame([(2, "b"), (1, "a")], "id long, v string").withColumn("n", F.lit(None)), out, ["id"])
    sinks.write_parquet(spark.createDataFrame([(3, "c"), (1, "a")], "id long, v string"), out, ["id"])
    sinks.append_parquet(spark.createDataFrame([(9,)], "id int"), out)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, "a"), (3, "c"), (9, None)]
    assert files.read_projection(spark, out, ["id", "gone"]).columns == ["id"]
    assert files.read_reference(spark, str(tmp_path / "none")) is None


def test_stream_of_new_records(spark, tmp_path):
    spark.createDataFrame([("r1", "k1"), ("r2", "zz")], "record_id string, k string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k1", "E1"), ("k1", "E0")], "k string, entity_id string")
    got = []
    q = incremental.start(spark.readStream.schema("record_id string, k string").parquet(str(tmp_path / "in")), lambda: known, "k", lambda rows, n: got.extend(rows.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(map(tuple, got)) == [("r1", "E0"), ("r2", None)]
