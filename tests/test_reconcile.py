import pytest
from pyspark.sql import functions as F

from samewise import queries as catalogue
from samewise.functions import companies
from samewise.operators import reconcile as R

NAMES = ["red ring", "red ring", "ring", "RED  ring (uk)", "company", "", None, "hot red bolt", "big old red steel ring", "bolt"]


def _rows(spark, ids):
    rows = [(b, i, n, (n or "no") + " co" if i % 3 else n) for b in ("x", "y", None) for i, n in zip(ids, NAMES, strict=True)]
    return spark.createDataFrame(rows, "b string, id long, l string, r string")


def _pairs(rows):
    l, r = (rows.select("b", F.col("id").alias(f"id_{s}"), F.col(s).alias(f"name_{s}")) for s in "lr")
    return R.verdicts(l.join(r, "b").where("id_l < id_r").drop("b"), "name_l", "name_r")


def _sorted(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ids", [range(10), [0, 1, 2, 2, 4, 5, 6, 6, 8, 9]])
def test_blocks_judge_as_pairs_do(spark, ids):
    rows = _rows(spark, ids)
    want = _pairs(rows).select("id_l", "id_r", "verdict", "confidence", "reason")
    got = R.block_verdicts(rows, ["b"], "id", "l", "r")
    assert got.dtypes == want.dtypes and _sorted(got) == _sorted(want)
    assert len({r.reason for r in want.collect()}) > 4


def test_first_true_of_blocks(spark):
    rows = _rows(spark, range(10)).where("b = 'x'")
    want = R.first_true(_pairs(rows).select("id_l", "id_r", "verdict"), "id_l", "id_r")
    assert _sorted(R.block_first_true(rows, ["b"], "id", "l", "r")) == _sorted(want)
    twice = _rows(spark, range(10)).where("b IS NOT NULL")  # ids stand in two blocks
    want = R.first_true(_pairs(twice).select("id_l", "id_r", "verdict"), "id_l", "id_r")
    assert _sorted(R.block_first_true(twice, ["b"], "id", "l", "r")) == _sorted(want)


@pytest.mark.parametrize("name", ["x_rule_verdicts", "x_first_true"])
def test_names_are_cleaned_before_they_are_paired(spark, name):
    """In the plan no name is cleaned, and no window sorts, above the join of the pairs."""
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join Inner")]
    assert "regexp_replace" not in above and "Window" not in above
