import random

import pytest
from pyspark.sql import functions as F

from samewise.operators import models, training
from samewise.sources import published


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        a, b = rng.random(), rng.random()
        rows.append((str(i), str(i + 1), a if i % 9 else None, b, None, a + 0.2 * b > 0.6, 1.0, i % 3))
    return spark.createDataFrame(rows, "id_l string, id_r string, a double, b double, none double, same boolean, weight double, fold int")


def test_trees_learn_and_come_back(spark, labelled, tmp_path):
    m = models.fit(labelled, ["a", "b", "none"], rounds=5)
    got = models.score(labelled, m)
    assert got.columns == [*labelled.columns, "model_score"]
    assert training.auc_brier(got.where("a IS NOT NULL"), "model_score", "same").head().auc > 0.95
    assert max(m.importance, key=m.importance.get) == "a" and m.importance["none"] == 0
    models.store(m, str(tmp_path / "v1"))
    again = models.score(labelled, models.load(spark, str(tmp_path / "v1")))
    assert [round(r.model_score, 9) for r in again.orderBy("id_l").collect()] == [round(r.model_score, 9) for r in got.orderBy("id_l").collect()]
    with pytest.raises(ValueError):
        models.score(labelled.drop("b"), m)


def test_curves_rise(spark, labelled):
    curve = [x / 4 for x in (0, 1, 2, 4, 4)]
    df = spark.createDataFrame([(0.0,), (0.5,), (0.625,), (1.0,), (1.5,)], "s double")
    assert [r[0] for r in df.select(models.along(curve, F.col("s"))).collect()] == [0, 0.5, 0.75, 1, 1]
    rates = [r[0] for r in labelled.orderBy("b").select(models.isotonic(labelled, "b", "same").alias("r")).collect()]
    assert all(x <= y + 1e-12 for x, y in zip(rates, rates[1:], strict=False))
    assert models.label_next(labelled, "a", "b", 15).count() == 15


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(g,) for g, n in {"a": 9, "b": 5, "c": 4, "d": 1}.items() for _ in range(n)], "g string")
    assert training.folds(df, "g", 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    s = spark.createDataFrame([(0.1,), (0.2,), (0.9,)], "s double")
    assert training.collapsed(s, "s", 0, 0.15, 0.5) and not training.collapsed(s, "s", 10, 0.15, 0.5, distinct=2)


def test_versions_are_whole_and_guarded(spark, tmp_path):
    f = str(tmp_path / "pub")
    one = spark.createDataFrame([("r1", "E1"), ("r2", "E1"), ("r3", "E2")], "record_id string, entity_id string")
    two = spark.createDataFrame([("r1", "E1"), ("r2", "E2"), ("r4", "E4")], "record_id string, entity_id string")
    assert published.publish(f, one, None) == 1
    with pytest.raises(ValueError):
        published.publish(f, two, None)
    assert published.publish(f, two, 1) == 2
    got = {tuple(r) for r in published.members(spark, f).collect()}
    assert got == {("r1", "E1", 1, None), ("r2", "E1", 1, 2), ("r2", "E2", 2, None), ("r3", "E2", 1, 2), ("r4", "E4", 2, None)}
