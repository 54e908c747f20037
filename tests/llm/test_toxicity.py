import math
import random

import numpy as np

from samewise.llm import toxicity as T


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    bad = ["vile", "scum", "rotten", "filth"]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        y = i % 5 == 0
        if y:
            for _ in range(rng.randint(1, 6)):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        docs.append((i, " ".join(w), y))
        labels.append((i, 0, int(y)))
    return docs, labels


def test_held_out_accuracy_and_severity_order(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, quality int, toxic int")
    model = T.fit(df, lab)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) >= 2
    got = {r.doc_id: r.toxicity for r in T.with_severity(df, model).collect()}
    held = [i for i, _, _ in docs if i % 3 == 0]
    truth = {i: y for i, _, y in docs}
    assert sum(got[i].toxic == truth[i] for i in held) / len(held) > 0.97
    assert all(not got[i].toxic for i in held if not truth[i])
    few = T.with_severity(spark.createDataFrame([(1, "vile"), (2, "vile scum rotten filth")], "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.toxicity.severity for r in few}
    assert by[2] > by[1]


def test_gradient_finds_the_known_model():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 6)) < 0.4
    w = np.array([2.0, -1.5, 1.0, 0.0, 0.5, -0.5])
    theta = np.array([0.0, 1.5, 3.0])
    s = x @ w
    y = (rng.logistic(size=4000) + s)[:, None] > theta[None, :]
    rows, cols = np.nonzero(x)
    got, thresholds = T.fit_ordinal(rows, cols, y.sum(axis=1), np.ones(4000), 6, l2=0.01)
    assert np.abs(got - w).max() < 0.3 and np.abs(thresholds - theta).max() < 0.3


def test_probabilities_sum_to_one():
    m = T.OrdinalModel({"a": 1.0}, [0.0, 1.0, 2.5])
    p = m.probabilities(np.array([-100.0, 0.0, 1.0, 100.0]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert math.isclose(p[1, 0], 0.5)


def test_odd_rows(spark):
    docs, labels = corpus(200)
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    lab = spark.createDataFrame(labels + labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = T.fit(df, lab)
    odd = spark.createDataFrame(
        [(1, None, "k"), (1, None, "k"), (2, "", "k"), (3, "123 ... !", "k"), (None, "vile scum filth rotten", "k"), (4, "word " * 300_000, "k")],
        "doc_id long, text string, toxicity string",
    )
    got = [(r.doc_id, r.toxicity, r["_toxicity"].severity, r["_toxicity"].toxic) for r in T.with_severity(odd, model).collect()]
    assert len(got) == 6 and all(x[1] == "k" for x in got)
    assert [x[2] for x in got[:4]] == [0, 0, 0, 0] and got[4][3] and not got[5][3]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = T.fit(df, empty)
    assert {r["_toxicity"].grade for r in T.with_severity(odd, none).collect()} == {0}
    assert T.with_severity(df.limit(0), model).count() == 0


def brute(text, model):
    """Severity, chance of a grade above 0 and likeliest grade, one word at a time."""
    words = set()
    run = ""
    for c in (text or "").lower() + " ":
        if T.WORD.fullmatch(c):
            run += c
        elif run:
            words.add(run)
            run = ""
    if not words:
        return 0.0, 0.0, 0
    words |= {"^" + w[:4] for w in words if len(w) > 4}
    score = sum(model.weights.get(w, 0.0) for w in words)
    below = [1 / (1 + math.exp(-(t - score))) for t in model.thresholds] + [1.0]
    p = [b - a for a, b in zip([0.0, *below], below, strict=False)]
    return sum(k * x for k, x in enumerate(p)), 1 - p[0], max(range(len(p)), key=lambda k: p[k])


def test_query_matches_brute_force(spark, tmp_path):
    docs, labels = corpus(300)
    docs = [d[:2] for d in docs] + [(900, None), (901, ""), (902, "Vile, SCUM!"), (903, "½ 12")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet")
    models = [T.fit(d, read("labels")) for d in (read("documents"), read("documents").repartition(5))]
    assert models[0].weights == models[1].weights and models[0].thresholds == models[1].thresholds
    got = {r.doc_id: r for r in T.op2_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        severity, p, grade = brute(t, models[0])
        assert math.isclose(got[i].severity, severity, abs_tol=1e-9) and math.isclose(got[i].p_toxic, p, abs_tol=1e-9) and got[i].grade == grade and got[i].toxic == (p >= 0.3)
    assert got[902].toxic and got[902].severity > 1


def test_words_are_those_of_surest_rates(spark, monkeypatch):
    docs, labels = corpus(300)
    y = {i: t for i, _, t in labels}
    rows = [(y[i], sorted(T.features(t))) for i, t, _ in docs]
    n1 = sum(y.values())
    n0 = len(rows) - n1
    z = {}
    for w in {w for _, own in rows for w in own}:
        df, in1 = sum(w in own for _, own in rows), sum(w in own for g, own in rows if g)
        every = df / (n1 + n0)
        if df >= T.MIN_DF:
            z[w] = (in1 / n1 - (df - in1) / n0) ** 2 / max(every * (1 - every) * (1 / n1 + 1 / n0), 1e-12)
    want = sorted((w for w in z if z[w] >= T.SURE), key=lambda w: (-round(z[w], 9), w))
    got = T.telling_words(spark.createDataFrame(rows, "grade int, words array<string>"), n1, n0)
    assert sorted(got) == sorted(want) and [round(z[w], 9) for w in got] == [round(z[w], 9) for w in want]
