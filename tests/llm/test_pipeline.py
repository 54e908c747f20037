"""The pipeline against brute force, stage by stage, on a small corpus."""

import random
from collections import Counter

import corpus_pipeline
from test_decontamination import brute as brute_leaks
from test_simhash import plain_jaccard
from test_substrings import brute as brute_repeats

from samewise.llm import toxicity
from samewise.llm.tokens import byte_encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    say = lambda n: [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(9)}" for _ in range(n)]
    items = [(i, " ".join(say(30))) for i in range(6)]
    shared = " ".join(say(70))
    docs, labels = [], []
    for i in range(260):
        w = say(rng.randint(40, 160))
        if i % 4 == 0:
            w[5:5] = [rng.choice(["vile", "scum", "rotten"]) for _ in range(3)]
        if i % 13 == 1:
            w += shared.split()
        if i % 17 == 2:
            w += items[i % 6][1].split()
        docs.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, 1, int(i % 4 == 0)))
    for j in range(20):  # exact and near copies
        i, t, lang, src = docs[rng.randrange(260)]
        w = t.split()
        if j % 2:
            w[len(w) // 2] = "changed"
        docs.append((300 + j, " ".join(w), lang, src))
    docs += [(400, None, None, None), (401, "", "en", "s1"), (402, "tiny text", "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs], items, labels


def brute_near_copies(rows):
    """For each row the smallest id that links reach; five-word shingles with a Jaccard similarity of 0.8 link."""
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, r in enumerate(rows):
        for o in rows[:k]:
            if plain_jaccard(r[1] or "", o[1] or "") >= 0.8:
                a, b = find(r[0]), find(o[0])
                root[max(a, b)] = min(a, b)
    return [find(r[0]) for r in rows]


def test_stages_match_brute_force(spark, tmp_path):
    docs, items, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    table = spark.read.parquet(f"{d}/documents.parquet")

    # 1: the model's own words decide, one document at a time; it finds the planted words
    model = toxicity.fit(table, spark.read.parquet(f"{d}/labels.parquet"))
    assert all("^" + w in model.weights or w in model.weights for w in ("vile", "scum", "^rott"))
    rows = [r for r in docs if not any(w in (r[1] or "").split() for w in ("vile", "scum", "rotten"))]
    got = corpus_pipeline.STAGES[0][1](spark, table, d)
    assert got.columns == table.columns and sorted(tuple(r) for r in got.collect()) == sorted(rows)

    # 2
    comp = brute_near_copies(rows)
    rows = [r for r, c in zip(rows, comp, strict=True) if r[0] == c]
    got = save_and_read(corpus_pipeline.STAGES[1][1](spark, got, d), tmp_path / "1")
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)

    # 3
    cut = brute_repeats([(r[0], r[1]) for r in rows])
    rows = [(i, cut[i, t], lang, s, n if cut[i, t] == t else len(cut[i, t])) for i, t, lang, s, n in rows if t is None or cut[i, t].strip() or not t.strip()]
    got = save_and_read(corpus_pipeline.STAGES[2][1](spark, got, d), tmp_path / "2")
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)

    # 4
    bad = {k[0] for k in brute_leaks([(r[0], r[1]) for r in rows], items)}
    rows = [r for r in rows if r[0] not in bad]
    assert bad
    got = save_and_read(corpus_pipeline.STAGES[3][1](spark, got, d), tmp_path / "3")
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)

    # 5, and all of it at once
    want = Counter({r[0]: len(byte_encoder()(r[1])) for r in rows})
    for out in (corpus_pipeline.STAGES[4][1](spark, got, d), corpus_pipeline.run(spark, d)):
        have = Counter()
        for r in out.collect():
            have[r.doc_id] += r.length
        assert have == want


def save_and_read(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_empty_documents(spark, tmp_path):
    _, items, labels = corpus()
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeats_are_cut_once_a_row(spark, tmp_path):
    docs, *_ = corpus()
    out = corpus_pipeline.cut_repeats(spark, spark.createDataFrame(docs, SCHEMA), str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [cut(") == 1
