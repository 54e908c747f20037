import math
import random
import zlib
from collections import Counter

import numpy as np

from samewise.llm import hmm as H

SCHEMA = "doc_id long, text string, score double"


def corpus(n=120):
    rng = random.Random(1)
    vocab = [[f"{p}{i}" for i in range(40)] for p in "ab"]
    rows = [(i, " ".join(rng.choice(vocab[i % 2]) if rng.random() < 0.97 else f"rare{rng.randrange(200)}" for _ in range(rng.randint(1, 80))), 0.0) for i in range(n)]
    return rows + [(500, None, 0.0), (501, "", 0.0), (502, "UPPER upper\tzz", 0.0), (None, "a1 a2", 0.0), (3, rows[3][1], 0.0)]


def held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def test_base_counts_match_brute_force(spark):
    rows = corpus()
    toks = [[*(t or "").encode().lower().split(), H.END] for _, t, _ in rows]
    c = Counter(w for (i, _, _), ws in zip(rows, toks, strict=True) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _, _), ws in zip(rows, toks, strict=True))
    got = H.score_texts(spark.createDataFrame(rows, SCHEMA), rounds=1, symbols=30, counted=50).collect()
    assert sorted((str(r.id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_held_out_texts_gain_over_the_base(spark):
    got = H.score_texts(spark.createDataFrame(corpus(600), SCHEMA)).where("held_out").collect()
    base, score, n = (sum(getattr(r, k) for r in got) for k in ("base_score", "score", "n_tokens"))
    assert (score - base) / n > 0.1


def brute_forward(s, first, trans, emit):
    a = first * emit[s[0]]
    for x in s[1:]:
        a = (a @ trans) * emit[x]
    return math.log10(a.sum())


def model(states=3, size=5):
    rng = np.random.default_rng(2)
    first, trans, emit = rng.random(states), rng.random((states, states)), rng.random((size, states))
    return first / first.sum(), trans / trans.sum(axis=1, keepdims=True), emit / emit.sum(axis=0)


def test_forward_is_exact_and_probabilities_sum_to_one():
    first, trans, emit = model()
    rng = random.Random(1)
    seqs = [np.array([rng.randrange(5) for _ in range(rng.randint(1, 30))]) for _ in range(40)]
    assert np.allclose(H.forward_scores(seqs, first, trans, emit), [brute_forward(s, first, trans, emit) for s in seqs])
    every = [np.array([a, b, c]) for a in range(5) for b in range(5) for c in range(5)]
    assert math.isclose((10 ** H.forward_scores(every, first, trans, emit)).sum(), 1)
    assert np.isfinite(H.forward_scores([np.zeros(50_000, dtype=int)], first, trans, emit)).all()


def test_expected_counts_match_enumeration():
    first, trans, emit = model(2, 3)
    seqs = [np.array([0, 1, 2, 1]), np.array([2]), np.array([1, 1])]
    counts = (np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)))
    H.expect(seqs, np.array([True, True, True]), first, trans, emit, counts)
    want = (np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2)))
    for s in seqs:
        paths = [[k >> t & 1 for t in range(len(s))] for k in range(2 ** len(s))]
        p = np.array([first[z[0]] * np.prod([emit[x, k] for x, k in zip(s, z, strict=True)]) * np.prod([trans[a, b] for a, b in zip(z, z[1:], strict=False)]) for z in paths])
        for z, w in zip(paths, p / p.sum(), strict=True):
            want[0][z[0]] += w
            for a, b in zip(z, z[1:], strict=False):
                want[1][a, b] += w
            for x, k in zip(s, z, strict=True):
                want[2][x, k] += w
    assert all(np.allclose(a, b) for a, b in zip(counts, want, strict=True))


def test_segments_count_every_token_and_move_once():
    first, trans, emit = model()
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 5, n) for n in (1, 7, 8, 9, 40, 65)]
    whole = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    cut = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    likely = H.expect(texts, np.ones(6, dtype=bool), first, trans, emit, whole)
    parts = [p for t in texts for p in H.segmented(t, 8, 6)]
    got = H.expect([p[0] for p in parts], np.array([p[1] for p in parts]), first, trans, emit, cut, np.array([p[2] for p in parts]), np.array([p[3] for p in parts]))
    assert math.isclose(likely, sum(brute_forward(t, first, trans, emit) for t in texts) * math.log(10))
    assert math.isclose(cut[2].sum(), sum(map(len, texts))) and math.isclose(cut[1].sum(), sum(len(t) - 1 for t in texts))
    assert all(np.allclose(a, b, rtol=0.03, atol=0.03) for a, b in zip(whole, cut, strict=True)) and abs(got - likely) < 0.01 * abs(likely)


def test_frequent_words_are_all_from_a_count_on(spark):
    rng = random.Random(2)
    rows = [(bytearray(f"w{i}".encode()), rng.choice([1, 1, 1, 2, 3, 5, 40, 1000])) for i in range(500)] + [(bytearray(H.END), 1)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 10, 200, 501):
        got = {bytes(r.word): r.c for r in H.frequent(counts, most).collect()}
        assert got.pop(H.END) == 1 and len(got) <= most
        least = min(got.values(), default=10**9)
        assert all(bytes(w) in got for w, c in rows if c >= least and bytes(w) != H.END)
    assert len(got) == 500


def test_sums_by_way_of_salts(spark):
    rng = np.random.default_rng(1)
    rows = [(k, t % 4, rng.random(6).tobytes()) for t in range(40) for k in (-1, 0, 1)]
    want = {k: sum(np.frombuffer(r[2]) for r in rows if r[0] == k) for k in (-1, 0, 1)}
    df = spark.createDataFrame([(k, s, bytearray(x)) for k, s, x in rows], H.SUMS).repartition(7)
    for salts in (1, 4):
        use = df if salts > 1 else df.selectExpr("chunk", "0 AS salt", "sums")
        got = {r.chunk: np.frombuffer(r.sums) for r in H._summed(use, salts)}
        assert sorted(got) == sorted(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_tables_without_training_rows(spark):
    assert H.score_texts(spark.createDataFrame([], SCHEMA), rounds=1).count() == 0
    got = H.score_texts(spark.createDataFrame([(None, "a b", 0.0)], SCHEMA), rounds=1).collect()
    assert got[0].n_known == 0 and got[0].train_tokens == 0
