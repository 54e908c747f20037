import random
import re
from collections import Counter

import duckdb
import xxhash

from samewise.llm import decontamination as D
from samewise.llm import sieve

W = re.compile(r"[^\W_]+")


def sh(words):
    k = min(5, len(words))
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def sim(a, b):
    return sum(min(a[s], b[s]) * len(s) for s in a | b) / sum(max(a[s], b[s]) * len(s) for s in a | b)


def fp(c):
    out = 0
    for b in range(64):
        if sum((1 if xxhash.xxh64_intdigest(s, seed=42) >> b & 1 else -1) * len(s) * n for s, n in c.items()) > 0:
            out |= 1 << b
    return out


def brute(docs, items, radius=D.RADIUS):
    out = {}
    for i, t in docs:
        w = W.findall((t or "").lower())
        for j, q in items:
            x = W.findall((q or "").lower())
            if not x or not w:
                continue
            n, a, k = min(len(x), len(w)), sh(x), min(5, len(x))
            # windows in which a shared shingle stands where it stands in the item, moved inside the document
            at = {max(0, min(p - c, len(w) - len(x))) for p in range(len(w) - k + 1) for c in range(len(x) - k + 1) if w[p : p + k] == x[c : c + k]}
            for s in sorted(at):
                b = sh(w[s : s + n])
                if sim(a, b) >= 0.8 and bin(fp(a) ^ fp(b)).count("1") <= radius:
                    if (i, j) not in out or sim(a, b) > out[i, j][1]:
                        out[i, j] = (s, sim(a, b))
    return out


def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(j, say(rng.randint(15, 60))) for j in range(12)] + [(20, say(3)), (21, say(1))]
    docs = []
    for i in range(50):
        w = say(rng.randint(0, 150))
        if i % 2:
            q = list(rng.choice(items[:12])[1])
            for _ in range(i % 5):  # edits
                q[rng.randrange(len(q))] = rng.choice(vocab)
            w += q + say(rng.randint(0, 20))
        docs.append((i, " ".join(w).capitalize() + (". " if i % 3 else "")))
    q = items[3][1]
    docs += [(60, " ".join(q[:-2])), (61, " - ".join(q).upper()), (62, None), (63, ""), (64, "... !"), (61, " - ".join(q).upper())]
    docs += [(65, " ".join(items[12][1])), (None, " ".join(q)), (66, "lorem " * 30_000 + " ".join(q))]
    return docs, [(j, " ".join(q)) for j, q in items] + [(30, None), (31, " ,"), (3, " ".join(q))]


def test_pairs_match_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id): (r.start_word, round(r.similarity, 9)) for r in D.leaks(d, b).collect()}
    want = brute([x for x in docs if x[0] != 66], items)
    assert {k: v[1] for k, v in got.items() if k[0] != 66} == {k: round(v[1], 9) for k, v in want.items()}
    assert got[66, 3] == (30_000, 1.0)
    assert (61, 3) in got and (None, 3) in got and (65, 20) in got
    kept = D.drop_leaking(d.withColumn("own_hash", d.doc_id), b)
    assert kept.columns == ["doc_id", "text", "own_hash"]
    bad = {k[0] for k in got}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_large_benchmark_goes_by_shuffle(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.leaks(d, b).collect()))
    monkeypatch.setattr(D, "SMALL_ROWS", -1)
    assert sorted(map(str, D.leaks(d, b).collect())) == want


def test_beyond_a_listed_benchmark_a_sieve_keeps_shingles_from_the_shuffle(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(str, D.leaks(d, b).collect()))
    monkeypatch.setattr(D, "LISTED", -1)
    monkeypatch.setattr(D, "SMALL_ROWS", -1)
    monkeypatch.setattr(D, "SIEVE_BITS", 14)
    assert sorted(map(str, D.leaks(d, b).collect())) == want
    hashes = [3, -5, 1 << 40, 77]
    bitmap = sieve.sieve(spark.createDataFrame([(h,) for h in hashes], "h long"), 14).head()["sieve"]
    assert len(bitmap) == 1 << 8 and {i for i in range(1 << 14) if bitmap[i >> 6] >> (i & 63) & 1} == {h & 0x3FFF for h in hashes}


def test_long_items_and_repeats(spark):
    """Thousands of words, with shingles that repeat: the similarity of sets of elements is the multisets'."""
    rng = random.Random(12)
    q = [rng.choice(["a", "bb", "ccc"]) for _ in range(3000)]
    w = q[:1500] + ["x"] * 120 + q[1620:]
    rows = [(1, " ".join(q)), (2, "start " * 50 + " ".join(w))]
    got = D.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(q))], "item_id long, text string")).collect()
    # the window of the second text that fits best
    assert {r.id: round(r.similarity, 9) for r in got} == {1: 1.0, 2: round(max(sim(sh(q), sh((["start"] * 50 + w)[s : s + 3000])) for s in (48, 49, 50)), 9)}


def test_blocks_reach_every_pair_in_radius_and_few_others():
    rng = random.Random(2)
    near, bits, mask = D._near(D.RADIUS), D.BLOCK_BITS, (1 << D.BLOCK_BITS) - 1
    met = lambda x: any((x >> i & mask).bit_count() <= near for i in range(0, 64, bits))
    for _ in range(2000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(0, D.RADIUS)))
        assert met(x)


def test_empty_tables(spark):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert D.leaks(d.limit(0), b).count() == 0
    assert D.leaks(d, b.limit(0)).count() == 0
    assert D.drop_leaking(d, b.limit(0)).count() == len(docs)


def test_sql_gives_the_same(spark, tmp_path):
    docs, items = corpus()
    docs = [x for x in docs if x[0] is not None and x != docs[55]]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([x for x in items if x[0] != 3 or x is items[3]], "item_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(r[0], r[1]): r[4] for r in c.sql(D.OP6_SQL).fetchall()}
    got = {(r.doc_id, r.item_id): r.similarity for r in D.op6_decontamination(spark, str(tmp_path)).collect()}
    assert got == want


def test_alike_windows_far_apart_in_bits_are_found(spark):
    rng = random.Random(31)
    say = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    docs, items, bits = [], [], []
    while len(items) < 6:
        x = say(60)
        w = x[:53] + say(7)
        d = bin(fp(sh(x)) ^ fp(sh(w))).count("1")
        if sim(sh(x), sh(w)) >= 0.8 and d > 15:
            docs.append((len(docs), " ".join(say(20) + w + say(20))))
            items.append((len(items), " ".join(x)))
            bits.append(d)
    assert max(bits) <= D.RADIUS
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.id, r.item_id) for r in got) == [(i, i) for i in range(6)]
