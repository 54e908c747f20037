import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from samewise.llm import meeting, simhash
from samewise.operators.graph import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, fps, radius):
    root = {i: i for i in range(len(rows))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        c = find(i)
        if r[0] is not None:
            best[c] = min(best.get(c, r[0]), r[0])
    return [best.get(find(i)) for i in range(len(rows))]


def texts(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(40, 400))))
    return out


@pytest.mark.parametrize("group", [1024, 2])
def test_classes_match_brute_force(spark, group):
    rows = [(i + 5, t, "en", "s", 1) for i, t in enumerate(texts(150))]
    rows += [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (None, "Hello  World", "en", "s", 1)]
    rows += [(900, "hello\tworld", "en", "s", 1), (901, "hello world", "en", "s", 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(((r[0] or -1), f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(rows, fps, 3), strict=True))
    got = simhash.near_duplicate_classes(df, group=group).select("id", F.lower(F.hex("fp")), "component").collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in got) == want


def test_links_find_every_pair_in_radius_whatever_the_group_size(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(60):
        x = rng.choice(sorted(fps))
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(30)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f.to_bytes(8, "big"),) for f in fps], "fp binary")
    from samewise.operators.graph import connected_components

    want = brute_components([(f,) for f in fps], fps, 3)
    for group in (1024, 2):
        cc = {r[0]: r[1] for r in connected_components(simhash.links(df, 3, 1, group), "a", "b").collect()}
        got = [int.from_bytes(cc.get(b := f.to_bytes(8, "big"), b), "big") for f in fps]
        assert got == want


def test_two_lane_radius(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(128) for _ in range(20)]
    for f in fps[:20]:
        x = f
        for b in rng.sample(range(128), rng.choice([8, 9, 10, 11])):
            x ^= 1 << b
        fps.append(x)
    df = spark.createDataFrame([(f.to_bytes(16, "big"),) for f in fps], "fp binary")
    got = {frozenset((bytes(r[0]), bytes(r[1]))) for r in simhash.links(df, 9, 2).collect()}
    want = {frozenset((a.to_bytes(16, "big"), b.to_bytes(16, "big"))) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 9}
    assert got == want


def test_large_two_lane_entries_are_split_until_few_bits_are_open(spark):
    rng = random.Random(6)
    base, fps = rng.getrandbits(128), set()
    while len(fps) < 150:  # near copies of one fingerprint
        x = base
        for b in rng.sample(range(128), rng.randint(3, 6)):
            x ^= 1 << b
        fps.add(x)
    df = spark.createDataFrame([(f.to_bytes(16, "big"),) for f in sorted(fps)], "fp binary")
    assert simhash.depth(64, 3) == 3
    chain = ((0, -1),) * simhash.depth(128, 9)
    assert len(simhash.remaining(128, 9, chain)[0]) <= simhash.OPEN
    from samewise.operators.graph import connected_components

    cc = connected_components(simhash.links(df, 9, 2, 100), "a", "b").collect()
    assert len(cc) == len(fps) and len({bytes(r.component) for r in cc}) == 1


def test_rows_that_repeat_an_id_leave_a_defined_one(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, n) for n in range(40)] + [(1, base + " more", 7), (2, base, 0)]
    kept = set()
    for parts in (1, 3, 7):
        got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(parts)).collect()
        assert [r.doc_id for r in got] == [1]
        kept.add((got[0].text, got[0].extra))
    assert len(kept) == 1


def test_deduplicate_keeps_smallest_id_and_all_columns(spark):
    base = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"thing{i}" for i in range(300))
    near = base.replace("word150", "changed")
    rows = [(4, base, 1, 2), (2, base, 3, 4), (7, near, 5, 6), (9, other, 7, 8), (9, other, 7, 8), (None, base, 9, 9), (11, None, 0, 0), (12, "", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, kept_id int")
    got = sorted(((r.doc_id or -1), r.fp) for r in simhash.deduplicate(df).collect())
    assert got == [(-1, 9), (2, 3), (9, 7), (11, 0)]


def test_empty_table_and_long_text(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicate_classes(empty).count() == 0
    assert simhash.deduplicate(empty).count() == 0
    big = "a b c d " * 200_000
    df = spark.createDataFrame([(1, big, "", "", 1), (2, big, "", "", 1)], SCHEMA)
    got = simhash.near_duplicate_classes(df).collect()
    assert {r["component"] for r in got} == {1}
    assert int.from_bytes(got[0]["fp"], "big") == brute_fp(big)


def plain_jaccard(a, b, k=5):
    x, y = ({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_are_told_by_shingles_in_order(spark):
    rng = random.Random(8)
    w = [f"w{i}" for i in range(200)]
    shuffled = rng.sample(w, len(w))
    short_of = w[:30] + ["x1"] + w[31:80] + ["x2"] + w[81:130] + ["x3"] + w[131:170] + ["x4", "x5"] + w[172:190] + ["x6"] + w[191:]
    tail_cut = w[:165]  # alike at 0.82, with a sixth of the words missing
    rows = [(i, " ".join(x)) for i, x in enumerate([w, shuffled, short_of, tail_cut])]
    assert plain_jaccard(rows[0][1], rows[2][1]) < 0.8 <= plain_jaccard(rows[0][1], rows[3][1])
    got = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


@pytest.mark.parametrize("cell", [2048, 4])
def test_near_copy_classes_match_brute_force_jaccard(spark, cell):
    rng = random.Random(9)
    out = texts(90, seed=9)
    for t in out[:30]:
        w = t.split()
        out.append(" ".join(w[: round(len(w) * rng.uniform(0.75, 0.95))]))
    rows = list(enumerate(out))
    root = list(range(len(out)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(out)):
        for j in range(i):
            if plain_jaccard(out[i], out[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = simhash.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string"), cell=cell).collect()
    assert sorted((r["id"], r["component"]) for r in got) == [(i, find(i)) for i in range(len(out))]


def test_rows_of_a_key_meet_across_batches(spark):
    rng = random.Random(12)
    rows = [(rng.randrange(40), bytes([i // 250, i % 250])) for i in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = meeting.met(spark.createDataFrame(rows, "key long, node binary").repartition(3, "key").sortWithinPartitions("key")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    heads = {(r.key, bytes(r.head)) for r in got}
    assert len(heads) == len({k for k, _ in rows})
    assert sorted([(r.key, bytes(r.node)) for r in got] + list(heads)) == sorted(rows)


def test_lanes_are_majorities_over_the_set(spark):
    text = " ".join(f"w{i % 70}" for i in range(400)).encode()  # 70 different shingles, most of them repeated
    own = simhash.shingle_set(text)
    want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in own) > len(own))
    fp = simhash.set_lanes(own, 3)
    assert len(own) == 70 and len(fp) == 24 and int.from_bytes(fp[:8], "big") == want
    assert len({fp[:8], fp[8:16], fp[16:]}) == 3


def test_near_links_connect_all_pairs_within_the_radius(spark):
    rng = random.Random(21)
    lanes, radius = simhash.layout(60)
    fps = [rng.getrandbits(64 * lanes) for _ in range(30)]
    for f in fps[:30]:
        x = f
        for b in rng.sample(range(64 * lanes), rng.randint(radius - 8, radius)):
            x ^= 1 << b
        fps.append(x)
    df = spark.createDataFrame([(f.to_bytes(8 * lanes, "big"),) for f in fps], "fp binary")
    got = {frozenset(int.from_bytes(x, "big") for x in r) for r in simhash.near_links(df, lanes, radius).collect()}
    assert got == {frozenset(p) for p in zip(fps[:30], fps[30:], strict=True)}


def test_a_dense_entry_is_one_tree(spark):
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 1 << 63, (30, 3), dtype=np.uint64)
    dense = np.repeat(rows[:1], 2 * simhash.MATRIX, axis=0)
    dense[np.arange(len(dense)), np.arange(len(dense)) % 3] ^= np.uint64(1) << rng.integers(0, 64, len(dense)).astype(np.uint64)
    for some in (dense, dense[:100]):
        edges = simhash.near_forest(np.concatenate([some, rows[1:]]), 48)
        assert len(edges) == len(some) - 1 and len({x for e in edges for x in e}) == len(some)


def test_edges_of_a_dense_group_grow_with_its_rows_not_with_its_entries(spark):
    rng = random.Random(8)
    lanes, radius = simhash.layout(400)
    width = 64 * lanes
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(width), n))
    centres = [rng.getrandbits(width) for _ in range(40)]
    fps = [flip(centres[0], 14) for _ in range(300)] + [flip(c, n) for c in centres[1:] for n in (6, 12, 18)]
    df = spark.createDataFrame([(f.to_bytes(width // 8, "big"),) for f in fps], "fp binary")
    edges = simhash.near_links(df, lanes, radius)
    assert edges.count() < 1.5 * len(fps)  # 5602, 13 a fingerprint, where each variant gave edges of its own
    got = {int.from_bytes(r.node, "big"): r.component for r in connected_components(edges, "a", "b").collect()}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(fps)):
        for j in range(i):
            if find(i) == find(j):
                assert got[fps[i]] == got[fps[j]]
            elif (i < 300) != (j < 300):
                assert fps[i] not in got or got.get(fps[j]) != got[fps[i]]


def test_classes_get_no_edges_within_and_one_between():
    rows = np.zeros((9, 3), dtype=np.uint64)
    rows[:, 0] = [0, 1, 3, 0, 1, (1 << 60) - 1, (1 << 60) - 2, 7, 15]
    rows[5:7, 1] = (1 << 60) - 1
    classes = np.array([4, 4, 4, 9, 9, 2, 2, -1, -2])
    assert simhash.near_forest(rows[:3], 48, classes[:3]) == [] == simhash.near_forest(rows[5:7], 48, classes[5:7])
    for many in (1, simhash.MATRIX):  # as one matrix, and searched from head to head
        edges = simhash.near_forest(np.repeat(rows, many, axis=0), 48, np.repeat(classes, many))
        assert sorted(tuple(sorted((classes[i // many], classes[j // many]))) for i, j in edges) == [(-2, 4), (-1, 4), (4, 9)]


def test_near_copies_are_those_that_the_simhash_index_lets_meet(spark, monkeypatch):
    base = [f"word{i}" for i in range(300)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:150] + ["changed"] + base[151:])), (3, "\n".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [1]
    none = spark.createDataFrame([], "a binary, b binary")
    monkeypatch.setattr(simhash, "near_links", lambda *_: none)
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == [1, 2]  # equal sets are one text
