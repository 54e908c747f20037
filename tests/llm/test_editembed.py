import hashlib
import random
from collections import Counter

from samewise.llm import editembed as E


def brute_fp(text):
    if not text:
        return "00"
    k, p, j, out = E.scale(len(text)), 0, 0, ""
    cls = E.classes(text)
    while cls[p] != E.STAY:
        if j % (1 << k) == 0:
            out += "0123456789abcdef"[E.SYMBOL[cls[p]]]
        p += int(E.MOVES[j % E.PERIOD][cls[p]])
        j += 1
    if j % (1 << k):
        pass
    return f"{k:02x}" + out


def texts(n=60, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("etaoin shrdlu éñ日") for _ in range(rng.choice([1, 3, 50, 130, 500, 2000]))) for _ in range(n)]


def test_walks_match_brute_force_one_by_one_and_together():
    some = texts()
    assert E.fingerprints(some) == [brute_fp(t) for t in some]
    assert [E.fingerprints([t])[0] for t in some[:10]] == [brute_fp(t) for t in some[:10]]


def test_likeness_follows_edits():
    rng = random.Random(4)
    t = "".join(rng.choice("etaoinshrdlu ") for _ in range(3000))
    other = "".join(rng.choice("etaoinshrdlu ") for _ in range(3000))
    one = t[:1000] + "XY" + t[1000:]
    f = E.fingerprints([t, one, other, E.edited(t, other), t])
    assert E.likeness(f[0], f[4]) == 1
    assert E.likeness(f[0], f[1]) > 0.8
    assert 0.5 < E.likeness(f[0], f[3]) < 0.8
    assert E.likeness(f[0], f[2]) < 0.2


def test_rows_match_brute_force(spark):
    some = texts(80, 2)
    rows = [(i * 3, t) for i, t in enumerate(some)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: -r[0])
    want = {}
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        e = E.edited(t, u)
        fs = [brute_fp(x) for x in (t, e, u)]
        want[i] = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), fs[0], fs[1], E.likeness(fs[0], fs[1]), E.likeness(fs[0], fs[2]))
    classes = dict(zip([i for i, _ in rows], brute_classes(rows), strict=True))
    want = {i: (*row, classes[i]) for i, row in want.items()}
    for parts in (2, 7):
        assert {r.id: tuple(r) for r in E.edit_robustness(df, parts=parts).collect()} == want


def brute_classes(rows, least=E.LEAST):
    """Components of all pairs with a likeness of least or more, by the smallest id that isn't null."""
    fps = [brute_fp(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if fps[i] == fps[j] or E.likeness(fps[i], fps[j]) >= least:
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            best[find(i)] = min(best.get(find(i), k), k)
    return [best.get(find(i)) for i in range(len(rows))]


def near_copies(seed=6):
    """Texts and edits of them: insertions, changed ends, cuts over a step in scale."""
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
    out = []
    for n in (9, 40, 70, 127, 130, 260, 700, 1024, 1100, 2000, 2100, 5000):
        t = say(n)
        out += [t, t[: n // 2] + "Q" + t[n // 2 :], t[:-2] + "zz", t + say(n // 20), t[: n - n // 10], say(n)]
    return out


def test_classes_match_brute_force(spark):
    some = near_copies()
    rows = list(enumerate(some)) + [(500, some[0]), (None, some[6]), (None, "nobody has this one"), (501, None), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((str(i), str(c)) for (i, _), c in zip(rows, brute_classes(rows), strict=True))
    assert len({c for _, c in want}) < 60
    for cell in (E.CELL, 6):
        got = E.near_classes(df, cell=cell).collect()
        assert sorted((str(r.id), str(r.component)) for r in got) == want
    strings = spark.createDataFrame([(None if i is None else f"d{i:04d}", t) for i, t in rows], "doc_id string, text string")
    by_text = {r.id: r.component for r in E.edit_robustness(strings).collect() if r.id}
    assert by_text == {f"d{int(i):04d}": f"d{int(c):04d}" for i, c in want if i != "None"}


def test_a_hot_band_loses_no_link(spark):
    """A long start that all share puts most in the same bands, far more than a cell holds; pairs unlike the first are still found."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
    start = say(900)
    rows = []
    for i in range(150):
        t = start + say(1100)
        rows += [(2 * i, t), (2 * i + 1, t[:1990] + "x" + t[1991:])]
    fps = E.fingerprints([t for _, t in rows])
    assert max(Counter(k for f in fps for k in set(E.bands(f))).values()) > 64
    got = {r.id: r.component for r in E.near_classes(spark.createDataFrame(rows, "doc_id long, text string"), cell=32).collect()}
    want = dict(zip([i for i, _ in rows], brute_classes(rows), strict=True))
    assert got == want and len(set(want.values())) > 100


def test_recall_of_bands_at_the_least_likeness():
    rng = random.Random(3)
    met = total = 0
    while total < 400:
        n = rng.choice([60, 200, 600, 1500, 4000, 9000])
        t = "".join(rng.choice("etaoinshrdlu ") for _ in range(n))
        u = t
        for _ in range(rng.randint(1, 3)):
            at, w = rng.randrange(n), rng.randint(1, max(1, n // 15))
            u = u[:at] + "".join(rng.choice("etaoinshrdlu ") for _ in range(w)) + u[at + rng.randint(0, w) :]
        a, b = E.fingerprints([t, u])
        if E.LEAST <= E.likeness(a, b) < E.LEAST + 0.05:
            total += 1
            met += bool(set(E.bands(a)) & set(E.bands(b)))
    assert met / total >= 0.95, met / total


def test_odd_tables(spark):
    schema = "doc_id long, text string, guest int"
    one = E.edit_robustness(spark.createDataFrame([(5, "abcdef", 1)], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert E.edit_robustness(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "aaa", 0), (1, "aaa", 0), (1, "bbb", 0), (None, "ccc", 0), (None, None, 0), (2, "x" * 200_000, 0)]
    assert len(E.edit_robustness(spark.createDataFrame(rows, schema)).collect()) == 6


def test_near_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("etaoinshrdlu ") for _ in range(1500)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:700] + "Q" + t[703:]) for i, t in enumerate(base)] + [(200, base[0]), (None, base[1]), (201, None)]
    found = {(r.a, r.b): r.likeness for r in E.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"), least=0.5).collect()}
    fp = dict(zip([i for i, _ in rows], E.fingerprints([t or "" for _, t in rows]), strict=True))
    alike = {(a, b) for a in range(12) for b in [100 + a] if E.likeness(fp[a], fp[b]) >= 0.5}
    # no unrelated pair, and of the alike ones as many as 48 bands of 6 samples find
    assert set(found) <= alike and len(found) >= 0.9 * len(alike) and len(alike) >= 8
    assert all(v == E.likeness(fp[a], fp[b]) for (a, b), v in found.items())
