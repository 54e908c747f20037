import random

import pytest

from samewise.functions import similarity as S
from samewise.operators import entities as E
from samewise.operators import overlays as O


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_collisions_leave_every_id_once(spark, seed):
    rng = random.Random(seed)
    rows = [(f"k{i}", rng.choice(["a", "b", f"r{i}", "r3", "r3-2", "r4-2"]), "minted", rng.random() < 0.3, rng.randrange(4), f"r{i}") for i in range(30)]
    got = E.break_collisions(spark.createDataFrame(rows, "entity_key string, entity_id string, id_status string, from_registry boolean, n_records long, smallest_record string")).collect()
    assert sorted(r.entity_key for r in got) == sorted(r[0] for r in rows)
    assert len({r.entity_id for r in got}) == len(rows)
    kept = {r.entity_id: r.entity_key for r in got if r.id_status == "minted"}
    for eid in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == eid]
        best = min(mine, key=lambda r: (not r[3], 0 if r[3] else -r[4], r[5]))
        assert kept[eid] == best[0]


def test_suffix_skips_what_is_taken(spark):
    rows = [("k1", "x", "minted", False, 2, "r1"), ("k2", "x", "minted", False, 1, "r2"), ("k3", "r2", "kept", True, 1, "r3"), ("k4", "r2-2", "kept", True, 1, "r4")]
    got = {r.entity_key: r.entity_id for r in E.break_collisions(spark.createDataFrame(rows, "entity_key string, entity_id string, id_status string, from_registry boolean, n_records long, smallest_record string")).collect()}
    assert got == {"k1": "x", "k2": "r2-3", "k3": "r2", "k4": "r2-2"}


def test_reason_reads_whole_numbers_without_a_point(spark):
    df = spark.createDataFrame([(1958.0, "1961.0"), (None, "x")], "l double, r string")
    assert [r[0] for r in df.select(O.veto_reason("born {left}, not {right}", df.l, df.r)).collect()] == ["born 1958, not 1961", "born , not x"]


def test_swaps_count_once():
    def slow(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                for k in range(1, i):
                    for m in range(1, j):
                        if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                            d[i, j] = min(d[i, j], d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        return d[len(a), len(b)]

    rng = random.Random(5)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(8))) for _ in "ab")
        assert S.damerau_levenshtein(a, b) == slow(a, b)
