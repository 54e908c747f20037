import random

import numpy as np
import xxhash

from samewise.llm import substrings as S

SCHEMA = "doc_id long, text string"


def brute_cuts(text: bytes):
    """The rolling hash one byte at a time."""
    h, ends, last = 0, [], 0
    for _ in range(S.WINDOW):
        h = ((h << 1) + int(S.GEAR[0])) & 0xFFFF
    for i, b in enumerate(text):
        h = ((h << 1) + int(S.GEAR[b])) & 0xFFFF
        nxt = text[i + 1] if i + 1 < len(text) else 0
        if S.SPACE[b]:
            cut = not S.SPACE[nxt] and h < 65536 // S.WORD_CUTS
        else:
            cut = nxt & 0xC0 != 0x80 and h < 65536 // S.INNER_CUTS
        if i + 1 == len(text):
            cut = True
        while i + 1 - last > S.LONGEST:
            last += S.LONGEST
            while text[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if cut:
            ends.append(i + 1)
            last = i + 1
    return ends


def brute(rows, min_words=S.MIN_WORDS):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, np.uint64(xxhash.xxh64_intdigest((r[1] or "").encode())).astype(np.int64))):
        raw = (t or "").encode()
        a, places = 0, []
        for b in brute_cuts(raw):
            if raw[a:b] in seen:
                places.append(a << 12 | (b - a))
            seen.add(raw[a:b])
            a = b
        kept, at = b"", 0
        for a, b in S.passages(raw, places, min_words):
            kept += raw[at:a]
            at = b
        out[i, t] = None if t is None else (kept + raw[at:]).decode()
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    shared = [words(rng, 60) for _ in range(3)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(5, 150))]
        if i % 2:
            parts += [rng.choice(shared), words(rng, rng.randint(0, 60))]
        rows.append((i, " ".join(parts)))
    rows += [(70, rows[3][1]), (3, rows[3][1]), (71, None), (72, ""), (None, rows[5][1]), (73, "x" * 9000), (74, "é" * 5000 + " " + words(rng, 30))]
    rows += [(3, words(rng, 20) + " " + shared[0])]
    return rows, shared


def test_cuts_equal_the_rolling_hash():
    for _, t in corpus()[0]:
        raw = (t or "").encode()
        assert S.cuts([b"other", raw, b""])[1].tolist() == brute_cuts(raw)


def test_result_matches_brute_force_and_catches_passages(spark):
    rows, shared = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    got = S.remove_repeats(df).collect()
    assert len(got) == len(rows)
    left = sorted((str(r.doc_id), str(r.text)) for r in got)
    assert left == sorted((str(i), str(want[i, t])) for i, t in rows)
    for p in shared:
        assert len({(r.doc_id, r.text) for r in got if p in (r.text or "")}) <= 1  # repeated rows are one document
    # texts without repeats stay whole
    assert all(r.text == dict(rows)[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 60 and r.doc_id % 2 == 0)


def test_spans_are_code_points_of_the_old_text(spark):
    rows, _ = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows if i != 3], "doc_id long, text string, spans string")
    old = {i: t for i, t in rows if i != 3}
    for r in S.remove_repeats(df).collect():
        t, at, kept = old[r.doc_id] or "", 0, ""
        for s in r["_spans"]:
            kept += t[at : s["start"]]
            at = s["end"]
        assert kept + t[at:] == (r.text or "")
        assert r.spans == "x"


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shift_resistance():
    rng = random.Random(9)
    t = words(rng, 400).encode()
    a, b = (set(np.diff(S.cuts([x])[0]).tolist()) and S.cuts([x])[0] for x in (t, b"new words " + t))
    tail = {len(t) - x for x in a.tolist()} & {len(t) + 10 - x for x in b.tolist()}
    assert len(tail) >= len(a) - 3


def test_passages_without_white_space_are_cut(spark):
    rng = random.Random(21)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    code = "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(4000))
    shared = han(1500)
    rows = [(1, han(700) + shared + han(300)), (2, han(200) + shared + han(900)), (3, code), (4, code), (5, han(40))]
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].text == t for i, t in rows] == [True, False, True, False, True]
    assert got[4].text == "" and got[4].spans[0] == (0, 4000)
    cut = sum(e - s for s, e in got[2].spans)
    assert 0.5 * len(shared) < cut <= len(shared) and len(got[2].text) == len(rows[1][1]) - cut
    assert {(i, r.text) for i, r in got.items()} == {(i, t) for (i, _), t in brute(rows).items()}
