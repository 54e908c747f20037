import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from samewise.llm import packing as P
from samewise.llm.tokens import byte_encoder, library, vocabulary

SCHEMA = "doc_id long, text string, source string, ids string"


def ids_of(text):
    return library(vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    some = "abc ÀéßŁñ\n\t  '’s't 12²½ \u0085 日本語́<|endoftext|> <|x 🙂ﬁ Ǆʰ".split(" ") + [" ", "  ", "\r\n", "\x1c", "\x0b"]
    enc = byte_encoder()
    for _ in range(600):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 12)))
        assert enc(t).tolist() == ids_of(t), repr(t)


def test_very_long_white_space(spark):
    enc = byte_encoder()
    texts = ["x" + " " * 2_000_000 + "y", "\n" * 2_000_000, " \n\t" * 700_000, "a" * 1_000_000]
    want = [ids_of(t) for t in texts]
    assert [enc(t).tolist() for t in texts] == want
    got = defaultdict(list)
    for r in P.pack(spark.createDataFrame([(i, t, "a", None) for i, t in enumerate(texts)], SCHEMA)).collect():
        got[r.id].append((r.start, np.frombuffer(r["ids"], dtype="<u2").tolist()))
    assert [[i for _, some in sorted(got[k]) for i in some] for k in range(len(texts))] == want


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(300):
        src = rng.choice(["a"] * 6 + ["b", "b", "c", None])
        rows.append((i, " ".join(rng.choice(["the", "cat", "ünd", "lorem"]) for _ in range(rng.choice([1, 5, 50, 300]))), src, "x"))
    rows += [(400, None, "a", None), (401, "", "b", None), (None, "hello", "c", None), (5, "again", "a", None), (5, "again", "a", None), (402, "long " * 60_000, "b", "")]
    return rows


def test_every_id_once_gapless_and_unpadded(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TOKENS", 20_000)
    rows = corpus()
    got = P.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    want = defaultdict(int)
    for r in rows:
        want[r[0], tuple(ids_of(r[1]))] += 1
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u2")
        assert len(ids) == r.length and zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.id, r.doc_tokens].append((r.start, tuple(ids.tolist())))
    for s, parts in by_seq.items():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at == 2048 or at & (at - 1) == 0 and s >= max(by_seq) - 11
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r.length for r in got) == sum(len(k[1]) * n for k, n in want.items())
    for (i, t), n in want.items():
        if n == 1 and sum(k[0] == i for k in want) == 1:
            pieces = sorted(by_doc[i, len(t)])
            assert tuple(x for _, ids in pieces for x in ids) == t
            assert [p[0] for p in pieces] == np.cumsum([0] + [len(p[1]) for p in pieces])[:-1].tolist()
    seqs = P.sequences(P.pack(spark.createDataFrame(rows, SCHEMA))).collect()
    assert all(len(s["ids"]) == 2 * s.n_tokens for s in seqs)


def test_windows_keep_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TOKENS", 100_000)
    rng = random.Random(3)
    rows = [(i, "the cat sat on a mat " * rng.randint(5, 60), "abc"[0 if i % 2 else 1 + i % 3 // 2], "") for i in range(2500)]
    got = P.pack(spark.createDataFrame(rows, SCHEMA), with_ids=False).collect()
    total, seq = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        total[r.source] += r.length
        seq[r.sequence_id][r.source] += r.length
    n = sum(total.values())
    run, done = defaultdict(int), 0
    for k in sorted(seq):
        done += sum(seq[k].values())
        for s in total:
            run[s] += seq[k][s]
            assert abs(run[s] - done * total[s] / n) < 2048, (k, s)


def plain_round_robin(docs, shares, size):
    """Pieces (document, start, length, sequence, offset) by deficits, one window after the other; docs: {source: [tokens, ...]}."""
    names = sorted(docs)
    heads, done = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    owed, out, g, turn = dict.fromkeys(names, 0.0), [], 0, 0
    left = sum(sum(x) for x in docs.values())
    full, rest = divmod(left, size)
    ends = [size * (k + 1) for k in range(full)]
    for b in reversed(range(size.bit_length())):
        if rest >> b & 1:
            ends.append((ends[-1] if ends else 0) + (1 << b))
    for seq, end in enumerate(ends):
        first = g
        live = [s for s in names if heads[s] < len(docs[s])]
        for s in live:
            owed[s] += (end - g) * shares[s] / sum(shares[x] for x in live)
        while g < end:
            live = [s for s in names if heads[s] < len(docs[s])]
            ring = [s for s in live if names.index(s) >= turn] + [s for s in live if names.index(s) < turn]
            rest_of = lambda s: docs[s][heads[s]] - done[s]  # noqa: B023, E731
            best = next((s for s in ring if owed[s] >= min(P.LEAST, rest_of(s), end - g)), None) or max(live, key=lambda s: (owed[s], -names.index(s)))
            take = min(end - g, rest_of(best), max(P.LEAST, int(owed[best])))
            out.append(((best, heads[best]), done[best], take, seq, g - first))
            owed[best] -= take
            done[best] += take
            if done[best] == docs[best][heads[best]]:
                heads[best], done[best] = heads[best] + 1, 0
            turn, g = names.index(best) + 1, g + take
    return out


def test_serving_matches_a_plain_round_robin():
    rng = random.Random(4)
    for trial in range(30):
        docs = {s: [rng.randint(1, 900) for _ in range(rng.randint(1, 40))] for s in "abcd"[: 1 + trial % 4]}
        sizes = {s: sum(x) for s, x in docs.items()}
        shares = {s: n / sum(sizes.values()) for s, n in sizes.items()} if trial % 2 else {s: 0.5 ** (i + 1) for i, s in enumerate(docs)}
        names, at = sorted(docs), {}
        queues = [[((s, i), n) for i, n in enumerate(docs[s])] for s in names]
        got = P.serve(queues, [0.0] * len(names), [shares[s] for s in names], 0, P.Grid(sum(sizes.values()), 512))
        assert got == plain_round_robin(docs, shares, 512)
        for doc, start, n, *_ in got:
            assert at.get(doc, 0) == start
            at[doc] = start + n
        assert at == {(s, i): n for s in names for i, n in enumerate(docs[s])}


def test_plan_runs_every_source_dry():
    for sizes, shares in [({"=a": 100, "=b": 900, None: 0}, {"=a": 0.5, "=b": 0.5}), ({"=a": 10, None: 90}, {"=a": 0.3}), ({"=a": 50, "=b": 50, None: 100}, {"=a": 1.0, "=b": 0.0}), ({None: 7}, {})]:
        got = P.plan(sizes, shares)
        for k, n in sizes.items():
            own = [(lo, hi) for s, lo, hi, *_ in got if s == k]
            assert sum(hi - lo for lo, hi in own) == n and all(a[1] == b[0] for a, b in zip(own, own[1:], strict=False))
    assert P.plan({"=a": 100, "=b": 900}, {"=a": 0.5, "=b": 0.5})[0] == ("=a", 0, 100, 0.0, 2.0, 0.5)
    with pytest.raises(ValueError, match="shares"):
        P.plan({"=a": 1}, {"=a": 1.5})


def test_target_proportions_hold_until_a_source_runs_dry(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_TOKENS", 50_000)
    rng = random.Random(3)
    rows = [(i, "the cat sat on a mat " * rng.randint(5, 60), "aaaaaabbcd"[i % 10], "") for i in range(2500)]
    df = spark.createDataFrame(rows, SCHEMA)
    shares = {"b": 0.5, "a": 0.3}  # c and d share the rest
    got = P.pack(df, with_ids=False, shares=shares).collect()
    total, seq = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        total[r.source] += r.length
        seq[r.sequence_id][r.source] += r.length
    want = defaultdict(int)
    for r in P.pack(df, with_ids=False).collect():
        want[r.source] += r.length
    assert total == want
    target = {"b": 0.5, "a": 0.3, "c": 0.1, "d": 0.1}
    dry = min(total[s] / target[s] for s in target)
    run, done = defaultdict(int), 0
    for k in sorted(seq):
        done += sum(seq[k].values())
        if done > dry - 4096:
            break
        for s in target:
            run[s] += seq[k][s]
            assert abs(run[s] - done * target[s]) < 4096, (k, s)
    assert k > 20
    # whatever the shares, every document is packed
    for odd in ({"b": 1.0}, {"zzz": 0.4}, {"a": 0.0}):
        assert sum(r.length for r in P.pack(df, with_ids=False, shares=odd).collect()) == sum(total.values())


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    assert P.pack(spark.createDataFrame([], SCHEMA), shares={"a": 0.5}).count() == 0
