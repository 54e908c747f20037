"""The opN_ queries themselves: columns, types and plain versions of what they return, on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from test_editembed import brute_classes, brute_fp
from test_simhash import brute_components
from test_simhash import brute_fp as brute_simhash

from samewise.llm import editembed, hmm, packing, shards, simhash, tokencount
from samewise.llm.tokens import library, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ünd", "日本", "x1", "Omega"]) + str(rng.randrange(40)) for _ in range(n))
    rows = [(i, say(rng.choice([3, 30, 120])), "en", f"s{i % 3}", 1) for i in range(0, 60, 2)]
    rows += [(101, rows[3][1], "en", "s9", 1), (103, rows[5][1].upper(), None, None, None), (105, None, None, None, None), (107, "", "en", "s0", 0), (109, " \t\n ", "en", "s0", 3)]
    rows += [(111, say(2500), "de", "s1", 1), (113, rows[7][1] + " tail", "en", "s1", 1), (115, "<|endoftext|> a", "en", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("contracts")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{to}/documents.parquet")
    return str(to)


def typed(df, **want):
    kinds = dict(df.dtypes)
    assert {k: kinds[k] for k in want} == want
    return df.collect()


def test_op1(spark, folder):
    rows = documents()
    got = typed(simhash.op1_simhash_near_dedup(spark, folder), doc_id="bigint", fingerprint="string", component_id="bigint")
    fps = [brute_simhash(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(rows, fps, 3), strict=True)]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted(want)


def test_op3(spark, folder):
    got = typed(shards.op3_token_shards(spark, folder), slot="bigint", sequence_id="bigint", byte_offset="bigint")
    total = sum(len(ids(r[1])) for r in documents())
    assert sorted(r.slot for r in got) == list(range(-(-total // shards.LENGTH))) and sum(r.n_tokens for r in got) == total


def test_op4(spark, folder):
    rows = documents()
    got = {r.doc_id: r for r in typed(editembed.op4_fingerprints(spark, folder), doc_id="bigint", n_chars="bigint", edited_sha256="string", fingerprint="string", edited_fingerprint="string", near_edited="double", near_next="double", component_id="bigint")}
    classes = dict(zip([r[0] for r in rows], brute_classes([(r[0], r[1]) for r in rows]), strict=True))
    order = sorted(rows, key=lambda r: -r[0])
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        t, u = r[1] or "", nxt[1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + u[:n]
        g = got[r[0]]
        assert (g.n_chars, g.edited_sha256, g.fingerprint, g.edited_fingerprint, g.component_id) == (len(t), hashlib.sha256(e.encode()).hexdigest(), brute_fp(t), brute_fp(e), classes[r[0]])
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1


def test_op5(spark, folder):
    rows = documents()
    got = {r.doc_id: r for r in typed(hmm.op5_lm_scores(spark, folder), doc_id="bigint", held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")}
    train = sum(len((r[1] or "").encode().lower().split()) + 1 for r in rows if zlib.crc32(str(r[0]).encode()) % 10)
    for i, t, *_ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0) and got[i].train_tokens == train
        assert got[i].n_tokens == len((t or "").encode().lower().split()) + 1 and got[i].score < 0


def ids(text):
    return library(vocabulary("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids + [1]


def test_op8(spark, folder):
    import numpy as np

    got = typed(packing.op8_packing(spark, folder), doc_id="bigint", start="bigint", length="bigint", ids_crc32="bigint", doc_tokens="bigint", sequence_id="bigint", offset="bigint")
    by_seq, by_doc = defaultdict(list), defaultdict(int)
    texts = {r[0]: ids(r[1]) for r in documents()}
    for r in got:
        some = np.array(texts[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(some.tobytes()) and r.doc_tokens == len(texts[r.doc_id])
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    assert by_doc == {k: len(v) for k, v in texts.items()}
    for parts in by_seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 2048


def test_op10(spark, folder):
    lib = library(vocabulary("word_bpe_49k.json"))
    got = {r.doc_id: r for r in typed(tokencount.op10_token_counts(spark, folder), doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean")}
    for i, t, *_ in documents():
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048)
    assert any(r.over_limit for r in got.values())
