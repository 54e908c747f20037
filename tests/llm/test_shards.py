import random
from pathlib import Path

import numpy as np
import pytest

from samewise.llm import shards as S
from samewise.llm.tokens import byte_encoder


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 100, 1000, 4097])
def test_permutation(n):
    p = S.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert S.permute(p, n, inverse=True).tolist() == list(range(n))
    if n > 50:
        assert S.permute(np.arange(n), n, key=9).tolist() != p.tolist() != list(range(n))


def test_round_trip_and_resume(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "cat", "ünd"]) for _ in range(rng.randint(0, 300))), "x") for i in range(120)]
    rows += [(200, None, "x"), (201, "", "x"), (None, "hello", "x"), (5, "again", "x"), (202, "long " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    meta = sorted(S.write_shards(df, f"file://{tmp_path}/out", length=64, shard_sequences=16).collect())
    n = len(meta)
    assert [m.slot for m in meta] == list(range(n)) and sorted(m.sequence_id for m in meta) == list(range(n))
    slots = [x.tolist() for x in S.read_slots(f"{tmp_path}/out", 0, 64, 16)]
    assert len(slots) == n
    stream = [0] * n
    for m in meta:
        stream[m.sequence_id] = slots[m.slot][: m.n_tokens]
        assert m.shard == m.slot // 16 and m.byte_offset == m.slot % 16 * 128
    flat = [i for s in stream for i in s]
    enc, at = byte_encoder(), 0
    docs = sorted(tuple(enc(t).tolist()) for _, t, _ in rows)
    found = []
    while at < len(flat):
        end = flat.index(1, at) + 1
        found.append(tuple(flat[at:end]))
        at = end
    assert sorted(found) == docs
    assert [x.tolist() for x in S.read_slots(f"{tmp_path}/out", 37, 64, 16)] == slots[37:]
    assert {i for m in meta for i in m.doc_ids} == {r[0] for r in rows}


def test_against_plain_permute_and_cut(spark, tmp_path):
    """The op's stream, cut and permuted in plain Python, gives the same slots; many shards in few tasks."""
    rows = [(i, "word " * (i % 50), "x") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").coalesce(1)
    meta = S.write_shards(df, f"{tmp_path}/out", length=32, shard_sequences=4, key=11).collect()
    enc = byte_encoder()
    flat = np.concatenate([enc(t) for _, t, _ in rows]).tolist()
    want = {}
    cut = [flat[i : i + 32] for i in range(0, len(flat), 32)]
    for k, ids in enumerate(cut):
        want[int(S.permute(np.array([k]), len(cut), 11)[0])] = ids + [1] * (32 - len(ids))
    assert [x.tolist() for x in S.read_slots(f"{tmp_path}/out")] == [want[s] for s in range(len(cut))]
    assert {m.slot: m.sequence_id for m in meta} == {int(S.permute(np.array([k]), len(cut), 11)[0]): k for k in range(len(cut))}


def test_gaps_raise(spark, tmp_path):
    df = spark.createDataFrame([(i, "word " * 40) for i in range(40)], "doc_id long, text string")
    to = f"{tmp_path}/out"
    S.write_shards(df, to, length=32, shard_sequences=4).count()
    facts = S.read_manifest(to)
    assert len(list(S.read_slots(to))) == facts["sequences"] and facts["shards"] > 3
    with pytest.raises(ValueError, match="length"):
        list(S.read_slots(to, 0, 64))
    short = Path(f"{to}/shard-000002.bin")
    whole = short.read_bytes()
    short.write_bytes(whole[:-64])
    with pytest.raises(ValueError, match="shard 2"):
        list(S.read_slots(to))
    short.unlink()
    with pytest.raises(FileNotFoundError):
        list(S.read_slots(to))


def test_empty(spark, tmp_path):
    assert S.write_shards(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/none").count() == 0
    assert list(S.read_slots(f"{tmp_path}/none")) == []
