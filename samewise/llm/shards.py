"""Token ids in training order: a keyed permutation gives every sequence its slot.

The documents, in the order of the token table, make one stream that is cut
into sequences of `length` ids. A Feistel network over the least even number
of bits, walked along its cycle until it lands below N, permutes 0..N-1 without
a table. Slots are dealt in ranges to shards of a fixed stride, so slot s lies
at byte (s % shard_sequences) * stride of shard s // shard_sequences: a reader
goes on from any slot by arithmetic alone. A manifest beside the shards names
N, the key, the stride and the number of shards, so a reader knows what it
goes on with and sees what is missing.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.columns import documents, pick
from samewise.llm.tokens import END, ByteEncoder, byte_encoder, squeeze, unsqueeze
from samewise.plans.materialize import save, shared_path, shuffle_partitions

LENGTH = 2048
SHARD_SEQUENCES = 2048
KEY = 0x5EED
ROUNDS = 6
TASK_BYTES = 1 << 28  # of shards that a task writes, one after the other, unless there are too few tasks then
MANIFEST = "manifest.json"


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser, keyed."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS, inverse: bool = False) -> np.ndarray:
    """Where each index below n goes (or, inverse, comes from)."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for r in reversed(range(rounds)) if inverse else range(rounds):
            f = lambda v: _mix(v, key * 1_000_003 + r) & mask  # noqa: B023, E731
            left, right = (right ^ f(left), left) if inverse else (right, left ^ f(right))
        return left << np.uint64(half) | right

    out = once(np.asarray(index, dtype=np.uint64))
    while (far := out >= np.uint64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder (a local path, file://, hdfs://, s3://, gs://) and the path in it."""
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))


def _joined(pieces: list) -> list:
    """The documents of a sequence's pieces; every run starts with a document of its own."""
    return [d for p in pieces for d in p[4]]


RUN = 256  # documents whose ids are kept as one compressed run


def _runs(encoder):
    """For mapInArrow over (id, text): (part, docs, lengths, inside, ids), a row for RUN documents in order; inside: the tokens of the part before."""

    def run(batches):
        from pyspark import TaskContext

        part, inside = TaskContext.get().partitionId(), 0
        for b in batches:
            for lo in range(0, b.num_rows, RUN):
                some = b.slice(lo, RUN)
                ids = [encoder(t) for t in some.column(1).to_pylist()]
                whole = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([some.column(0).to_pylist()], pa.list_(some.column(0).type)), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([inside], pa.int64()), pa.array([squeeze(whole)], pa.binary())],
                    names=["part", "docs", "lengths", "inside", "ids"],
                )
                inside += len(whole)

    return run


def write_shards(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_sequences: int = SHARD_SEQUENCES, key: int = KEY, encoder: ByteEncoder | None = None
) -> DataFrame:
    """Write shard-NNNNNN.bin files to a folder that all executors share (mounted, or hdfs://, s3:// and the like); (slot, sequence_id, shard, byte_offset, n_tokens, doc_ids, ids_crc32).

    One row for each sequence; n_tokens leaves out the padding of the last
    (id END). doc_ids: the documents in it, in order, null ids too. Ids are
    little-endian unsigned 16-bit, each document ends with END, null texts are
    empty. A shard is written beside its place and moved there whole, so a
    task that is tried again, or a second copy of it, does no harm; what a lost
    task left is a .shard- file that no reader looks at. An empty table writes
    the manifest alone. The result is lazy: the shards are written as it is
    computed, the manifest at once.
    """
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    tokens = save(rows.mapInArrow(_runs(encoder or byte_encoder()), f"part int, docs array<{id_type}>, lengths array<bigint>, inside long, ids binary"), "shards-tokens")
    sized = tokens.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"))
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    n_sequences = -(-total // length)
    n_shards = max(1, -(-n_sequences // shard_sequences))
    n_tasks = min(n_shards, max(shuffle_partitions(docs.sparkSession), -(-n_sequences * length * 2 // TASK_BYTES)))
    write_manifest(folder, {"sequences": n_sequences, "length": length, "shard_sequences": shard_sequences, "shards": -(-n_sequences // shard_sequences), "key": key, "rounds": ROUNDS, "tokens": total, "dtype": "<u2"})
    # the stream: the parts in order (a row for each task), the rows of a part in order
    bases = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def cut(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            kind = b.schema.field("docs").type
            for g, docs_, lengths, ids in zip(*(b.column(c).to_pylist() for c in ("at", "docs", "lengths", "ids")), strict=True):
                x, ends = unsqueeze(ids), np.cumsum(lengths)
                k = np.arange(g // length, (g + len(x) - 1) // length + 1)
                for s, to in zip(k.tolist(), permute(k, n_sequences, key).tolist(), strict=True):
                    lo, hi = max(0, s * length - g), min(len(x), (s + 1) * length - g)
                    first, last = np.searchsorted(ends, [lo, hi - 1], "right").tolist()
                    for col, v in zip(cols, (to // shard_sequences, to, s, g + lo - s * length, docs_[first : last + 1], squeeze(x[lo:hi])), strict=True):
                        col.append(v)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), kind, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["shard", "slot", "sequence_id", "off", "docs", "raw"])

    # a row for each task of the one before, so it goes to all
    placed = tokens.join(F.broadcast(bases), "part").select((F.col("base") + F.col("inside")).alias("at"), "docs", "lengths", "ids")
    pieces = placed.mapInArrow(cut, f"shard int, slot long, sequence_id long, off long, docs array<{id_type}>, raw binary")
    # a task writes a run of shards
    dealt = pieces.repartitionById(n_tasks, F.floor(F.col("shard").cast("long") * n_tasks / n_shards).cast("int")).sortWithinPartitions("shard", "slot", "off")

    def write(batches):
        from pyspark import TaskContext

        store, to = _store(folder)
        store.create_dir(to, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        f = shard = now = None
        held: list = []
        done: list[tuple] = []

        def close_sequence():
            ids = np.concatenate([unsqueeze(r[5]) for r in held])
            full = np.full(length, END, dtype="<u2")
            full[: len(ids)] = ids
            f.write(full.tobytes())
            r = held[0]
            done.append((r[1], r[2], r[0], (r[1] % shard_sequences) * 2 * length, len(ids), _joined(held), zlib.crc32(full.tobytes())))
            held.clear()

        def close_shard():
            f.close()
            store.move(f"{to}/.shard-{shard:06d}.{attempt}", f"{to}/shard-{shard:06d}.bin")

        def flush(kind):
            cols = list(zip(*done, strict=True)) or [()] * 7
            done.clear()
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "doc_ids", "ids_crc32"])

        kind = None
        for b in batches:
            kind = b.schema.field("docs").type
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[1] != now and held:
                    close_sequence()
                now = r[1]
                if r[0] != shard:
                    if f:
                        close_shard()
                    shard = r[0]
                    f = store.open_output_stream(f"{to}/.shard-{shard:06d}.{attempt}")
                held.append(r)
            yield flush(kind)
        if held:
            close_sequence()
        if f:
            close_shard()
            yield flush(kind)

    return dealt.mapInArrow(write, f"slot long, sequence_id long, shard int, byte_offset long, n_tokens long, doc_ids array<{id_type}>, ids_crc32 long")


def write_manifest(folder: str, facts: dict) -> None:
    store, to = _store(folder)
    store.create_dir(to, recursive=True)
    with store.open_output_stream(f"{to}/{MANIFEST}") as f:
        f.write(json.dumps(facts, sort_keys=True).encode())


def read_manifest(folder: str) -> dict:
    store, to = _store(folder)
    with store.open_input_stream(f"{to}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_slots(folder: str, start: int = 0, length: int | None = None, shard_sequences: int | None = None):
    """Sequences from a slot on, in training order: sequential reads, resumed anywhere.

    The manifest says how many there are. A shard that is missing or too short
    raises, as does a length or shard_sequences that the shards don't have.
    """
    facts, (store, to) = read_manifest(folder), _store(folder)
    for name, said in (("length", length), ("shard_sequences", shard_sequences)):
        if said not in (None, facts[name]):
            raise ValueError(f"{folder} has {name} {facts[name]}, not {said}")
    stride, per = 2 * facts["length"], facts["shard_sequences"]
    for shard in range(start // per, facts["shards"]):
        first = start % per if shard == start // per else 0
        held = min(per, facts["sequences"] - shard * per)
        with store.open_input_file(f"{to}/shard-{shard:06d}.bin") as f:
            if f.size() != held * stride:
                raise ValueError(f"shard {shard} of {folder} has {f.size()} bytes, not {held * stride}")
            f.seek(first * stride)
            for _ in range(first, held):
                yield np.frombuffer(f.read(stride), dtype=facts["dtype"])


def op3_token_shards(spark, sf_dir: str) -> DataFrame:
    """Every sequence of the corpus, its slot in training order and its place in the shards."""
    return write_shards(documents(spark, sf_dir), shared_path(spark, "shards"))


QUERIES = {"op3_token_shards": op3_token_shards}
ORACLE_SQL: dict[str, str] = {}
