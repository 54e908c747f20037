"""Document fingerprints by randomised edit embedding.

All texts are walked by the same random walk: at step j it puts out the
character it stands on and moves on or stays by a random bit of (j, character).
Walks over texts that differ in a few edits come together again soon after
each, so edit distance becomes Hamming distance between outputs. A fingerprint
keeps evenly spaced steps, four bits each. Texts whose fingerprints agree in a
band of sampled steps are held against each other over the whole fingerprint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import documents, pick
from samewise.llm.meeting import forests, spanning_links
from samewise.operators.graph import connected_components
from samewise.plans.materialize import discard, save, shuffle_partitions

SAMPLES = 256  # of a walk, about; a step in 2**k is kept, with the least k that gives no more
PERIOD = 8192  # steps after which the walk's bits come again
BLOCK = 4 << 20  # characters embedded at once
FEW = 12  # texts that are walked one by one
LEAST = 0.9  # likeness from which on two texts are near copies
#: Sampled positions of a band at most. Letters are few and uneven, so a sample agrees by chance in one of ten pairs
#: and a band of 12 in one of 10 ** 12; at a likeness of 0.9 all bands of a range miss with (1 - 0.906 ** 12) ** 12, or 13 in 1,000.
BANDS, BAND = 12, 12
MISS = 0.02  # lesser likenesses have shorter bands, so that no more pairs are missed
RANGES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192)  # first samples from which the positions of a band are drawn
CELL = 2048  # fingerprints that are held against each other at once

_rng = np.random.Generator(np.random.PCG64(20250101))
STAY = 255  # the class of the place behind a text
MOVES = np.hstack([_rng.integers(0, 2, (PERIOD, 255), dtype=np.uint8), np.zeros((PERIOD, 1), dtype=np.uint8)])
SYMBOL = _rng.integers(0, 16, 256, dtype=np.uint8)
SYMBOL[STAY] = 16
HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def classes(text: str) -> np.ndarray:
    """Character classes 0..254 of the code points, then STAY."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.append((points.astype(np.uint64) * np.uint64(2654435761) % np.uint64(4294967291) % np.uint64(255)).astype(np.uint8), np.uint8(STAY))


def scale(n: int) -> int:
    """k of a text of n characters, whose walk takes about 2n steps."""
    return max(0, (max(1, 2 * n) - 1).bit_length() - 8)


def _walk_one(cls: bytes, k: int) -> np.ndarray:
    out, p, j, stride = [], 0, 0, 1 << k
    moves = [m.tobytes() for m in MOVES]
    while cls[p] != STAY:
        out.append(SYMBOL[cls[p]])
        for _ in range(stride):
            p += moves[j % PERIOD][cls[p]]
            j += 1
    return np.array(out, dtype=np.uint8)


def _walk_many(many: list[np.ndarray], k: int) -> list[np.ndarray]:
    """All walks a step at a time; walks that are over drop out."""
    data = np.concatenate(many)
    pos = np.concatenate([[0], np.cumsum([len(x) for x in many])[:-1]]).astype(np.int64)
    alive = np.arange(len(many))
    out: list[list[np.ndarray]] = []
    which: list[np.ndarray] = []
    j, stride = 0, 1 << k
    while len(alive):
        c = data[pos]
        out.append(SYMBOL[c])
        which.append(alive)
        for _ in range(stride):
            pos += MOVES[j % PERIOD].take(c)
            j += 1
            c = data.take(pos)
        on = c != STAY
        if not on.all():
            pos, alive = pos[on], alive[on]
    symbols, docs = np.concatenate(out), np.concatenate(which)
    by = np.argsort(docs, kind="stable")
    ends = np.searchsorted(docs[by], np.arange(1, len(many)))
    return np.split(symbols[by], ends)


def fingerprints(texts: list[str]) -> list[str]:
    """Two hex digits for k, then one a sample. Equal texts have equal fingerprints; the empty one is "00"."""
    out = [""] * len(texts)
    groups: dict[int, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(scale(len(t)) if t else -1, []).append(i)
    for k, own in groups.items():
        if k < 0:
            for i in own:
                out[i] = "00"
            continue
        cls = [classes(texts[i]) for i in own]
        walks = [_walk_one(c.tobytes(), k) for c in cls] if len(own) <= FEW else _walk_many(cls, k)
        for i, w in zip(own, walks, strict=True):
            out[i] = f"{k:02x}" + HEX[w].tobytes().decode()
    return out


def likeness(a: str, b: str) -> float:
    """Share of equal samples at the coarser of two scales, less what chance gives; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    ka, kb = int(a[:2], 16), int(b[:2], 16)
    k = max(ka, kb)
    x = np.frombuffer(a[2:].encode(), dtype=np.uint8)[:: 1 << (k - ka)]
    y = np.frombuffer(b[2:].encode(), dtype=np.uint8)[:: 1 << (k - kb)]
    if not len(x) or not len(y):
        return 0.0
    n = min(len(x), len(y))
    share = np.count_nonzero(x[:n] == y[:n]) / max(len(x), len(y))
    return float(max(0.0, (share - 1 / 16) / (1 - 1 / 16)))


# ---------------------------------------------------------------- near duplicates

_band_rng = np.random.Generator(np.random.PCG64(7))
BAND_AT = [_band_rng.integers(0, r, (BANDS, BAND)) for r in RANGES]


def needed_share(least: float) -> float:
    """Equal samples, as a share of the longer fingerprint, that a likeness takes."""
    return least * (1 - 1 / 16) + 1 / 16


def band_length(least: float) -> int:
    """Samples of a band, as many as miss no more than MISS of the pairs at `least`."""
    return max(m for m in range(1, BAND + 1) if m == 1 or (1 - needed_share(least) ** m) ** BANDS <= MISS)


def bands(fp: str, least: float = LEAST) -> list[int]:
    """Keys of sampled positions.

    A fingerprint has bands over the largest range that it fills and, where an
    alike one may not fill that, over the next smaller one; if an alike one
    may be at the next scale, at that scale too.
    """
    k, body, share = int(fp[:2], 16), np.frombuffer(fp[2:].encode(), dtype=np.uint8), needed_share(least)
    out, width = [], band_length(least)
    for up in (0, 1):
        s = body[:: 1 << up]
        if not len(s) or up and len(s) < 120 * share:  # a walk of the next scale has some 128 samples at least
            break
        top = max(i for i, r in enumerate(RANGES) if r <= len(s))
        for i in (top, top - 1) if top and share * len(s) < RANGES[top] else (top,):
            out += [xxhash.xxh64_intdigest(x.tobytes(), (k + up) << 16 | i << 8 | b) - (1 << 63) for b, x in enumerate(s[BAND_AT[i][:, :width]])]
    return out


def forest(fps: list[str], least: float = LEAST) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with a likeness of least or more."""
    n, share = len(fps), needed_share(least)
    scales = np.array([int(f[:2], 16) for f in fps])
    size = np.array([len(f) - 2 for f in fps])
    samples = np.full((n, max(1, int(size.max()))), 255, dtype=np.uint8)
    for i, f in enumerate(fps):
        samples[i, : size[i]] = np.frombuffer(f[2:].encode(), dtype=np.uint8)
    root, out = np.arange(n), []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[root[later] != root[i]]
        for k in np.unique(scales[later]).tolist():
            some = later[scales[later] == k]
            down_i, down = 1 << max(0, k - int(scales[i])), 1 << max(0, int(scales[i]) - k)
            own = samples[i, : size[i] : down_i]
            lengths = -(-size[some] // down)
            fits = np.minimum(lengths, len(own)) >= share * np.maximum(lengths, len(own))
            some, lengths = some[fits], lengths[fits]
            other = samples[some, : size.max() : down][:, : len(own)]
            equal = (other == own[: other.shape[1]]).sum(axis=1)
            score = (equal / np.maximum(lengths, max(1, len(own))) - 1 / 16) / (1 - 1 / 16)
            for j in some[(score >= least) & (lengths > 0)].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
                    out.append((i, j))
    return out


def _embedded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, node, fp), saved: the text's hash, a digest of the fingerprint and the fingerprint."""
    rows = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")

    def embed(batches):
        for b in batches:
            fps = fingerprints([t or "" for t in b.column(2).to_pylist()])
            nodes = [xxhash.xxh3_128_digest(f.encode()) for f in fps]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(fps, pa.string())], names=["id", "own", "node", "fp"])

    return save(rows.mapInArrow(embed, f"id {rows.schema['id'].dataType.simpleString()}, own long, node binary, fp string"), "editembed-texts")


def _links(nodes: DataFrame, least: float, cell: int) -> DataFrame:
    """(a, b): nodes of (node, fp) that are alike; they connect what the alike pairs that share a band connect."""
    spark = nodes.sparkSession

    def index(batches):
        for b in batches:
            keys = [bands(f, least) for f in b.column(1).to_pylist()]
            counts = [len(x) for x in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k for own in keys for k in own], pa.int64()), b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), counts)))], names=["key", "node"])

    def compare(cells: DataFrame) -> DataFrame:
        laid = cells.join(nodes, "node").select("cell", "node", "fp")
        return save(forests(laid.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell"), str, lambda fps: forest(fps, least)), "editembed-links")

    return spanning_links(nodes.mapInArrow(index, "key long, node binary"), compare, cell)


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """(a, b, likeness): verified links between different fingerprints, named by their smallest ids.

    They connect what all pairs that share a band and have a likeness of least
    or more connect; a group of alike texts has a link less than it has
    fingerprints. Equal texts are one; other texts of equal fingerprints are
    linked to the smallest id of theirs. Null ids are left out; null texts are
    empty.
    """
    texts = _embedded(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col)
    nodes = save(texts.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp")), "editembed-nodes")
    equal = texts.groupBy("node", "own").agg(F.min("id").alias("b")).join(nodes.select("node", F.col("id").alias("a")), "node").where("a <> b").select("a", "b", F.lit(1.0).alias("likeness"))
    edges = _links(nodes.select("node", "fp"), least, cell)
    side = lambda n, c, f: nodes.select(F.col("node").alias(n), F.col("id").alias(c), F.col("fp").alias(f))
    pairs = edges.join(side("a", "ia", "fa"), "a").join(side("b", "ib", "fb"), "b").select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "fa", "fb")
    kind = nodes.schema["id"].dataType.simpleString()

    def measured(batches):
        for b in batches:
            values = [likeness(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(values, pa.float64())], names=["a", "b", "likeness"])

    return pairs.mapInArrow(measured, f"a {kind}, b {kind}, likeness double").unionByName(equal)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, cell: int = CELL) -> DataFrame:
    """(id, own, component), once for each id and text (by its hash, own): the smallest id that links and equal fingerprints reach.

    Null ids have the component of their text, null if it has no id. Null
    texts are like empty ones. An empty table gives an empty table.
    """
    texts = _embedded(docs, id_col, text_col)
    least_id = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id"))["id"].alias("least")
    nodes = save(texts.groupBy("node").agg(least_id, F.first("fp").alias("fp")), "editembed-nodes")
    cc = connected_components(_links(nodes.select("node", "fp"), least, cell), "a", "b")
    named = nodes.select("node", "least").join(cc, "node")  # what has no link is its own class
    best = named.groupBy("component").agg(F.min("least").alias("least"))
    linked = save(named.select("node", "component").join(best, "component").select("node", F.col("least").alias("component")), "editembed-linked")
    named = texts.select("id", "own", "node").join(nodes.select("node", "least"), "node").join(linked, "node", "left")
    out = save(named.select("id", "own", F.coalesce("component", "least").alias("component")).distinct(), "editembed-classes")
    for t in (texts, nodes, linked):
        discard(t)
    return out


# ---------------------------------------------------------------- documents and their neighbours

def _position(kind: str) -> Column:
    """A number that rises with the id; equal for strings that share their first seven bytes."""
    if kind != "string":
        return F.col("id")
    return F.conv(F.hex(F.rpad(F.substring(F.col("id").cast("binary"), 1, 7), 7, F.lit(bytearray(1)))), 16, 10).cast("long")


def _zipped(batches):
    """For mapInArrow over (id, own, text): the text compressed, since it is shuffled whole."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack.compress((t or "").encode()) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "own", "text"])


def with_next(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """docs dealt out by ranges of descending id and sorted: (guest, id, component, text), texts compressed.

    Every partition ends with a guest, the row that follows its last one, so
    neighbours never cross partitions. After the last row comes the first.
    Null ids come last; equal ids by a hash of the text. classes, (id, own,
    component), go the same way: a row without a text before the rows it is for.
    """
    spark = docs.sparkSession
    n = parts or max(2, shuffle_partitions(spark))
    rows = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("own"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    # one number for each partition
    bounds = rows.agg(F.percentile_approx(_position(kind), [i / n for i in range(1, n)], 10 * n).alias("b")).head()["b"] or []
    bounds = sorted(set(bounds))
    below = F.size(F.filter(F.lit(bounds) if bounds else F.array().cast("array<bigint>"), lambda b: b <= _position(kind)))
    # null ids, which may be many, are dealt by their hashes
    bucket = F.when(F.col("id").isNull(), F.lit(len(bounds) + 8) - F.shiftright("own", 60).cast("int")).otherwise(F.lit(len(bounds)) - below).alias("bucket")
    heads = [(r["bucket"], r["h"]) for r in rows.groupBy(bucket).agg(F.max(F.struct("id", "own")).alias("h")).orderBy("bucket").collect()]
    follow = [(h["id"], h["own"], heads[i - 1][0]) for i, (_, h) in enumerate(heads)]
    tiny = spark.createDataFrame(follow, f"hid {kind}, hown long, target int")
    # of rows that share id and text any may follow: they are alike
    zipped = rows.mapInArrow(_zipped, f"id {kind}, own long, text binary")
    marked = zipped.select(bucket, "id", "own", "text").join(F.broadcast(tiny), F.col("id").eqNullSafe(F.col("hid")) & (F.col("own") == F.col("hown")), "left")
    ways = F.filter(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("target").alias("bucket"), F.lit(1).alias("guest"))), lambda w: w["bucket"].isNotNull())
    none = F.lit(None)
    texts = marked.select(F.explode(ways).alias("w"), "id", "own", "text").select("w.bucket", "w.guest", "id", "own", none.cast(kind).alias("component"), "text")
    named = classes.select(bucket, F.lit(0).alias("guest"), "id", "own", "component", none.cast("binary").alias("text"))
    return (
        texts.unionByName(named)
        .repartitionById(len(bounds) + 17, "bucket")
        .sortWithinPartitions(F.col("guest"), F.col("id").desc_nulls_last(), F.col("own").desc(), F.col("text").isNotNull())
        .select("guest", "id", "component", "text")
    )


def edited(text: str, following: str) -> str:
    """The last third replaced by as many characters from the start of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def edit_robustness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component) for every row.

    component: the smallest id of the row's near copies, by near_classes().
    Null texts are empty. A single row follows itself. Rows with null ids come
    after all others. Ids are numbers or strings. An empty table gives an
    empty table.
    """
    rows = with_next(docs, near_classes(docs, id_col, text_col), id_col, text_col, parts)
    id_kind = rows.schema["id"].dataType.simpleString()

    def block(ids, named, texts):
        """Results of all rows but the last, which only follows."""
        changed = [edited(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
        m = len(changed)
        fps = fingerprints(texts + changed)
        own, fp2 = fps[: m + 1], fps[m + 1 :]
        return [
            ids[:m],
            [len(t) for t in texts[:m]],
            [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            own[:m],
            fp2,
            [likeness(a, b) for a, b in zip(own[:m], fp2, strict=True)],
            [likeness(a, b) for a, b in zip(own[:m], own[1:], strict=True)],
            named[:m],
        ]

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        ids, named, texts, held, kind, over, component = [], [], [], 0, None, False, None
        for b in batches:
            kind = b.schema.field(1).type
            for guest, i, c, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if t is None:
                    component = c
                    continue
                if over:
                    continue
                over = bool(guest)
                ids.append(i)
                named.append(component)
                texts.append(unpack.decompress(t).decode())
                held += len(texts[-1])
                if held > BLOCK and len(ids) > 1:
                    yield out(block(ids, named, texts), kind)
                    ids, named, texts, held = ids[-1:], named[-1:], texts[-1:], len(texts[-1])
        if len(ids) > 1:
            yield out(block(ids, named, texts), kind)

    def out(cols, kind):
        types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), kind]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "component"])

    return rows.mapInArrow(run, f"id {id_kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component {id_kind}")


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, how it holds against an edited text and the next document, and its class of near copies."""
    out = edit_robustness(documents(spark, sf_dir))
    return out.withColumnRenamed("id", "doc_id").withColumnRenamed("component", "component_id")


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLE_SQL: dict[str, str] = {}
