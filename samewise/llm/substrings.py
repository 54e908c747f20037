"""Removal of repeated passages by content-defined chunks.

Texts are cut where a gear rolling hash over the last 16 bytes falls under a
threshold, so a cut depends on its neighbourhood only and an insertion moves
no cut but those beside it. Chunks are known by a 128-bit digest; of equal
chunks the first, by id and place, stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.columns import documents, fresh, pick

WINDOW = 16  # bytes that a cut depends on: the hash has as many bits and is shifted by one a byte
WORD_CUTS = 5  # one in so many word ends is a cut
INNER_CUTS = 256  # one in so many other characters, for texts without white space
LONGEST = 2048  # bytes of a chunk at most
BLOCK = 4 << 20  # bytes of text that are cut and compared at once in a task
MIN_WORDS = 12  # repeated chunks in a row make up a passage from so many words on
LONG_WORD = 24  # characters from which on what stands between white space counts as several words
WORD_CHARS = 6  # characters of each of them

GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 16 bits, by doubling the window."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint16(width) if len(h) > width else h[:0]
        h, width = more, 2 * width
    return h


def cuts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the ends of its chunks, in bytes; none for an empty one."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + WINDOW)])[:-1] + WINDOW
    data = np.frombuffer(b"".join(x for t in texts for x in (bytes(WINDOW), t)) + bytes(1), dtype=np.uint8)
    h = gear_hash(data[:-1])
    space = SPACE[data[:-1]]
    ends_word = space & ~SPACE[data[1:]]
    whole_char = (data[1:] & 0xC0) != 0x80
    at = np.flatnonzero((ends_word & (h < 65536 // WORD_CUTS)) | (~space & whole_char & (h < 65536 // INNER_CUTS))) + 1
    lo, hi = np.searchsorted(at, starts, "right"), np.searchsorted(at, starts + sizes, "left")
    out = []
    for i, n in enumerate(sizes.tolist()):
        own = np.append(at[lo[i] : hi[i]] - starts[i], n) if n else np.zeros(0, dtype=np.int64)
        if n and (np.diff(own, prepend=0) > LONGEST).any():
            own = _limited(own, texts[i])
        out.append(own)
    return out


def _limited(ends: np.ndarray, text: bytes) -> np.ndarray:
    """Cut chunks over LONGEST bytes at the character before that length."""
    out, last = [], 0
    for end in ends.tolist():
        while end - last > LONGEST:
            last += LONGEST
            while text[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        out.append(end)
        last = end
    return np.array(out, dtype=np.int64)


def _chunk_rows(ids: list, texts: list[bytes], id_type: pa.DataType) -> pa.RecordBatch:
    """All chunks of a block of texts: digest (two longs), id, text's own hash, place (start << 12 | length), and whether the block has an earlier one."""
    hashes = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype=np.uint64).view(np.int64).tolist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, hashes[i]))
    # repeated rows are one document
    order = [i for k, i in enumerate(order) if not k or (ids[i], hashes[i]) != (ids[order[k - 1]], hashes[order[k - 1]])]
    some = [texts[i] for i in order]
    ends = cuts(some)
    counts = np.fromiter(map(len, ends), dtype=np.int64, count=len(ends))
    rank = np.repeat(np.arange(len(some)), counts)
    digest = xxhash.xxh3_128_digest
    raw = b"".join(digest(t[a:b]) for t, own in zip(some, ends, strict=True) for a, b in zip([0, *own[:-1].tolist()], own.tolist(), strict=True))
    d = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    end = np.concatenate(ends) if ends else np.zeros(0, dtype=np.int64)
    start = np.concatenate([np.concatenate([[0], own[:-1]]) for own in ends if len(own)]) if len(end) else end
    # rows are in (rank, start) order already; a stable sort keeps it within a digest
    by = np.lexsort((d[:, 1], d[:, 0]))
    again = np.zeros(len(d), dtype=bool)
    if len(d):
        same = (d[by[1:]] == d[by[:-1]]).all(axis=1)
        again[by[1:]] = same
    # what is known to be a repeat is dealt out by place, not by its digest, so a frequent passage never piles up
    key = np.where(again, d[:, 0] ^ (rank * 0x9E3779B97F4A7C1 + end * 0x5851F42D4C957F2D), d[:, 0])
    id_arr = pa.array([ids[i] for i in order], type=id_type).take(pa.array(rank))
    own_hash = np.array([hashes[i] for i in order], dtype=np.int64)[rank]
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(d[:, 1]), id_arr, pa.array(own_hash), pa.array((start.astype(np.int64) << 12) | (end - start)), pa.array(again)],
        names=["d1", "d2", "id", "own", "place", "again"],
    )


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, own, place): the chunks that an earlier document, or an earlier place of the same one, has too.

    Each task first compares the chunks of its own blocks, so that of a chunk
    which a third of all documents share one row a block is shuffled.
    """
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches):
        ids, texts, held = [], [], 0
        for b in batches:
            kind = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t:
                    ids.append(i)
                    texts.append(t.encode())
                    held += len(texts[-1])
                if held > BLOCK:
                    yield from _sliced(_chunk_rows(ids, texts, kind))
                    ids, texts, held = [], [], 0
        if texts:
            yield from _sliced(_chunk_rows(ids, texts, kind))

    id_type = rows.schema["id"].dataType.simpleString()
    chunks = rows.mapInArrow(run, f"d1 long, d2 long, id {id_type}, own long, place long, again boolean")
    first = Window.partitionBy("d1", "d2").orderBy(F.col("id").asc_nulls_last(), "own", "place")
    return chunks.withColumn("n", F.rank().over(first)).where("again OR n > 1").select("id", "own", "place")


def _sliced(batch: pa.RecordBatch, rows: int = 50_000):
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def n_words(text: bytes) -> int:
    """Words between white space; what has LONG_WORD characters or more, as in scripts without white space, counts one word for each WORD_CHARS."""
    words = text.split()
    count = len(words)
    for w in words:
        if len(w) >= LONG_WORD:
            chars = sum(b & 0xC0 != 0x80 for b in w)
            if chars >= LONG_WORD:
                count += chars // WORD_CHARS - 1
    return count


def passages(text: bytes, places: list[int], min_words: int) -> list[tuple[int, int]]:
    """Runs of touching chunks with at least min_words words, as byte spans."""
    runs: list[list[int]] = []
    for p in sorted(set(places)):
        start, size = p >> 12, p & 0xFFF
        if runs and runs[-1][1] == start:
            runs[-1][1] = start + size
        else:
            runs.append([start, start + size])
    return [(a, b) for a, b in runs if n_words(text[a:b]) >= min_words]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs, with the texts rid of passages that stand earlier, and `spans`.

    Earlier means in a document of smaller id (nulls last), or before in the
    same one. spans: array of structs (start, end) in code points of the old
    text; the column is named _spans and so on if docs has one. Null texts
    stay null, empty ones empty; both have no spans. Rows that repeat id and
    text are one document and get the same result; rows that only share the
    id are told apart by their texts. An empty table gives an empty table.
    """
    text, key = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    per_doc = repeated_chunks(docs, id_col, text_col).groupBy("id", "own").agg(F.collect_list("place").alias("places"))
    own, places, made, spans = (fresh(docs, c) for c in ("own_hash", "places", "cut", "spans"))
    kid, own_r = fresh(docs, "repeat_id"), fresh(docs, "repeat_own")
    per_doc = per_doc.select(F.col("id").alias(kid), F.col("own").alias(own_r), F.col("places").alias(places))

    @F.pandas_udf("long")
    def text_hash(t):
        return t.map(lambda x: np.uint64(xxhash.xxh64_intdigest((x or "").encode())).astype(np.int64))

    @F.pandas_udf("struct<text: string, starts: array<long>, ends: array<long>>")
    def cut(t, p):
        import pandas as pd

        out = []
        for x, places in zip(t, p, strict=True):
            if x is None or places is None or not len(places):
                out.append((x, [], []))
                continue
            raw = x.encode()
            runs = passages(raw, [int(v) for v in places], min_words)
            kept, at, chars, starts, ends = [], 0, 0, [], []
            for a, b in runs:
                kept.append(raw[at:a])
                chars += len(kept[-1].decode())
                starts.append(chars)
                chars += len(raw[a:b].decode())
                ends.append(chars)
                at = b
            out.append(((b"".join(kept) + raw[at:]).decode(), starts, ends))
        return pd.DataFrame(out, columns=["text", "starts", "ends"])

    # once a row: a condition on the result, pushed below it, would have each text cut twice, by two Python workers a task
    cut = cut.asNondeterministic()
    joined = docs.withColumn(own, text_hash(text)).join(per_doc, key.eqNullSafe(F.col(kid)) & (F.col(own) == F.col(own_r)), "left")
    # texts without repeats are not sent to Python
    done = joined.withColumn(made, cut(F.when(F.col(places).isNotNull(), text), F.col(places)))
    columns = [
        F.coalesce(F.col(f"{made}.text"), text).alias(c) if c == text_col else F.col(f"`{c}`")
        for c in docs.columns
    ]
    zipped = F.zip_with(f"{made}.starts", f"{made}.ends", lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return done.select(*columns, F.coalesce(zipped, none).alias(spans))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's repeated passages and a digest of the text that is left."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    out = remove_repeats(docs)
    return out.select(
        "doc_id",
        "n_chars",
        F.length("text").cast("long").alias("kept_chars"),
        F.size("spans").cast("long").alias("n_spans"),
        F.transform("spans", lambda s: s["start"]).alias("span_starts"),
        F.transform("spans", lambda s: s["end"]).alias("span_ends"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
