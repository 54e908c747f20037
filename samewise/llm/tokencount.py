"""Exact token counts; huge documents are encoded in overlapping chunks.

The vocabulary drops white space: no token spans it and what stands on one
side has no bearing on the tokens of the other. So two chunks that overlap can
be spliced at white space inside the overlap, once both give the same tokens
around it; where they don't, or there is none, the overlap is widened.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import documents, pick
from samewise.llm.tokens import library, vocabulary

HUGE = 1 << 16  # characters from which on a text is cut
CHUNK = 1 << 15
OVERLAP = 256
LIMIT = 2048
MEMO = 200_000  # words whose counts a worker keeps
SPACES = " \t\n\r\x0b\x0c"


def _spans(path: str, text: str, at: int) -> list[tuple[int, int, int]]:
    """(id, start, end) of the tokens, in characters of the whole document."""
    e = library(path).encode(text, add_special_tokens=False)
    return [(i, at + a, at + b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def splice_point(text: str, left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], lo: int, hi: int) -> int | None:
    """A white space in text[lo:hi] where both encodings break and agree.

    Agree: from the first white space of the overlap, where the right chunk has
    recovered from its cut, to the splice, both give the same tokens.
    """
    first = next((p for p in range(lo, hi) if text[p] in SPACES), None)
    last = next((p for p in range(hi - 1, lo - 1, -1) if text[p] in SPACES), None)
    if first is None or first == last:
        return None
    if any(a < p < b for p in (first, last) for side in (left, right) for _, a, b in side):
        return None
    inside = lambda side: [x for x in side if x[1] >= first and x[2] <= last]
    return last if inside(left) == inside(right) else None


def encode_huge(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """Yield the (id, start, end) runs of text, chunk by chunk."""
    start = 0
    size, lap = chunk, overlap
    while True:
        end = min(len(text), start + size)
        left = _spans(path, text[start:end], start)
        if end == len(text):
            yield left
            return
        # the next chunk begins inside this one
        lo = max(start, end - lap)
        right = _spans(path, text[lo : min(len(text), end + lap)], lo)
        cut = splice_point(text, left, right, lo, end)
        if cut is None or cut <= start:
            lap = min(2 * lap, end - start)
            if lap == end - start:  # the overlap is the whole chunk: take a larger one
                size = 2 * size
            continue
        yield [x for x in left if x[2] <= cut]
        start, size, lap = cut, chunk, overlap


class Counter:
    """Tokens of a text as the library counts them."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.path, self.huge, self.chunk, self.overlap = path, huge, chunk, overlap
        self.memo: dict[bytes, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        """For texts that aren't huge, each distinct word is encoded once: the words between white space are independent."""
        words = [t.encode().split() if len(t) < self.huge else None for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({w for own in words if own is not None for w in own if w not in self.memo})
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            for w, e in zip(some, library(self.path).encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                self.memo[w] = len(e)
        get = self.memo.__getitem__
        return [sum(map(get, own)) if own is not None else sum(map(len, encode_huge(self.path, t, self.chunk, self.overlap))) for t, own in zip(texts, words, strict=True)]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **how) -> DataFrame:
    """(id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text.

    path: a tokenizers file whose vocabulary drops white space. Null and empty
    texts have none of both. Every row counts for itself, repeats and null ids
    too; an empty table gives an empty table. Special strings inside a text
    are special tokens, the library's default.
    """
    rows = pick(docs, id=id_col, text=text_col)
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches):
        counter = Counter(path, **how)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                some = b.slice(lo, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                sizes = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(counter(texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    out = count_tokens(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE_SQL: dict[str, str] = {}
