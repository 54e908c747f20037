"""Language by compression: the dictionary under which a text gets shortest names it."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.columns import bound_batches, documents, pick

LEVEL = 3
DICT_BYTES = 128 << 10  # text of a language that its dictionary holds, at most
ALL_BYTES = 64 << 20  # of all dictionaries together: where languages are many, each has less
SAMPLE_DOCS = 200  # labelled texts of a language that are looked at for it, about
SAMPLE_BYTES = 16 << 10  # of a longer text a slice of at most so many bytes goes into a dictionary, for variety
NARROW = 0.02  # of the winner's size: closer seconds make a prediction doubtful
SHARP = 0.5  # bits of confidence a byte saved
MAYBE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """A letter by Unicode's categories; MAYBE takes number signs such as a half or a circled one, too."""
    return any(m.group().isalpha() for m in MAYBE.finditer(text))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of labelled texts, chosen by a hash of id and text.

    Of texts over SAMPLE_BYTES a slice is taken, at a place chosen by the same
    hash. Null texts and languages are left out; every other language with a
    text that isn't empty is learned. The driver gets what the dictionaries hold.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).where("text IS NOT NULL AND lang IS NOT NULL AND length(text) > 0").withColumn("size", F.octet_length("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))  # a row for each language
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40))
    width = SAMPLE_BYTES // 4  # characters of up to four bytes
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - width + 1)).cast("int") + 1
    part = F.when(F.col("size") <= SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", at, F.lit(width)))
    share = F.least(F.lit(1.0), SAMPLE_DOCS / F.col("n"))
    chosen = rows.withColumn("h", chance).join(F.broadcast(counts), "lang").where(F.col("h") < share * float(1 << 40)).select("lang", "h", part.alias("text"))
    # about SAMPLE_DOCS rows of a language; what its dictionary has no room for stays behind
    before = Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1)
    fits = chosen.withColumn("before", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0))).where(F.col("before") < dict_bytes)
    by: dict[str, list] = {}
    for r in fits.select("lang", "h", "text").toArrow().to_pylist():
        by.setdefault(r["lang"], []).append((r["h"], r["text"]))
    room = min(dict_bytes, max(256, ALL_BYTES // max(1, len(by))))
    return {k: b"\n".join(t.encode() for _, t in sorted(own))[:room] for k, own in sorted(by.items())}


@lru_cache(maxsize=2)
def _compressors(dicts: tuple[tuple[str, bytes], ...]):
    out = []
    for name, raw in dicts:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append((name, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, compressors) -> tuple[str, float, bool]:
    """(language, score, accepted). Of equal sizes the first name wins."""
    if not text or not compressors or not has_letter(text):
        return "und", 0.0, False
    raw = text.encode()
    sizes = [(len(c.compress(raw)), name) for name, c in compressors]
    best = min(sizes)
    score = 1 / sum(2.0 ** (-SHARP * min(s - best[0], 2000)) for s, _ in sizes)
    second = min((s for s, n in sizes if n != best[1]), default=2 * best[0])
    return best[1], score, (second - best[0]) >= NARROW * best[0]


def identify(docs: DataFrame, dicts: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) for every row; whole texts.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and
    if no language was learned. accepted is false where the margin to the
    second language is narrow, and for `und`. Repeated rows and null ids each
    get their row; an empty table gives an empty table.
    """
    rows = pick(docs, id=id_col, text=text_col)
    bound_batches(docs)
    learned = tuple(sorted(dicts.items()))  # ALL_BYTES at most

    def run(batches):
        compressors = _compressors(learned)
        for b in batches:
            got = [classify(t, compressors) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array(np.array([g[1] for g in got], dtype=float)), pa.array([g[2] for g in got], pa.bool_())], names=["id", "lang_pred", "score", "accepted"]
            )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; four folds of five are learned from."""
    docs = documents(spark, sf_dir)
    dicts = learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs, dicts)
    return out.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
