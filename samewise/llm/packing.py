"""Mixture-controlled packing by deficit round-robin over source queues.

The documents of a source form a queue. Each window of `size` tokens gives
every source a quantum, its share of all tokens; a source is served from its
queue as long as its deficit allows, and what it is owed or has had too much
goes on to the next window. The shares are those asked for, or else the
sources' own; a source that has run dry leaves its share to the others, so
every document is packed. The queues are cut where that plan stands after
equal numbers of tokens, into blocks that are packed side by side: a block
starts with the deficits that the plan leaves there, and on the global grid of
windows where the block before ends.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.columns import documents, pick
from samewise.llm.tokens import ByteEncoder, byte_encoder, token_rows, unsqueeze
from samewise.plans.materialize import save

SIZE = 2048
BLOCK_TOKENS = 1 << 22  # of a block at least
BLOCKS = 100_000  # at most
LEAST = 256  # tokens that a source is served at once, unless its document or the window ends


class Grid:
    """Sequences over the global token positions: windows, then the rest in powers of two, so nothing is padded."""

    def __init__(self, total: int, size: int):
        self.size, self.full = size, total // size
        self.tail = []
        at, rest = self.full * size, total % size
        for k, bit in enumerate(b for b in reversed(range(size.bit_length())) if rest >> b & 1):
            self.tail.append((at, at + (1 << bit), self.full + k))
            at += 1 << bit

    def at(self, g: int) -> tuple[int, int, int]:
        """(sequence, offset, tokens to its end)."""
        if g < self.full * self.size:
            return g // self.size, g % self.size, self.size - g % self.size
        for lo, hi, seq in self.tail:
            if lo <= g < hi:
                return seq, g - lo, hi - g
        raise IndexError(g)


def serve(queues: list[list[tuple[int, int]]], deficits: list[float], shares: list[float], start: int, grid: Grid) -> list[tuple[int, int, int, int, int]]:
    """Deficit round-robin: queues of (document, tokens) to pieces (document, start, length, sequence, offset)."""
    out = []
    heads, done = [0] * len(queues), [0] * len(queues)
    deficits = list(deficits)
    left = sum(n for q in queues for _, n in q)
    g, turn = start, 0
    order = list(range(len(queues)))
    while left:
        seq, off, room = grid.at(g)
        room = min(room, left)
        # what has run dry leaves its share to the others
        order = [s for s in order if heads[s] < len(queues[s])]
        due = sum(shares[s] for s in order) or 1.0
        for s in order:
            deficits[s] += room * shares[s] / due
        while room:
            best = None
            at = bisect_left(order, turn)
            for s in (*order[at:], *order[:at]):
                if heads[s] < len(queues[s]) and deficits[s] >= min(LEAST, queues[s][heads[s]][1] - done[s], room):
                    best = s
                    break
            if best is None:  # none is owed enough: the one that is owed most
                best = max((s for s in order if heads[s] < len(queues[s])), key=lambda s: (deficits[s], -s))
            doc, n = queues[best][heads[best]]
            take = min(room, n - done[best], max(LEAST, int(deficits[best])))
            out.append((doc, done[best], take, seq, off))
            deficits[best] -= take
            done[best] += take
            if done[best] == n:
                heads[best], done[best] = heads[best] + 1, 0
            turn = best + 1
            g, off, room, left = g + take, off + take, room - take, left - take
    return out


def plan(sizes: dict[str | None, int], shares: dict[str, float]) -> list[tuple[str | None, int, int, float, float, float]]:
    """How sources with shares run down: (source, from, to, at, per, share) for each stretch between two of them running dry.

    sizes: tokens of the sources with a share and, under None, of all others
    together, which have what is left of 1. From its token `from` to `to` a
    source is served at the global token at + (q - from) * per, at `share` of
    all tokens.
    """
    named = {k: float(v) for k, v in shares.items()}
    if any(v < 0 for v in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError("shares are 0 or more and add up to 1 at most")
    named[None] = max(0.0, 1.0 - sum(named.values()))
    left = {k: n for k, n in sizes.items() if n}
    out, at = [], 0.0
    while left:
        due = {k: named.get(k, 0.0) for k in left}
        if not sum(due.values()):  # only sources of no share are left: in their own proportions
            due = {k: float(n) for k, n in left.items()}
        total = sum(due.values())
        due = {k: v / total for k, v in due.items() if v}
        span = min(left[k] / v for k, v in due.items())
        for k, v in due.items():
            took = min(left[k], round(span * v)) if left[k] / v > span * (1 + 1e-12) else left[k]
            lo = sizes[k] - left[k]
            out.append((k, lo, lo + took, at, span / max(1, took), v))
            left[k] -= took
        left = {k: n for k, n in left.items() if n}
        at += span
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: int = SIZE, encoder: ByteEncoder | None = None, with_ids: bool = True, shares: dict[str, float] | None = None) -> DataFrame:
    """(id, source, start, length, doc_tokens, sequence_id, offset, ids_crc32[, ids]): one row for each piece.

    A null text is empty: only the end id. A null source is a source of its
    own. Rows with null or repeated ids are documents like others. ids is
    binary, little-endian unsigned 16-bit. An empty table gives no pieces. A
    document of any length is cut over as many sequences as it needs; there is
    no padding, as the tokens after the last full sequence fill sequences of
    powers of two.

    shares: the proportions of tokens that sources are to have in each
    sequence. Sources without one have what is left of 1, in their own
    proportions; a source of share 0 comes when all others have run dry. Where
    a source has run dry the rest go on in theirs, so no document is left out.
    Without shares every source has its own proportion throughout.
    """
    rows = pick(docs, id=id_col, source=source_col, text=text_col).withColumn("source", F.col("source").cast("string"))
    id_type = rows.schema["id"].dataType.simpleString()
    tokens = save(rows.mapInArrow(token_rows(encoder or byte_encoder()), f"part int, row long, id {id_type}, source string, n long, ids binary"), "packing-tokens")
    lengths = tokens.select("part", "row", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("queue"), "n")
    # a document's place in its queue: the tokens of the parts before, and those before it in its part
    per_part = lengths.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy("queue")).alias("queue_tokens"))
    inside = Window.partitionBy("part", "queue").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]
    blocks = int(min(BLOCKS, max(1, total // BLOCK_TOKENS)))
    placed = lengths.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, ["queue", "part"]).withColumn("q", F.col("base") + F.col("inside"))
    own_share = F.col("queue_tokens") / F.lit(max(1, total))
    if shares is None:
        planned = placed.withColumn("block", F.floor(F.col("q").cast("decimal(38,0)") * blocks / F.col("queue_tokens")).cast("long")).withColumns({"start_q": F.col("block") * F.col("queue_tokens") / blocks, "share": own_share})
    else:
        planned = _planned(placed, per_part, {f"={k}": v for k, v in shares.items()}, total, blocks)
    queued = save(planned.select("block", "queue", "part", "row", "q", "n", "start_q", "share"), "packing-queues")
    # at most BLOCKS rows
    starts = queued.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_start"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["queue", "q"], kind="stable").reset_index(drop=True)
        queues, deficits, due = [], [], []
        for _, own in pdf.groupby("queue", sort=True):
            queues.append(list(zip(own.index.tolist(), own.n.tolist(), strict=True)))
            deficits.append(own.start_q.iloc[0] - int(own.q.iloc[0]))
            due.append(own.share.iloc[0])
        got = serve(queues, deficits, due, int(pdf.block_start.iloc[0]), Grid(total, size))
        cols = np.array(got, dtype=np.int64).reshape(-1, 5)
        return pd.DataFrame({"part": pdf.part.to_numpy()[cols[:, 0]], "row": pdf.row.to_numpy()[cols[:, 0]], "start": cols[:, 1], "length": cols[:, 2], "sequence_id": cols[:, 3], "offset": cols[:, 4]})

    pieces = queued.join(starts, "block").groupBy("block").applyInPandas(block, "part int, row long, start long, length long, sequence_id long, offset long")
    per_doc = pieces.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    def cut(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            which, crc, parts = [], [], []
            ids_of = cols["ids"].to_pylist()
            lists = cols["pieces"].to_pylist()
            for i, (raw, own) in enumerate(zip(ids_of, lists, strict=True)):
                ids = unsqueeze(raw)
                for p in own:
                    some = ids[p["start"] : p["start"] + p["length"]]
                    which.append(i)
                    crc.append(zlib.crc32(some.astype("<u4").tobytes()))
                    if with_ids:
                        parts.append(some.tobytes())
            flat = [p for own in lists for p in own]
            out = [cols["id"].take(pa.array(which, pa.int64())), cols["source"].take(pa.array(which, pa.int64()))]
            out += [pa.array([p[k] for p in flat], pa.int64()) for k in ("start", "length")]
            out += [cols["n"].take(pa.array(which, pa.int64()))]
            out += [pa.array([p[k] for p in flat], pa.int64()) for k in ("sequence_id", "offset")]
            out += [pa.array(crc, pa.int64())] + ([pa.array(parts, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays(out, names=NAMES + (["ids"] if with_ids else []))

    schema = f"id {id_type}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return tokens.select("part", "row", "id", "source", "n", "ids").join(per_doc, ["part", "row"]).select("id", "source", "n", "ids", "pieces").mapInArrow(cut, schema)


def _planned(placed: DataFrame, per_part: DataFrame, shares: dict[str, float], total: int, blocks: int) -> DataFrame:
    """placed with the block of each document by plan(), where the plan stands in its queue at the block's start, and its share there."""
    spark = placed.sparkSession
    group = F.when(F.col("queue").isin(*shares), F.col("queue")) if shares else F.lit(None).cast("string")
    # a row for each source with a share, one for all others
    sizes = {r["group"]: r["n"] for r in per_part.groupBy(group.alias("group")).agg(F.sum("n").alias("n")).collect()}
    stretches = spark.createDataFrame([(k, sizes[k], float(lo), float(hi), at, per, share) for k, lo, hi, at, per, share in plan(sizes, shares)], "of string, size long, lo double, hi double, at double, per double, share double")
    scale = F.col("queue_tokens") / F.col("size")  # of a queue among the others of its group
    out = placed.withColumn("group", group).join(F.broadcast(stretches), F.col("group").eqNullSafe(F.col("of")) & (F.col("q") / scale >= F.col("lo")) & (F.col("q") / scale < F.col("hi")))
    at = F.col("at") + (F.col("q") / scale - F.col("lo")) * F.col("per")
    out = out.withColumn("block", F.least(F.lit(blocks - 1), F.floor(at * blocks / F.lit(total))).cast("long"))
    # the plan's token of this queue at the block's start, in the stretch that the block's first document lies in
    start = (F.col("lo") + (F.col("block") * F.lit(total / blocks) - F.col("at")) / F.col("per")) * scale
    return out.withColumn("start_q", F.greatest(F.col("lo") * scale, start)).withColumn("share", F.col("share") * F.when(F.col("group").isNull(), scale).otherwise(F.lit(1.0)))


NAMES = ["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32"]


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from pack(with_ids=True)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(p, cast('' as binary), (acc, x) -> acc || x.ids)")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ordered.alias("p")).select("sequence_id", "n_tokens", joined.alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document in sequences of 2048 tokens, sources in their natural shares."""
    out = pack(documents(spark, sf_dir), with_ids=False)
    return out.withColumnRenamed("id", "doc_id")


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
