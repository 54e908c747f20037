"""A hidden Markov language model, trained by Baum-Welch over all partitions.

Symbols are the most frequent words, the end, and one for all other words. A
state emits symbols; a word behind the last symbol has its share of it by its
smoothed frequency in the training texts. Counts of words are a table that
grows with the corpus and is joined, never gathered; what every task gets is
bounded: COUNTED words with their counts, and STATES numbers a symbol.
Training cuts long texts into segments; each brings some tokens of both
neighbours along, so the moves over a cut count too.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import documents, pick
from samewise.llm.language import fold
from samewise.plans.materialize import save, shuffle_partitions

STATES = 8
SYMBOLS = 65_535  # frequent words (the end is one); the next number stands for all others
COUNTED = 400_000  # frequent words whose counts every task knows
ROUNDS = 5  # at most
GAIN = 1e-4  # of the log likelihood a token, relative: a round that gains less is the last
SEGMENT = 256  # tokens that a training sequence counts at most; scoring runs over whole texts
LAP = 16  # tokens before and behind a segment that only tell its states
END = b"\n"  # no word has white space
ADD = 0.1
PRIOR = 20.0  # tokens of the training texts' own distribution that each state is given
FLUSH = 300_000  # distinct words that a task counts before it hands them on
CHUNK = 256  # symbols of an emission row


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _word_counts(batches):
    held: Counter = Counter()

    def out():
        b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        held.clear()
        return b

    for b in batches:
        for t in b.column(0).to_pylist():
            held.update(words_of(t))
            held[END] += 1
            if len(held) > FLUSH:
                yield out()
    yield out()


class Lexicon:
    """Ranks and counts of the frequent words, and what the base model needs."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, symbols: int = SYMBOLS):
        self.rank = {w: i for i, w in enumerate(words)}
        self.counts = np.array(counts, dtype=np.float64)
        self.total, self.distinct = total, distinct
        self.bottom = total + ADD * (distinct + 1)  # never 0
        self.symbols = min(symbols, len(words))
        self.log_base = np.log10((self.counts + ADD) / self.bottom)
        # what the base model gives to all words behind the last symbol, one unknown word included
        head = self.counts[: self.symbols]
        self.rare_mass = 1.0 - float((head + ADD).sum()) / self.bottom
        self.start = np.append((head + ADD) / self.bottom, self.rare_mass)


_kept: dict[int, Lexicon] = {}


def _cached(shared) -> Lexicon:
    """One Lexicon a worker for each broadcast."""
    key = shared._bid if hasattr(shared, "_bid") else id(shared.value)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Lexicon(*shared.value)
    return _kept[key]


def _encode(shared):
    """(id, held_out, text) to (part, row, id, held_out, n_tokens, n_known, base, n_rare, symbols, rare)."""

    def run(batches):
        from pyspark import TaskContext

        lex = _cached(shared)
        part, row = TaskContext.get().partitionId(), 0
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for t in b.column(2).to_pylist():
                words = words_of(t)
                words.append(END)
                ranks = [lex.rank.get(w, -1) for w in words]
                r = np.array(ranks, dtype=np.int64)
                known = r[r >= 0]
                symbols = np.where((r < 0) | (r >= lex.symbols), lex.symbols, r).astype("<u2")
                values = (len(words), len(known), float(lex.log_base[known].sum()), float(lex.log_base[known[known >= lex.symbols]].sum()), int((symbols == lex.symbols).sum()), zip_.compress(symbols.tobytes()), [w for w, k in zip(words, ranks, strict=True) if k < 0])
                for to, v in zip(cols, values, strict=True):
                    to.append(v)
            n = b.num_rows
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), b.column(0), b.column(1)] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=["part", "row", "id", "held_out", "n_tokens", "n_known", "base", "rare_base", "n_rare", "symbols", "rare"],
            )
            row += n

    return run


# ---------------------------------------------------------------- the model

def start_model(start: np.ndarray, states: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initial, transition and emission probabilities: sticky states around the base distribution."""
    rng = np.random.default_rng(seed)
    emit = start[:, None] * np.exp(rng.normal(0, 0.7, (len(start), states)))
    stay = 0.9
    trans = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(trans, stay if states > 1 else 1.0)
    return np.full(states, 1 / states), trans, emit / emit.sum(axis=0)


def _padded(seqs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in seqs])
    out = np.full((n.max(), len(seqs)), pad, dtype=np.int64)
    for i, s in enumerate(seqs):
        out[: len(s), i] = s
    return out, n


def forward_scores(seqs: list[np.ndarray], first: np.ndarray, trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 of each sequence's probability: the forward recursion, scaled at every step."""
    out = np.zeros(len(seqs))
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    for lo in range(0, len(order), 512):
        some = order[lo : lo + 512]
        live = [seqs[i] for i in some]
        n = np.array([len(s) for s in live])
        data = np.concatenate(live)
        at = np.concatenate([[0], np.cumsum(n)[:-1]])
        total = np.zeros(len(live))
        alpha = None
        width = len(live)
        for t in range(int(n[0])):
            while n[width - 1] <= t:  # longest first: those that are over are at the end
                width -= 1
            e = emit[data[at[:width] + t]]
            alpha = (first[None, :] if alpha is None else alpha[:width] @ trans) * e
            scale = alpha.sum(axis=1)
            alpha = alpha / scale[:, None]
            total[:width] += np.log10(scale)
        out[some] = total
    return out


def expect(seqs: list[np.ndarray], begins: np.ndarray, first: np.ndarray, trans: np.ndarray, emit: np.ndarray, counts, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> float:
    """Add the expected counts of equally treated sequences; returns the natural log likelihood of what is counted.

    begins tells which start a text. Of each sequence the tokens lo to hi - 1
    count, with the moves to each of them; all of it unless given.
    """
    firsts, moves, emitted = counts
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))  # longest first: at each step the live ones come first
    begins = np.asarray(begins)[order]
    x, n = _padded([seqs[i] for i in order], 0)
    lo = np.zeros(len(n), dtype=np.int64) if lo is None else np.asarray(lo)[order]
    hi = n if hi is None else np.asarray(hi)[order]
    steps, width = x.shape
    states, kind = len(first), emit.dtype
    live = [int(w) for w in (n[None, :] > np.arange(steps)[:, None]).sum(axis=1)]
    on = (np.arange(steps)[:, None] >= lo[None, :]) & (np.arange(steps)[:, None] < hi[None, :])
    e = emit[x]
    alpha = np.zeros((steps, width, states), dtype=kind)
    scale = np.ones((steps, width), dtype=kind)
    for t, w in enumerate(live):
        a = (alpha[t - 1, :w] @ trans if t else np.where(begins[:, None], first[None, :], kind.type(1 / states))) * e[t, :w]
        scale[t, :w] = a.sum(axis=1)
        np.divide(a, scale[t, :w, None], out=alpha[t, :w])
    beta = np.ones((width, states), dtype=kind)
    back = trans.T.copy()
    for t in range(steps - 2, -1, -1):
        w = live[t + 1]
        nxt = e[t + 1, :w] * beta[:w]
        nxt /= scale[t + 1, :w, None]
        counted = on[t + 1, :w]
        moves += trans * (alpha[t, :w].T @ nxt if counted.all() else alpha[t, :w][counted].T @ nxt[counted])
        beta[:w] = nxt @ back
        alpha[t] *= beta  # from here on the state probabilities
    firsts += alpha[0][begins].sum(axis=0)
    ids, g = x[on], alpha[on]
    for k in range(states):
        emitted[:, k] += np.bincount(ids, weights=g[:, k], minlength=len(emitted))
    return float(np.log(scale[on].astype(np.float64)).sum())


def segmented(s: np.ndarray, segment: int = SEGMENT, lap: int = LAP):
    """(tokens, whether they start the text, first and last but one that count) of each segment of a text."""
    for at in range(0, len(s), segment):
        lo, to = max(0, at - lap), min(len(s), at + segment)
        yield s[lo : to + lap], lo == 0, at - lo, to - lo


def _expectation(model, size: int, salts: int):
    """For mapInArrow over compressed symbols: a partition's expected counts, (chunk, salt, sums), a row for each chunk of symbols that occurs."""

    def run(batches):
        from pyspark import TaskContext

        first, trans, emit = (m.astype(np.float32) for m in model.value)
        states = len(first)
        counts = (np.zeros(states), np.zeros((states, states)), np.zeros((size, states)))
        gained = np.zeros((1, states))  # log likelihood, tokens
        unzip = zstandard.ZstdDecompressor()
        parts, held, seen = [], 0, False

        def add():
            parts.sort(key=lambda p: len(p[0]))
            for at in range(0, len(parts), 1024):
                seqs, begins, lo, hi = zip(*parts[at : at + 1024], strict=True)
                gained[0, 0] += expect(list(seqs), np.array(begins), first, trans, emit, counts, np.array(lo), np.array(hi))
                gained[0, 1] += sum(hi) - sum(lo)
            parts.clear()

        for b in batches:
            for raw in b.column(0).to_pylist():
                s = np.frombuffer(unzip.decompress(raw), dtype="<u2")
                parts.extend(segmented(s))
                held += len(s)
                if held > 1 << 20:
                    add()
                    held, seen = 0, True
        if parts:
            add()
        elif not seen:
            return
        head = np.vstack([counts[0][None, :], counts[1], gained])
        chunks = [(-1, head)] + [(at // CHUNK, some) for at in range(0, size, CHUNK) if (some := counts[2][at : at + CHUNK]).any()]
        salt = TaskContext.get().partitionId() % salts
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([salt] * len(chunks), pa.int32()), pa.array([np.ascontiguousarray(v).tobytes() for _, v in chunks], pa.binary())], names=["chunk", "salt", "sums"])

    return run


def _added(batches):
    """For mapInArrow over (chunk, salt, sums) in order of the first two: a row for each of them, added one by one."""
    held, total = None, None
    done: list[tuple] = []

    def rows():
        b = pa.RecordBatch.from_arrays([pa.array([d[0][0] for d in done], pa.int32()), pa.array([d[0][1] for d in done], pa.int32()), pa.array([d[1].tobytes() for d in done], pa.binary())], names=["chunk", "salt", "sums"])
        done.clear()
        return b

    for b in batches:
        for chunk, salt, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
            some = np.frombuffer(raw, dtype=np.float64)
            if (chunk, salt) == held:
                total += some
            else:
                if held is not None:
                    done.append((held, total))
                held, total = (chunk, salt), some.copy()
        if len(done) > 100:
            yield rows()
    if held is not None:
        done.append((held, total))
    yield rows()


SUMS = "chunk int, salt int, sums binary"


def _summed(partial: DataFrame, salts: int) -> list:
    """A row for each chunk: its sums over all tasks, by way of `salts` sums each where tasks are many."""
    n = shuffle_partitions(partial.sparkSession)
    for _ in range(2 if salts > 1 else 1):
        partial = partial.repartition(n, "chunk", "salt").sortWithinPartitions("chunk", "salt").mapInArrow(_added, SUMS).withColumn("salt", F.lit(0))
    return partial.collect()


def train(encoded: DataFrame, start: np.ndarray, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN):
    """Baum-Welch over all training rows of `encoded`, until a round gains too little; each is one pass, its counts summed by chunks of symbols."""
    spark = encoded.sparkSession
    model = start_model(start, states)
    rows = encoded.where(~F.col("held_out")).select("symbols")
    tasks = rows.rdd.getNumPartitions()
    salts = math.isqrt(tasks) if tasks > 64 else 1
    before = None
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)  # bounded by SYMBOLS * STATES numbers
        got = _summed(rows.mapInArrow(_expectation(shared, len(start), salts), SUMS), salts)
        shared.unpersist()
        if not got:
            break
        by = {r["chunk"]: np.frombuffer(r["sums"], dtype=np.float64).reshape(-1, states) for r in got}
        head = by.pop(-1)
        emitted = PRIOR * start[:, None] + np.zeros((1, states))
        for k, some in by.items():
            emitted[k * CHUNK : k * CHUNK + len(some)] += some
        first, trans = head[0] + 1, head[1 : states + 1] + 1
        model = (first / first.sum(), trans / trans.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))
        likely = head[-1, 0] / max(1.0, head[-1, 1])
        if before is not None and likely - before < gain * abs(before):
            break
        before = likely
    return model


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word, c) of the most frequent words, no more than `most`: all from the least count on that leaves no more.

    Counts are put in classes a sixteenth of a doubling wide, so that what
    the driver gets is a row for each class; the end always stands among them.
    """
    kind = F.floor(F.log2(F.col("c")) * 16).cast("int")
    sizes = sorted(((r["k"], r["n"]) for r in counts.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for k, n in sizes:
        if held + n > most:
            break
        least, held = k, held + n
    end = F.col("word") == F.lit(bytearray(END))
    return counts.where(end if least is None else end | (kind >= least))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, states: int = STATES, rounds: int = ROUNDS, symbols: int = SYMBOLS, counted: int = COUNTED) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose crc32(id) mod folds is 0 are held out; null ids are held out
    too. Null and empty texts are an end alone. Repeated rows count as often
    as they come. With no training text at all every word is unknown. An empty
    table gives an empty table. score is the exact log10 probability under the
    model; words that no training text has share one word's probability, as in
    the base score.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select("id", (fold(F.col("id"), folds) == 0).alias("held_out"), "text")
    counts = save(rows.where(~F.col("held_out")).select("text").mapInArrow(_word_counts, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "hmm-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).head()
    top = frequent(counts, counted).toArrow()  # bounded by counted
    ranked = sorted(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True), key=lambda x: (x[0] != END, -x[1], x[0]))
    parts = ([w for w, _ in ranked], [c for _, c in ranked], int(sums["n"]), int(sums["v"]), symbols)
    lex = Lexicon(*parts)
    shared = spark.sparkContext.broadcast(parts)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"part int, row long, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, rare_base double, n_rare long, symbols binary, rare array<binary>"
    encoded = save(rows.mapInArrow(_encode(shared), schema), "hmm-encoded")
    model = spark.sparkContext.broadcast(train(encoded, lex.start, states, rounds))

    names = ["part", "row", "id", "held_out", "n_tokens", "n_known", "base", "rare_base", "n_rare"]

    def scored(batches):
        first, trans, emit = model.value
        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            seqs = [np.frombuffer(unzip.decompress(x), dtype="<u2") for x in b.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(forward_scores(seqs, first, trans, emit))], names=names + ["latent"])

    whole = encoded.select(*names, "symbols").mapInArrow(scored, f"part int, row long, id {id_type}, held_out boolean, n_tokens long, n_known long, base double, rare_base double, n_rare long, latent double")
    # words that aren't among the COUNTED are looked up by a join
    p = F.log10((F.coalesce("c", F.lit(0)) + ADD) / F.lit(lex.bottom))
    rare = encoded.select("part", "row", F.explode("rare").alias("word")).groupBy("part", "row", "word").agg(F.count("*").alias("times"))
    tail = rare.join(counts, "word", "left").groupBy("part", "row").agg(F.sum(p * F.col("times")).alias("tail_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("tail_known"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    mass = math.log10(lex.rare_mass) if lex.rare_mass > 0 else 0.0
    return whole.join(tail, ["part", "row"], "left").select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("tail_known")).cast("long").alias("n_known"),
        F.lit(int(sums["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + zero("tail_base")).alias("base_score"),
        (F.col("latent") + F.col("rare_base") + zero("tail_base") - F.col("n_rare") * mass).alias("score"),
    )


def op5_lm_scores(spark, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the model and under smoothed word frequencies."""
    return score_texts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_lm_scores": op5_lm_scores}
ORACLE_SQL: dict[str, str] = {}
