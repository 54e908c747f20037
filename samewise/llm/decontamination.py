"""Benchmark passages in documents, with DataFrame functions only.

Windows of an item's size are laid so that a shingle which document and item
share stands at the same place in both (moved inside the document at its
ends). A window and an item are compared if their SimHash fingerprints are
within RADIUS bits: of the blocks of BLOCK_BITS bits one then differs by
RADIUS // blocks bits at most. Items, which are few, are indexed under every
value so near to theirs, windows under their own, so joining on equal values
misses none. The weighted similarity of the shingles themselves decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import documents, fresh, pick
from samewise.llm.sieve import sifted
from samewise.plans.materialize import save

SHINGLE = 5  # words
RADIUS = 22  # of 64 bits; a similarity of 0.8 is a distance of about 10, and may be up to 20
BLOCK_BITS = 8
SIMILARITY = 0.8
WEIGHT_BITS = 20  # of an element that hold the characters of its shingle; the others hold a hash
SMALL_ROWS = 500_000  # rows of two longs that may be sent to every executor
LISTED = 50_000  # hashes of items' shingles that may stand in a plan as a set
SIEVE_BITS = 27  # beyond LISTED: 2 ** SIEVE_BITS bits, 16 MB, tell which shingles can't be an item's


WORDS_SQL = r"filter(split(lower(text), r'[^\p{L}\p{N}]+'), w -> w <> '')"


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingle_hashes(words: Column, k: int) -> Column:
    n = F.size(words)
    one = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column, k: Column) -> Column:
    """Every shingle of k words as text, repeats included."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it is known to be small; df must be a written table, so counting is cheap, or `rows` says how many it has."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= SMALL_ROWS else df


def elements(shingles: Column) -> Column:
    """Shingles as a set of longs: a hash over the shingle and which of its repeats this is, then its characters.

    Two lists share as many repeats of a shingle as both have, so the weighted
    similarity of the lists is one of sets.
    """
    mask = (1 << WEIGHT_BITS) - 1
    hashed = F.transform(shingles, lambda s: F.struct(F.xxhash64(s).alias("h"), F.least(F.length(s), F.lit(mask)).alias("w")))

    def one(x: Column, i: Column, own: Column) -> Column:
        nth = i + 1 - F.array_position(own["hashes"], x["h"])
        return F.xxhash64(x["h"], nth).bitwiseAND(F.lit(~mask)).bitwiseOR(x["w"].cast("long"))

    # array(...) with a lambda over it, or the sorted list would be made anew for each element
    both = lambda own: F.struct(own.alias("list"), F.transform(own, lambda x: x["h"]).alias("hashes"))
    listed = F.transform(F.array(F.array_sort(hashed)), both)
    return F.flatten(F.transform(listed, lambda own: F.transform(own["list"], lambda x, i: one(x, i, own))))


def weight(found: Column) -> Column:
    """The characters of a list of elements."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(F.lit((1 << WEIGHT_BITS) - 1)))


def similarity(a: Column, b: Column, weight_a: Column, weight_b: Column) -> Column:
    """Weighted Jaccard of two shingle lists as multisets, each shingle weighing its characters: from elements() and weight()."""
    both = weight(F.array_intersect(a, b))
    return both / (weight_a + weight_b - both)


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = SIMILARITY,
    radius: int = RADIUS,
) -> DataFrame:
    """(id, own, item_id, start_word, n_words, hamming, similarity): for every document and item the best window, if one is similar enough.

    own is the text's hash, which tells rows apart that share an id; rows that
    repeat id and text give one row. Among equally similar windows the first
    counts. Null and wordless texts and items match nothing. Items of fewer
    than five words are one shingle; documents shorter than an item are one
    window. Rows with a null id are compared like others.
    """
    spark = docs.sparkSession
    size = F.size("words")
    bench = save(
        pick(items, item_id=item_id_col, text=item_text_col)
        .select("item_id", words_of(F.col("text")).alias("words"))
        .where(size > 0)
        .select("item_id", "words", size.alias("n"), F.least(F.lit(SHINGLE), size).alias("k"))
        .select("item_id", F.xxhash64("item_id", "words").alias("item_key"), "n", "k", _shingles(F.col("words"), F.col("k")).alias("shingles"), "words")
        .dropDuplicates(["item_key"]),
        "decontamination-items",
    )
    sizes = sorted(r["k"] for r in bench.select("k").distinct().collect())  # at most five numbers
    texts = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").withColumn("own", F.xxhash64("text"))
    anchor_of = {
        k: save(bench.where(F.col("k") == k).select("n", F.posexplode(_shingle_hashes(F.col("words"), k)).alias("at", "h")).distinct(), "decontamination-anchors")
        for k in sizes
    }
    if sum(a.count() for a in anchor_of.values()) <= LISTED:
        # documents with a shared shingle, found without a row for each shingle
        # (array(words) with a lambda over it, or the optimiser would split the text anew for each shingle)
        tests = []
        for k, a in anchor_of.items():
            listed = ", ".join(f"{r['h']}L" for r in a.select("h").distinct().collect()) or "NULL"
            shingle = ", ".join(f"get(ws, i + {j})" for j in range(k))
            tests.append(f"(size(ws) >= {k} AND exists(sequence(0, size(ws) - {k}), i -> xxhash64({shingle}) IN ({listed})))")
        shared = F.expr(f"exists(array({WORDS_SQL}), ws -> {' OR '.join(tests) or 'false'})")
        texts = save(texts.where(shared), "decontamination-texts")
        listed_all = True
    else:
        listed_all = False
    windows = None
    for k, anchors in anchor_of.items():
        places = texts.select("id", "own", words_of(F.col("text")).alias("words")).select(
            "id", "own", size.alias("n_doc"), F.posexplode(_shingle_hashes(F.col("words"), k)).alias("p", "h")
        )
        if not listed_all:  # what is certainly in no item is never shuffled
            places = sifted(places, F.col("h"), anchors.select("h"), SIEVE_BITS)
        found = (
            places.join(_small(anchors), "h")
            .select("id", "own", F.greatest(F.lit(0), F.least(F.col("p") - F.col("at"), F.col("n_doc") - F.col("n"))).alias("start"), F.least("n", "n_doc").alias("len"), F.col("n").alias("class"), F.lit(k).alias("k"))
            .distinct()
        )
        windows = found if windows is None else windows.unionByName(found)
    result = "id {}, own long, item_id {}, start_word int, n_words int, hamming int, similarity double".format(
        texts.schema["id"].dataType.simpleString(), bench.schema["item_id"].dataType.simpleString()
    )
    if windows is None:
        return spark.createDataFrame([], result)
    per_doc = save(windows.groupBy("id", "own").agg(F.collect_list(F.struct("start", "len", "class", "k")).alias("windows")), "decontamination-windows")
    small = _small(per_doc)
    w, t = small.alias("w"), texts.alias("t")
    laid = (
        t.join(w, F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.own") == F.col("w.own")))
        .select(F.col("t.id").alias("id"), F.col("t.own").alias("own"), words_of(F.col("t.text")).alias("words"), "windows")
        .select("id", "own", "words", F.explode("windows").alias("win"))
        .select("id", "own", "win.*", F.slice("words", F.col("win.start") + 1, F.col("win.len")).alias("part"))
        .select("id", "own", "start", "len", "class", _shingles(F.col("part"), F.least("k", "len")).alias("shingles"))
    )
    laid = save(_fingerprinted(laid), "decontamination-laid")
    known = save(_fingerprinted(bench.select("item_id", "item_key", F.col("n").alias("class"), "shingles")), "decontamination-known")
    near = _near(radius)
    left = laid.select("id", "own", "start", "len", "class", "fp", F.explode(_blocks(F.col("fp"))).alias("b")).select("*", "b.block", "b.value").drop("b")
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << BLOCK_BITS) if m.bit_count() <= near])
    right = (
        known.select("item_id", "item_key", "class", F.col("fp").alias("item_fp"), F.explode(_blocks(F.col("fp"))).alias("b"))
        .select("item_id", "item_key", "class", "item_fp", "b.block", F.explode(F.transform(masks, lambda m: F.col("b.value").bitwiseXOR(m))).alias("value"))
    )
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    # a pair that meets in several blocks counts in the first of them only
    first = F.coalesce(*[F.when(F.expr(f"bit_count(shiftrightunsigned(differ, {i * BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1}L) <= {near}"), F.lit(i)) for i in range(64 // BLOCK_BITS)])
    pairs = (
        left.join(_small(right, known.count() * (64 // BLOCK_BITS) * sum(m.bit_count() <= near for m in range(1 << BLOCK_BITS))), ["class", "block", "value"])
        .withColumn("differ", differ)
        .withColumn("hamming", F.bit_count("differ"))
        .where((F.col("hamming") <= radius) & (F.col("block") == first))
        .select("id", "own", "start", "len", "class", "item_id", "item_key", "hamming")
    )
    lists = laid.select("id", "own", "start", "len", "class", "elements", "weight")
    same = F.col("p.id").eqNullSafe(F.col("l.id"))
    for c in ("own", "start", "len", "class"):
        same = same & (F.col(f"p.{c}") == F.col(f"l.{c}"))
    held = pairs.alias("p").join(lists.alias("l"), same).select("p.*", "l.elements", "l.weight")
    scored = held.join(_small(known.select("item_key", F.col("elements").alias("item_elements"), F.col("weight").alias("item_weight")), known.count()), "item_key")
    scored = scored.withColumn("similarity", similarity(F.col("elements"), F.col("item_elements"), F.col("weight"), F.col("item_weight"))).where(F.col("similarity") >= threshold)
    best = scored.groupBy("id", "own", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "len", "hamming")).alias("b"))
    return best.select(
        "id", "own", "item_id", F.col("b.start").alias("start_word"), F.col("b.len").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"), (-F.col("b.s")).alias("similarity")
    )


def _near(radius: int) -> int:
    """Bits in which the nearest block of two fingerprints within radius differs at most."""
    return radius // (64 // BLOCK_BITS)


def _blocks(fp: Column) -> Column:
    value = lambda i: F.shiftrightunsigned(fp, i * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), value(i).cast("long").alias("value")) for i in range(64 // BLOCK_BITS)])


def _fingerprinted(df: DataFrame) -> DataFrame:
    """df with the fingerprint, the elements and the weight of its shingles in place of them."""
    columns = [c for c in df.columns if c != "shingles"]
    hashed = df.withColumn("hs", F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("h"), F.length(s).alias("w"))))
    total = "aggregate(hs, 0, (acc, x) -> acc + IF((shiftrightunsigned(x.h, b) & 1L) = 1L, x.w, -x.w))"
    fp = F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | IF({total} > 0, shiftleft(1L, b), 0L))")
    return hashed.select(*columns, fp.alias("fp"), elements(F.col("shingles")).alias("elements")).select("*", weight(F.col("elements")).alias("weight"))


def drop_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that hold no passage of items; all columns, clean rows untouched, nulls and repeats too."""
    found = leaks(docs, items, id_col, text_col, **how)
    own, lid, lown = (fresh(docs, c) for c in ("own_hash", "leak_id", "leak_own"))
    bad = _small(save(found.select(F.col("id").alias(lid), F.col("own").alias(lown)).distinct(), "decontamination-found"))
    keyed = docs.withColumn(own, F.xxhash64(F.col(f"`{text_col}`")))
    return keyed.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(lid)) & (F.col(own) == F.col(lown)), "left_anti").drop(own)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item of which it holds a passage."""
    found = leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "start_word", "n_words", F.round("similarity", 9).alias("similarity"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM documents WHERE text IS NOT NULL),
it AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words FROM benchmark WHERE text IS NOT NULL),
i AS (SELECT item_id, words, len(words) AS n, least(5, len(words)) AS k FROM it WHERE len(words) > 0),
ish AS (SELECT item_id, n, k, off, array_to_string(words[off + 1 : off + k], ' ') AS s FROM (SELECT *, unnest(range(0, n - k + 1)) AS off FROM i)),
ks AS (SELECT DISTINCT k FROM i),
dsh AS (SELECT doc_id, len(words) AS n_doc, p, k, array_to_string(words[p + 1 : p + k], ' ') AS s
        FROM (SELECT doc_id, words, k, unnest(range(0, len(words) - k + 1)) AS p FROM d, ks)),
win AS (SELECT DISTINCT doc_id, item_id, ish.k, greatest(0, least(p - off, n_doc - n)) AS start, least(n, n_doc) AS size
        FROM dsh JOIN ish ON dsh.s = ish.s AND dsh.k = ish.k),
ws AS (SELECT doc_id, item_id, start, size, s, count(*) AS c
       FROM (SELECT doc_id, item_id, start, size, win.k,  unnest(range(start, start + size - least(win.k, size) + 1)) AS p FROM win) w
       JOIN dsh USING (doc_id, p, k) GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ish GROUP BY ALL),
low AS (SELECT doc_id, item_id, start, size, sum(least(ws.c, ic.c) * length(s)) AS shared FROM ws JOIN ic USING (item_id, s) GROUP BY ALL),
wsum AS (SELECT doc_id, item_id, start, size, sum(c * length(s)) AS t FROM ws GROUP BY ALL),
isum AS (SELECT item_id, sum(c * length(s)) AS t FROM ic GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, size, shared / (wsum.t + isum.t - shared) AS similarity
        FROM low JOIN wsum USING (doc_id, item_id, start, size) JOIN isum USING (item_id))
SELECT doc_id, item_id, start::INTEGER AS start_word, size::INTEGER AS n_words, round(similarity, 9) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= 0.8) WHERE r = 1
"""

QUERIES = {"op6_decontamination": op6_decontamination}
ORACLE_SQL: dict[str, str] = {"op6_decontamination": OP6_SQL}
