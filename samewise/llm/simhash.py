"""SimHash near-duplicate classes through deletion-variant signatures.

A fingerprint has 64 bits a lane. To find all pairs within `radius` bits it is
cut into floor(radius/2)+1 segments: some segment then differs by one bit at
most. Each segment is indexed exactly and once for each of its bits with that
bit wiped out; equal index entries are compared over the whole fingerprint.
The index is equality on a key only, so it shuffles by that key once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import documents, fresh, pick
from samewise.llm.meeting import forests, spanning_links
from samewise.llm.sieve import parted, sifted
from samewise.operators.graph import connected_components
from samewise.plans.materialize import discard, save, shuffle_partitions

BLOCK = 1 << 17  # hashes summed at once, so a text of any length needs bounded memory
GROUP = 1024  # rows of one index entry compared in memory; larger entries are indexed again by the other bits
OPEN = 10  # bits that an entry of the last level leaves open at most, so it has 2 ** OPEN distinct fingerprints at most


# ---------------------------------------------------------------- fingerprints

def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every k-word shingle, repeats included, in blocks."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < k:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=">u8")
        return
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(words) - k + 1, BLOCK):
        part = words[i : i + BLOCK + k - 1]
        yield np.array([digest(s, 42) for s in map(b" ".join, zip(*(part[j:] for j in range(k)), strict=False))], dtype=">u8")


def majority(blocks: Iterator[np.ndarray]) -> int:
    """The 64 bits that are set in over half the hashes; 0 without hashes."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big") if n else 0


def word_lanes(text: bytes, lanes: int) -> list[int]:
    """Fingerprints over the distinct words, each weighted by its length in bytes up to 12.

    One edited word changes one feature, where it changes k shingles; so near
    copies stay within a radius that an index can serve.
    """
    words = list(set(text.lower().split()))
    if not words:
        return [0] * lanes
    out = []
    for lane in range(lanes):
        score = np.zeros(64)
        for i in range(0, len(words), BLOCK):
            part = words[i : i + BLOCK]
            h = np.array([xxhash.xxh64_intdigest(w, 42 + lane) for w in part], dtype=">u8")
            weight = np.minimum(np.fromiter(map(len, part), dtype=np.float64), 12)
            score += weight @ (2.0 * np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1) - 1)
        out.append(int.from_bytes(np.packbits(score > 0).tobytes(), "big"))
    return out


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 0) -> DataFrame:
    """(id, fp): fp is binary, 8 bytes a lane, most significant bit first.

    lanes=0: one lane of `shingle`-word shingles, repeats counted. lanes>0: so
    many lanes over distinct words. Null and wordless texts get zero bits.
    """

    def run(batches):
        for b in batches:
            fps = []
            for t in b.column(1).to_pylist():
                text = (t or "").encode()
                values = word_lanes(text, lanes) if lanes else [majority(shingle_hashes(text, shingle))]
                fps.append(b"".join(v.to_bytes(8, "big") for v in values))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["id", "fp"])

    rows = pick(docs, id=id_col, text=text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp binary")


# ---------------------------------------------------------------- index

Chain = tuple[tuple[int, int], ...]  # (segment, wiped bit or -1) of every level of an index entry


def segments(bits: list[int], radius: int) -> list[list[int]]:
    """Cut bit positions into floor(radius/2)+1 runs of nearly equal length."""
    m = max(1, min(radius // 2 + 1, len(bits)))
    at = [round(i * len(bits) / m) for i in range(m + 1)]
    return [bits[at[i] : at[i + 1]] for i in range(m)]


def remaining(width: int, radius: int, chain: Chain) -> tuple[list[int], int]:
    """The bits that the entries of a chain leave open, and how many of them may still differ."""
    bits = list(range(width))
    for s, wild in chain:
        seg = set(segments(bits, radius)[s])
        bits, radius = [b for b in bits if b not in seg], radius - (wild >= 0)
    return bits, radius


def wiped_position(width: int, radius: int, chain: Chain) -> int | None:
    """The bit in which two fingerprints of an entry have to differ; None if its last segment is exact."""
    bits, radius = remaining(width, radius, chain[:-1])
    s, wild = chain[-1]
    return segments(bits, radius)[s][wild] if wild >= 0 else None


def key_width(width: int) -> int:
    return (width + 7) // 8 + 1


def variants(fps: list[bytes], radius: int, chain: Chain = ()) -> Iterator[tuple[int, int, np.ndarray]]:
    """(segment, wiped bit or -1, packed segment) of all variants of the bits that chain leaves open."""
    width = 8 * len(fps[0])
    rows = np.unpackbits(np.frombuffer(b"".join(fps), dtype=np.uint8).reshape(len(fps), -1), axis=1)
    bits, radius = remaining(width, radius, chain)
    for s, seg in enumerate(segments(bits, radius)):
        packed = rows[:, seg]
        yield s, -1, np.packbits(packed, axis=1)
        for wild in range(len(seg) if radius else 0):
            cut = packed.copy()
            cut[:, wild] = 0
            yield s, wild, np.packbits(cut, axis=1)


def _entries(keys: list[bytes], fps: list[bytes], radius: int, level: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Index entries one level below keys, which hold `level` levels. A key is a fixed number of bytes a level."""
    each = 2 + key_width(64 * lanes)
    by_chain: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        by_chain.setdefault(b"".join(k[j * each : j * each + 2] for j in range(level)), []).append(i)
    for head, some in by_chain.items():
        chain = tuple((head[2 * j], head[2 * j + 1] - 1) for j in range(level))
        own = [fps[i] for i in some]
        before = np.frombuffer(b"".join(keys[i] for i in some), dtype=np.uint8).reshape(len(some), level * each)
        col = pa.array(own, pa.binary())
        for s, wild, packed in variants(own, radius, chain):
            raw = np.zeros((len(some), (level + 1) * each), dtype=np.uint8)
            raw[:, : level * each] = before
            raw[:, level * each], raw[:, level * each + 1] = s, wild + 1
            raw[:, level * each + 2 : level * each + 2 + packed.shape[1]] = packed
            offsets = np.arange(0, (len(some) + 1) * raw.shape[1], raw.shape[1], dtype=np.int32)
            key = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([key, col], names=["key", "fp"])


def _index(rows: DataFrame, radius: int, level: int, lanes: int) -> DataFrame:
    """(key, fp) from (key, fp): each row's entries one level further down; at level 0 keys are empty."""

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                keys, fps = b.column(0).slice(lo, 2048).to_pylist(), b.column(1).slice(lo, 2048).to_pylist()
                yield from _entries(keys, fps, radius, level, lanes)

    return rows.mapInArrow(run, "key binary, fp binary")


def _forest(fps: list[bytes], radius: int, split: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within radius, so a group gives fewer edges than it has rows.

    split: only pairs that differ in this bit; the others meet in another entry.
    """
    rows = np.frombuffer(b"".join(fps), dtype=">u8").reshape(len(fps), -1).astype(np.uint64)
    everyone = np.arange(len(fps))
    if split is None:
        left = right = everyone
    else:
        bit = (rows[:, split // 64] >> np.uint64(63 - split % 64)) & np.uint64(1)
        left, right = everyone[bit == 0], everyone[bit == 1]
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    step = max(1, 1_000_000 // max(1, len(right)))
    for lo in range(0, len(left), step):
        some = left[lo : lo + step]
        dist = np.zeros((len(some), len(right)), dtype=np.uint16)
        for j in range(rows.shape[1]):
            dist += np.bitwise_count(rows[some, j][:, None] ^ rows[right, j][None, :])
        for a, b in zip(*(x.tolist() for x in np.nonzero(dist <= radius)), strict=True):
            i, j = int(some[a]), int(right[b])
            if (x := find(i)) != (y := find(j)):
                root[x] = y
                out.append((i, j))
    return out


def _compare(index: DataFrame, radius: int, level: int, lanes: int, group: int, last: bool) -> DataFrame:
    """(key, a, b) from entries that come in key order.

    Groups up to `group` rows give edges (null, a, b). The rows of larger ones
    come back as (key, fp, null) to be indexed one level further down, except
    at the last level, where OPEN bits bound a group.
    """
    each = 2 + key_width(64 * lanes)
    width, wide = 8 * lanes, each * level

    def run(batches):
        held_key, held, hot = None, [], False
        out: tuple[list, list, list] = ([], [], [])

        def close():
            if hot:
                spill()
            elif len(held) > 1:
                chain = tuple((held_key[j * each], held_key[j * each + 1] - 1) for j in range(level))
                for i, j in _forest(held, radius, wiped_position(8 * width, radius, chain)):
                    for to, x in zip(out, (None, held[i], held[j]), strict=True):
                        to.append(x)

        def spill():
            out[0].extend([held_key] * len(held))
            out[1].extend(held)
            out[2].extend([None] * len(held))
            held.clear()

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["key", "a", "b"])
            for x in out:
                x.clear()
            return b

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys, fps = b.column(0), b.column(1)
            raw = np.frombuffer(b"".join(keys.to_pylist()), dtype=np.uint8).reshape(n, wide)
            starts = np.concatenate([[0], np.flatnonzero((raw[1:] != raw[:-1]).any(axis=1)) + 1, [n]])
            first, final = raw[0].tobytes(), len(starts) - 2
            sizes = np.diff(starts)
            # only the first and the last run of a batch can go on in another batch
            for g in sorted({0, final, *np.flatnonzero(sizes > 1).tolist()}):
                lo, hi = int(starts[g]), int(starts[g + 1])
                key = raw[lo].tobytes() if g else first
                if key != held_key:
                    close()
                    held_key, held, hot = key, [], False
                held.extend(fps.slice(lo, hi - lo).to_pylist())
                if not last and len(held) > group:
                    hot = True
                if hot and len(held) > 4 * group:
                    spill()
                if len(out[0]) > 20_000:
                    yield flush()
        close()
        yield flush()

    return index.mapInArrow(run, "key binary, a binary, b binary")


def depth(width: int, radius: int) -> int:
    """Levels after which no entry leaves more than OPEN bits open; entries without a wiped bit leave the most."""
    level = 1
    while len(remaining(width, radius, ((0, -1),) * level)[0]) > OPEN:
        level += 1
    return level


def links(fps: DataFrame, radius: int, lanes: int, group: int = GROUP) -> DataFrame:
    """(a, b): edges that connect just what the pairs of distinct fingerprints within radius connect.

    Levels go on as long as an entry has over `group` rows, at the most until
    the bits that are still open bound it.
    """
    last = depth(64 * lanes, radius)
    spark = fps.sparkSession
    rows = fps.select(F.lit(b"").alias("key"), "fp").distinct()
    found = None
    for level in range(1, last + 1):
        index = _index(rows, radius, level - 1, lanes).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
        out = save(_compare(index, radius, level, lanes, group, level == last), "simhash-links")
        edges = out.where("b IS NOT NULL").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        rows = out.where("b IS NULL").select("key", F.col("a").alias("fp"))
        if rows.isEmpty():
            break
    return found.distinct()


# ---------------------------------------------------------------- verified near copies

SHINGLE, SIMILAR = 5, 0.8  # words; Jaccard similarity of the sets of shingles from which on two texts are near copies
DIFFER = np.arccos(2 * SIMILAR / (1 + SIMILAR)) / np.pi  # share of bits in which fingerprints of two sets of equal size differ at SIMILAR
MISSED = 1e-4  # of pairs at SIMILAR the index may miss this share, by calculation
SEGMENT, ROWS = 12, 1 << 12  # bits of a segment at least; rows of an index entry, on average, from which on it gets wider
CHECKED = 4, 72  # lanes, and bits of 256 beyond which a pair is not verified: at a similarity of 0.8 one is expected in 10^8 or so
EARLY = 1  # segments whose links make classes before the others are indexed
MATRIX = 512  # rows of an index entry that are compared as one matrix; larger ones are searched from head to head
CELL = 2048  # texts that meet in one task at once
SIEVE_BITS = 24  # 2 MB tell which texts stand in no cell


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a text under k words is one shingle, a wordless one has none."""
    found = [np.unique(h.astype(np.uint64)) for h in shingle_hashes(text, k)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def layout(rows: int) -> tuple[int, int]:
    """(lanes, radius) of an index of so many fingerprints: radius // 2 + 1 segments, of which two near copies share one but for a bit with 1 - MISSED."""
    width = max(SEGMENT, int(np.ceil(np.log2(max(1, rows) / ROWS))) + 1)
    met = (1 - DIFFER) ** width + width * DIFFER * (1 - DIFFER) ** (width - 1)
    lanes = int(np.ceil(np.log(MISSED) / np.log(1 - met) * width / 64))
    return lanes, 2 * (64 * lanes // width) - 1


def set_lanes(hashes: np.ndarray, lanes: int) -> bytes:
    """SimHash of a set of hashes: lane 0 the majority of their own bits, the others of their bits mixed anew."""
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # counts fit a byte
        h = hashes[i : i + 255]
        mixed = np.empty((len(h), lanes), dtype=">u8")
        mixed[:, 0] = h
        for lane in range(1, lanes):
            z = h + np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, lane] = z ^ (z >> np.uint64(31))
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def near_forest(fps: np.ndarray, within: int, classes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the rows within so many bits of each other. A dense group costs its rows, not its pairs.

    classes: rows of one class are linked already, so an edge is given only where it joins two classes.
    """

    def near(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        dist = np.zeros((len(some), len(others)), dtype=np.uint16)
        for j in range(fps.shape[1]):
            dist += np.bitwise_count(fps[some, j][:, None] ^ fps[others, j][None, :])
        return dist <= within

    n = len(fps)
    left = np.arange(n)
    classes = left if classes is None else classes
    if n <= MATRIX:
        all_near = near(left, left)
        if np.count_nonzero(all_near) == n:  # each is near itself only
            return []
        left = left[(all_near & (classes[:, None] != classes)).any(axis=1)]
        near = lambda some, others: all_near[np.ix_(some, others)]
    out = []
    while len(left) > 1:
        same = classes[left] == classes[left[0]]
        reached, left = left[same], left[~same]
        while len(reached) and len(left):
            some, reached = reached[:256], reached[256:]
            found = near(some, left)
            hit = found.any(axis=0)
            joined, one = np.unique(classes[left[hit]], return_index=True)
            out.extend(zip(some[found[:, hit].argmax(axis=0)[one]].tolist(), left[hit][one].tolist(), strict=True))
            same = np.isin(classes[left], joined)
            reached, left = np.concatenate([reached, left[same]]), left[~same]
    return out


def _segment_links(fps: DataFrame, lanes: int, radius: int, first: int, end: int) -> DataFrame:
    """(a, b): of (fp, class), fingerprints that differ in a quarter of their bits at most and meet in a variant of the segments from first up to end.

    They connect what all such pairs connect, given that rows of one class are connected; a null class is a class of its own.
    """

    def index(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                col, own = b.column(0).slice(lo, 4096), b.column(1).slice(lo, 4096)
                for s, wild, packed in variants(col.to_pylist(), radius):
                    if s >= end:
                        break
                    if s >= first and wild >= 0:  # what is equal in the whole segment meets in each of its variants
                        value = sum(packed[:, j].astype(np.int64) << 8 * j for j in range(packed.shape[1]))
                        yield pa.RecordBatch.from_arrays([pa.array(value | (s << 8 | wild) << 32), col, own], names=["key", "fp", "class"])

    def compare(batches):
        held, parts, seen = None, [], 0

        def close(some: list[tuple[np.ndarray, np.ndarray]]):
            rows = np.concatenate([r for r, _ in some]) if some else np.zeros((0, lanes), dtype=np.uint64)
            raw = rows.astype(">u8")
            edges = near_forest(rows, 16 * lanes, np.concatenate([c for _, c in some]) if some else None)
            return pa.RecordBatch.from_arrays([pa.array([raw[e[x]].tobytes() for e in edges], pa.binary()) for x in (0, 1)], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            rows = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=">u8").reshape(-1, lanes).astype(np.uint64)
            classes = b.column(2).fill_null(-1).to_numpy()
            classes = np.where(classes < 0, -1 - seen - np.arange(len(keys)), classes)
            seen += len(keys)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if keys[lo] != held:
                    if len(parts) > 1 or parts and len(parts[0][0]) > 1:
                        out = close(parts)
                        if out.num_rows:
                            yield out
                    held, parts = keys[lo], []
                parts.append((rows[lo:hi], classes[lo:hi]))
        yield close(parts)

    entries = fps.mapInArrow(index, "key long, fp binary, class long")
    dealt = entries.repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def near_links(fps: DataFrame, lanes: int, radius: int) -> DataFrame:
    """(a, b): they connect what all fingerprints (fp) connect that differ in a quarter of their bits at most and meet in a deletion variant of a segment; saved.

    Every pair within radius bits meets, and of those at SIMILAR all but
    MISSED. In a dense group each fingerprint meets others in most of its
    variants, so the first EARLY segments make classes, of which the others
    give only what joins two: edges grow with fingerprints, not with variants.
    """
    own = fps.select("fp").distinct()
    early = save(_segment_links(own.withColumn("class", F.lit(None).cast("long")), lanes, radius, 0, EARLY), "simhash-early-links")
    reached = save(connected_components(early, "a", "b"), "simhash-early-classes")
    discard(early)
    numbers = save(reached.where("node = component").select("component", F.monotonically_increasing_id().alias("class")), "simhash-early-numbers")
    named = reached.join(numbers, "component").select(F.col("node").alias("fp"), "class")
    late = _segment_links(own.join(named.hint("merge"), "fp", "left").select("fp", "class"), lanes, radius, EARLY, 64 * lanes)
    out = save(reached.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(late), "simhash-near-links")
    discard(reached)
    discard(numbers)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def with_sets(docs: DataFrame, id_col: str, text_col: str, lanes: int) -> DataFrame:
    """(id, own, node, fp): the text's hash, a digest of its set of shingles and the set's fingerprint, null for a wordless text."""
    rows = pick(docs, id=id_col, text=text_col).select("id", F.xxhash64("text").alias("own"), "text")

    def run(batches):
        for b in batches:
            nodes, fps = [], []
            for t in b.column(2).to_pylist():
                own = shingle_set((t or "").encode())
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                fps.append(set_lanes(own, lanes) if len(own) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(fps, pa.binary())], names=["id", "own", "node", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, own long, node binary, fp binary")


def alike(sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with a Jaccard similarity of least or more; each of its edges is verified."""
    n = len(sets)
    lanes, most = CHECKED
    fps = np.array([np.frombuffer(set_lanes(s, lanes), dtype=">u8") for s in sets]).astype(np.uint64)
    size = np.array([len(s) for s in sets])
    root = np.arange(n)  # of a component its first member
    out = []
    for i in range(n - 1):
        later = np.arange(i + 1, n)
        later = later[root[later] != root[i]]
        later = later[np.minimum(size[later], size[i]) >= least * np.maximum(size[later], size[i])]
        later = later[np.bitwise_count(fps[later] ^ fps[i]).sum(axis=1, dtype=np.int64) <= most]
        for j in later.tolist():
            if root[j] != root[i] and jaccard(sets[i], sets[j]) >= least:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def verified_links(docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, lanes: int, radius: int, cell: int = CELL) -> DataFrame:
    """(a, b): nodes with a similarity of SIMILAR or more; they connect what such pairs among those whose fingerprints near_links connects do."""
    spark = docs.sparkSession
    one = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "own", "fp"))
    classes = save(sets.groupBy("node").agg(one.alias("r")).select("node", "r.*"), "simhash-sets")
    near = near_links(classes.where("fp IS NOT NULL"), lanes, radius)
    reached = connected_components(near, "a", "b").withColumnRenamed("node", "fp")
    # all texts whose fingerprints links connect are compared, whichever of them met
    entries = save(
        classes.where("fp IS NOT NULL").select("fp", "node").join(reached, "fp", "left").select(F.xxhash64(F.coalesce("component", "fp")).alias("key"), "node"),
        "simhash-candidates",
    )
    discard(near)
    places = classes.select("node", F.col("id").alias("kid"), F.col("own").alias("kown"))

    def compare(cells: DataFrame) -> DataFrame:
        texts = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").withColumn("own", F.xxhash64("text"))
        placed = save(cells.join(places, "node"), "simhash-cells")
        # what stands in no cell is not shuffled; what may, always is, so growth is the same at every size
        some = sifted(texts, F.col("own"), placed.select(F.col("kown").alias("h")), SIEVE_BITS)
        laid = some.hint("merge").join(placed, F.col("id").eqNullSafe(F.col("kid")) & (F.col("own") == F.col("kown"))).select("cell", "node", "text")
        dealt = laid.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell")
        out = save(forests(dealt, lambda t: shingle_set(t.encode()), alike), "simhash-verified")
        discard(placed)
        return out

    found = spanning_links(entries, compare, cell)
    discard(classes)
    discard(entries)
    return found


def near_copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(id, component): every row's smallest id among the texts that verified links reach.

    Two texts are linked if the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more; equal sets always are. Null, empty and wordless
    texts are all alike. Null ids take the component of their text, null if no
    row of it has an id. An empty table gives an empty table.

    Candidates come from SimHash fingerprints of the sets, 64 bits a lane, by
    deletion variants of their segments. At 0.8 fingerprints differ in 15 bits
    of 100, so a segment has few bits and there are more of them than a radius
    asks for; layout() says how many.
    """
    lanes, radius = layout(docs.count())
    sets = save(with_sets(docs, id_col, text_col, lanes), "simhash-near")
    cc = connected_components(verified_links(docs, sets, id_col, text_col, lanes, radius, cell), "a", "b")
    classes = sets.groupBy("node").agg(F.min("id").alias("least"))
    named = classes.join(cc, "node", "left").withColumn("class", F.coalesce("component", "node"))
    best = named.groupBy("class").agg(F.min("least").alias("component"))
    by_node = named.select("node", "class").join(best, "class").select("node", "component")
    return sets.select("id", "node").join(by_node, "node").select("id", "component")


# ---------------------------------------------------------------- operators

def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, lanes: int = 0, radius: int = 3, group: int = GROUP
) -> DataFrame:
    """(id, fp, component): every row's fingerprint and the smallest id that its links reach.

    Fingerprints link at `radius` or fewer differing bits; equal ones always
    link. Null, empty and wordless texts have fingerprint zero and are linked
    like any other. Repeated rows each get a row. Rows with a null id take the
    component of their fingerprint, null if no row of it has an id. An empty
    table gives an empty table.

    Copies are reduced to distinct fingerprints before anything is indexed,
    and an entry of any size is split by the bits it leaves open, so groups of
    copies, exact or near, never meet in one task.
    """
    rows = save(with_fingerprint(docs, id_col, text_col, shingle, lanes), "simhash-fp")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    cc = connected_components(links(classes, radius, max(1, lanes), group), "a", "b")
    named = classes.join(cc.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    best = named.groupBy("class").agg(F.min("least").alias("component"))
    by_fp = named.select("fp", "class").join(best, "class").select("fp", "component")
    return rows.join(by_fp, "fp", "left").select("id", "fp", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL) -> DataFrame:
    """The rows of docs with one row of each class of near copies, the one of the smallest id.

    Near copies have a Jaccard similarity of 0.8 or more between their sets of
    five-word shingles, verified for every link. Empty, null and wordless texts
    are all alike, so one of them stays. Of rows that repeat an id the one
    whose columns have the smallest hash stays. Rows with a null id cannot be named as copies and always stay. All columns
    come back unchanged, whatever their names.
    """
    classes = save(near_copy_classes(docs, id_col, text_col, cell), "simhash-classes")
    key = F.col(f"`{id_col}`")
    kid = fresh(docs, "kept_id")
    by_id = classes.where("id IS NOT NULL").groupBy(F.col("id").alias(kid)).agg(F.bool_or(F.col("id") == F.col("component")).alias("stays"))
    gone = save(by_id.where("NOT stays").select(kid), "simhash-gone")
    # copies are found by a join; what is certainly none is not shuffled
    maybe, sure = parted(docs.where(key.isNotNull()), F.xxhash64(key), gone.select(F.xxhash64(kid).alias("h")), SIEVE_BITS)
    out = sure.unionByName(maybe.hint("merge").join(gone, key == F.col(kid), "left_anti"))
    if not classes.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        # rows of the same hash are equal, so it doesn't matter which of them stays
        h, least_id, least = (fresh(docs, c) for c in ("row_hash", "least_id", "least_hash"))
        out = out.withColumn(h, F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))))
        first = out.groupBy(key.alias(least_id)).agg(F.min(h).alias(least))
        out = out.join(first, (key == F.col(least_id)) & (F.col(h) == F.col(least)), "left_semi").drop(h).dropDuplicates([id_col])
    return out.unionByName(docs.where(key.isNull()))


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document: 3-word shingles, 3 bits."""
    out = near_duplicate_classes(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
