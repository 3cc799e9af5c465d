"""Near duplicates: a Jaccard self-join of shingle sets by universe partition and pigeonhole.

A document is the set of its distinct five-word shingles, hashed to 64 bits. Sets r and s, |r| <= |s|,
with a Jaccard similarity of 0.8 or more differ in at most H = floor((|r| + |s|) / 9) elements.
Sizes are cut into bands; for the band of the larger set the universe of hashes is cut into m
segments, so some segments of r and s are equal or nearly so. A segment that is looked up as it is
counts 1, one looked up with its one-deletion neighbourhood (itself, and itself without each
element) counts 2, an empty one counts 0: if the counts of one set exceed H, a common key exists.
For each band a cost model picks how many segments get a neighbourhood, and leaves room for empty
segments; a set with too many empty ones in one partition of the universe also takes part in
another, so that no key stands for "nothing". Every set emits its keys for its own band and for those
larger bands that hold sets similar to it.

Sets that meet under a key are candidates, where a bucket is short. Keys in long buckets are given
up. A set whose counts allow that still meets all it must under its other keys; those that lack it
are crowded, and two crowded sets meet by their rarest elements instead: similar sets share one
of the first fifth of their elements in any common order, and rare ones first means that a passage
shared by very many sets is no meeting place unless the sets hold little else.

Candidates are verified exactly, but not all pairs of a bucket: pairs that share fewer keys than
similar sets must, whose places and sizes exclude a link, or whose bitmaps differ in more bits, are
out; of the others, each document is held first against the one it shares most with (in long
buckets: the bucket's head), then against the others it is not yet connected to. Members of a long
bucket that are not connected after that meet by how they differ from its head: two sets are as far
apart as these differences, so similar sets of which one does not link with the head share a part of
them, rarest elements first, where near copies of one text have little in common. Long buckets of
differences have heads in turn. A pair never verified cannot link or is connected already, so
components are those of the complete link graph.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.bpe import text_batches
from emberlog.llm.common import key_filter, mixed, partitions, word_hash, written
from emberlog.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Band width, and the cost model: keys count 1, and a segment of k elements meets by chance like CHANCE * COMMON ** k.
WIDTH, CHANCE, COMMON = 1.25, 0.5, 0.3
#: Partitions of the universe to try for sets with empty segments; sets that a worker remembers.
SEEDS, SETS = 8, 200_000
#: Members of a star verified by one task; counts by which elements are ordered, and parts in which they are added.
STAR, CELLS, PARTS = 250, 1 << 20, 64
#: Rounds of heads in long buckets.
ROUNDS = 8
#: Documents under a key beyond which it costs too much to keep where it can be done without.
HOT = 10
#: 64-bit words of the parity bitmap of a set.
BITMAP = 8

_K1 = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted set of hashed shingles: a-z for A-Z, words without ASCII white space; fewer words than a shingle are one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(word_hash, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(own) - width + 1
    key = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            key *= _K1
            key += own[k : k + n]
    key = mixed(key)
    return np.unique(key)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether 100 * intersection >= percent * union; empty sets link with nothing."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """Parities of hashed elements: two of them differ in no more bits than the sets in elements."""
    odd = np.bincount((elements & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


@lru_cache(maxsize=None)
def band(k: int, percent: int = PERCENT) -> tuple[int, int, int, int, int]:
    """(least size, most, allowed difference, segments, segments with a neighbourhood) of a band."""
    low = 1 if k == 0 else band(k - 1, percent)[1] + 1
    high = max(low, int(low * WIDTH))
    differ = (100 - percent) * 2 * high // (100 + percent)
    small = max(1.0, low * percent / 100)  # the smallest set that looks here
    best = None
    for q in {0, *range(1, 9), *((differ + 1) * p // 16 for p in range(1, 17))}:
        m = max(1, differ + 1 - q)
        for _ in range(60):
            empty = m * math.exp(-small / m) if m > 1 else 0.0
            need = differ + 1 + empty + 3 * math.sqrt(empty) if m > 3 else differ + 1
            if m + min(q, m) >= need:
                break
            m += max(1, int(need - m - min(q, m)))
        if m + min(q, m) < differ + 1 or q > m:
            continue
        each = small / m
        cost = m + q * each + m * CHANCE * COMMON**each
        if best is None or cost < best[0]:
            best = (cost, m, q)
    return low, high, differ, best[1], best[2]


def bands(n: int, percent: int = PERCENT) -> list[int]:
    """The set's own band, then those with larger sets that may be similar."""
    k = 0
    while band(k, percent)[1] < n:
        k += 1
    found = [k]
    while percent * band(found[-1] + 1, percent)[0] <= 100 * n:
        found.append(found[-1] + 1)
    return found


def keys(elements: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set meets all sets similar to it, and a note on each.

    A note holds the band (8 bits), the set's spare count in this band (16) and the count of the key's
    segment (2). A set may give up keys of a band whose counts sum up to the spare count, and still
    meets what it must.
    """
    out, notes = [], []
    for k in bands(len(elements), percent):
        _, _, differ, m, q = band(k, percent)
        for seed in range(SEEDS):
            x = elements if seed == 0 else np.sort(mixed(elements + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))))
            at = (((x >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)  # rises with x
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            segment, size = at[starts], np.diff(np.r_[starts, len(at)])
            near = (segment < q) & (size > 1)
            spare = len(starts) + int(near.sum()) - differ - 1
            note = (min(k, 255) << 20) + (min(max(spare, 0), 0xFFFF) << 2)
            place = (k << 40) + (seed << 34)
            with np.errstate(over="ignore"):
                value = mixed(x + _K1)
                total = np.add.reduceat(value, starts)
                name = mixed(segment.astype(np.uint64) + np.uint64(place))
                out.append(mixed(total + name))
                notes.append(note + 1 + near)
                if near.any():
                    inside = np.repeat(near, size)
                    out.append(mixed((np.repeat(total, size) - value + np.repeat(name, size))[inside]))
                    notes.append(np.full(len(out[-1]), note + 2))
                if spare < 0 and seed == SEEDS - 1:
                    out.append(mixed(mixed(np.setdiff1d(np.arange(m), segment).astype(np.uint64) + np.uint64(place))))
                    notes.append(np.full(len(out[-1]), note + 3))  # never given up
            if spare >= 0:
                break
    return np.concatenate(out), np.concatenate(notes).astype(np.int32)


_KEYED = "key long, note long, doc long"


def _keyed(docs: DataFrame) -> DataFrame:
    """A row for the set of each document (key: a hash of the set; note: -1 - (size * 2^32 + another hash)), and its keys.

    A set seen before in the same task leaves its keys to its first document there.
    """

    def made(batches):
        seen: set[int] = set()
        for batch in text_batches(batches):
            key, note, docs = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingles(text)
                own = xxhash.xxh3_128_intdigest(x.tobytes() if len(x) else doc.to_bytes(8, "little", signed=True))
                key.append(np.array([own >> 64], np.uint64))
                note.append(np.array([-1 - (len(x) << 32 | own & 0xFFFFFFFF)], np.int64))
                docs.append((doc, 1))
                if len(x) and own not in seen:
                    if len(seen) >= SETS:
                        seen.clear()
                    seen.add(own)
                    k, w = keys(x)
                    key.append(k)
                    note.append(w)
                    docs.append((doc, len(k)))
            if key:
                ids = np.repeat(np.array([d for d, _ in docs], np.int64), [n for _, n in docs])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(note).astype(np.int64)), pa.array(ids)], ["key", "note", "doc"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(made, _KEYED)


def _nameless(docs: DataFrame) -> DataFrame:
    """Rows without doc_id: their set's size, and no component."""

    def made(batches):
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(shingles(t)) for t in batch.column(1).to_pylist()], pa.int64()), batch.column(0)], ["doc_id", "n_shingles", "component_id"])

    return docs.where("doc_id is null").select("doc_id", "text").mapInArrow(made, "doc_id long, n_shingles long, component_id long")


def _runs(keyed: DataFrame, hot: int = HOT) -> DataFrame:
    """keyed with `first`, the smallest document of each run of equal sets, and whether a run of equal keys is longer than `hot`.

    Keys that stand alone are left out; sets are not. At most `hot` rows of a run are held.
    """

    def scan(batches):
        held, open_run = None, None  # the last run while it is short; (key, set, first) of one that is long
        names = ["key", "note", "doc", "first", "hot"]

        def put(key, note, doc, first, long, length):
            keep = (note < 0) | (length > 1)
            first = pa.array(first[keep], mask=note[keep] >= 0)  # for sets only
            return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(note[keep]), pa.array(doc[keep]), first, pa.array(long[keep])], names)

        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(3)]
            if held is not None:
                rows = [np.r_[h, x] for h, x in zip(held, rows, strict=True)]
            key, note, doc = rows
            if not len(key):
                continue
            own = np.minimum(note, 0)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
            length = np.diff(np.r_[starts, len(key)])
            first, long = doc[starts], length > hot
            if open_run is not None and (key[0], own[0]) == open_run[:2]:
                first[0], long[0] = open_run[2], True
            end = len(key)
            if long[-1]:
                held, open_run = None, (key[-1], own[-1], first[-1])
            else:
                end, open_run = starts[-1], None
                held = [x[end:] for x in rows]
            spread = np.repeat(np.arange(len(starts)), length)[:end]
            yield put(*(x[:end] for x in rows), first[spread], long[spread], np.where(long, hot + 1, length)[spread])
        if held is not None:
            n = len(held[0])
            yield put(*held, np.full(n, held[2][0]), np.zeros(n, bool), np.full(n, n))

    n = partitions(keyed.sparkSession)
    return keyed.repartition(n, "key").sortWithinPartitions("key", F.least("note", F.lit(0)), "doc").mapInArrow(scan, f"{_KEYED}, first long, hot boolean")


def _allocated(runs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys in short buckets (key, doc, band, spare, count), (doc, band, lost) of documents in long ones, and the crowded documents.

    A long bucket costs most and says least, so all keys in long buckets are given up. A document
    whose spare count covers them (lost) meets what it must elsewhere. The others are crowded: two
    similar ones of them may have no key left in common. Of equal sets the smallest document stands for all.
    """
    bits = lambda low, most: F.shiftright("note", low).bitwiseAND(most).cast("int")
    rows = runs.where("note >= 0").select("key", "doc", "hot", bits(20, 255).alias("band"), bits(2, 0xFFFF).alias("spare"), bits(0, 3).alias("count"))
    own = written(rows.where("hot").groupBy("doc", "band").agg(F.sum("count").alias("lost"), F.min("spare").alias("spare"), F.max("count").alias("most")))
    leads = runs.where("note < 0").select("doc", "first")
    crowded = written(own.where("lost > spare or most > 2").select("doc").distinct().join(leads, "doc").select(F.col("first").alias("doc")).distinct())
    return rows.where("not hot").drop("hot"), own.select("doc", "band", "lost"), crowded


def _sharing(met: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, n) of pairs (a, b, band, spare_a, spare_b, n) that share as much in a band as similar sets must; own: what was given up."""
    side = lambda c: own.select(F.col("doc").alias(c), "band", F.col("lost").alias(f"lost_{c}"))
    met = met.join(side("a"), ["a", "band"], "left").join(side("b"), ["b", "band"], "left")
    lost = lambda c: F.coalesce(f"lost_{c}", F.lit(0))
    enough = met.where((F.col("n") > F.col("spare_a") - lost("a")) & (F.col("n") > F.col("spare_b") - lost("b")))
    return enough.groupBy("a", "b").agg(F.max("n").alias("n"))


def _summed(pairs: DataFrame) -> DataFrame:
    """(a, b, band, spare_a, spare_b, n) over the keys that pairs share."""
    return pairs.groupBy("a", "b", "band").agg(F.min("spare_a").alias("spare_a"), F.min("spare_b").alias("spare_b"), F.sum("n").alias("n"))


def _cold_pairs(cold: DataFrame) -> DataFrame:
    """What pairs share in buckets of at most HOT documents."""
    together = cold.repartition(partitions(cold.sparkSession), "key")
    buckets = together.groupBy("key", "band").agg(F.collect_list(F.struct("doc", "spare", "count")).alias("docs")).where("size(docs) > 1")
    pairs = buckets.select("band", "docs", F.explode("docs").alias("x")).select("band", "x", F.explode(F.filter("docs", lambda y: y["doc"] < F.col("x.doc"))).alias("y"))
    return _summed(pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), "band", F.col("x.spare").alias("spare_a"), F.col("y.spare").alias("spare_b"), F.greatest("x.count", "y.count").alias("n")))


def _candidate_texts(docs: DataFrame, wanted: DataFrame, crowded: DataFrame) -> DataFrame:
    """(doc, crowded, packed, size, bitmap words) of the documents in `wanted` and a few more: filters of a bounded size travel, not lists."""
    asked, dense = key_filter(wanted), key_filter(crowded)
    shared = docs.sparkSession.sparkContext.broadcast((asked, dense))

    def pick(batches):
        zip_, (asked, dense) = zstandard.ZstdCompressor(level=3), shared.value
        for batch in text_batches(batches):
            ids = batch.column(0).fill_null(0).to_numpy()
            hit = asked.known(ids) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            if hit.any():
                part = batch.filter(pa.array(hit))
                packed = [zip_.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                words = np.stack([bitmap(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(dense.known(ids[hit])), pa.array(packed, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(words[:, k]) for k in range(BITMAP))],
                    ["doc", "crowded", "packed", "size", *_WORDS],
                )

    return written(docs.select("doc_id", "text").mapInArrow(pick, "doc long, crowded boolean, packed binary, size long, " + ", ".join(f"{w} long" for w in _WORDS)))


def _unpacked(batch, column: int):
    unzip = zstandard.ZstdDecompressor()
    return [shingles(unzip.decompress(x).decode("utf-8", "surrogatepass")) for x in batch.column(column).to_pylist()]


def _cells(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _listed(batch, column: int):
    return [np.frombuffer(x, np.uint64) for x in batch.column(column).to_pylist()]


def _frequencies(sets: DataFrame, unpacked=_unpacked) -> np.ndarray:
    """About how often the elements of the sets in the first column occur, by their top bits: CELLS counts, whatever the corpus holds."""
    part = CELLS // PARTS

    def count(batches):
        own = np.zeros(CELLS, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                cells, n = np.unique(np.concatenate([_cells(x) for x in unpacked(batch.slice(start, 256), 0)]), return_counts=True)
                own[cells] += n
        zip_ = zstandard.ZstdCompressor(level=1)
        for k in range(PARTS) if own.any() else ():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zip_.compress(own[k * part : (k + 1) * part].tobytes())], pa.binary())], ["part", "counts"])

    def add(batches):
        unzip, held = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(unzip.decompress(counts), np.int64)
        for k, counts in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts.tobytes()], pa.binary())], ["part", "counts"])

    out, kind = np.zeros(CELLS, np.int64), "part int, counts binary"
    for row in sets.mapInArrow(count, kind).repartition(min(PARTS, partitions(sets.sparkSession)), "part").mapInArrow(add, kind).collect():
        out[row.part * part : (row.part + 1) * part] = np.frombuffer(row.counts, np.int64)
    return out


def first_elements(elements: np.ndarray, frequency: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The set's elements, rare ones first, as far as a similar set may meet it there at first; and up to which size that other set may have.

    One order for all sets: by frequency, then by value. Let e be the first element that similar sets
    x and y share, at place i of x. Then they share no more than |x| - i elements, and must share
    percent / (100 + percent) of |x| + |y|.
    """
    order = np.lexsort((elements, frequency[_cells(elements)]))
    n = len(elements)
    most = (100 + percent) * (n - np.arange(n)) // percent - n
    enough = 100 * most >= percent * n
    return elements[order[enough]], most[enough]


def _entries(texts: DataFrame) -> DataFrame:
    """(element, doc, size, most) for the first elements of every set in `texts`."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequencies(texts.select("packed")))

    def made(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                found = [(x, *first_elements(x, shared.value)) for x in _unpacked(some, 1)]
                lengths = [len(e) for _, e, _ in found]
                cols = [np.concatenate([e for _, e, _ in found]).view(np.int64), np.repeat(some.column(0).to_numpy(), lengths), np.repeat([len(x) for x, _, _ in found], lengths), np.concatenate([m for _, _, m in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["element", "doc", "size", "most"])

    return texts.select("doc", "packed").mapInArrow(made, "element long, doc long, size long, most long")


#: Whether x, the smaller set (of equal ones that of the smaller document), and y may be similar as far as places and sizes tell.
_FIT = "(x.size < y.size or (x.size = y.size and x.doc < y.doc)) and y.size <= x.most and x.size <= y.most and 100 * x.size >= {percent} * y.size"


def _headed(long: DataFrame) -> DataFrame:
    """(bucket, a, b) of each (bucket, element, doc): b is the head of the element, a member that has most elements in the bucket: an original, rather than a copy."""
    held = long.groupBy("bucket", "doc").agg(F.count("*").alias("held"))
    head = F.max(F.struct("held", (-F.col("doc")).alias("doc")))
    heads = long.select("bucket", "element", "doc").join(held, ["bucket", "doc"]).groupBy("bucket", "element").agg((-head.getField("doc")).alias("b"))
    return long.select("bucket", "element", F.col("doc").alias("a")).join(heads, ["bucket", "element"]).where("a <> b").select("bucket", "a", "b")


def _crowded_pairs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of crowded documents: pairs (a, b, n) met under rare elements and stars of common ones; and those stars (a, b), a row for each element."""
    entries = written(_entries(texts))
    many = written(entries.groupBy("element").agg(F.count("*").alias("many")).where("many > 1"))
    rare = entries.join(many.where(F.col("many") <= HOT).select("element"), "element", "left_semi")
    fit = _FIT.format(percent=PERCENT)
    buckets = rare.groupBy("element").agg(F.collect_list(F.struct("doc", "size", "most")).alias("docs"))
    pairs = buckets.select("docs", F.explode("docs").alias("x")).select("x", F.explode("docs").alias("y")).where(fit)
    common = written(entries.join(many.where(F.col("many") > HOT).select("element"), "element"))
    stars = written(_headed(common.withColumn("bucket", F.lit(0))).select("a", "b"))
    near = pairs.select(F.col("y.doc").alias("a"), F.col("x.doc").alias("b"))
    return near.unionByName(stars).groupBy("a", "b").agg(F.count("*").alias("n")), stars


_WORDS = [f"w{k}" for k in range(BITMAP)]


def _sketch(texts: DataFrame, c: str) -> DataFrame:
    """doc, size and bitmap of the one side of a pair."""
    return texts.select(F.col("doc").alias(c), F.col("size").alias(f"size_{c}"), *(F.col(w).alias(f"{w}_{c}") for w in _WORDS))


def _possible(percent: int = PERCENT) -> Column:
    """Whether sizes and bitmaps of a and b allow a link."""
    differ = F.lit(0)
    for w in _WORDS:
        differ = differ + F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b")))
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    return (100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (F.col("size_a") + F.col("size_b")))


def _stars(pairs: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, part, a, role, packed, others) of the pairs (*by with b, a, others): the sets of b (role 0), then those of a; where many meet a b, it is copied to several tasks."""
    more = [c for c in pairs.columns if c not in (*by, "a")]
    size = pairs.groupBy(*by).agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / STAR).cast("int"))
    texts = texts.select(F.col("doc"), F.col("packed"))
    members = pairs.join(size.select(*by, "parts"), by).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    members = members.join(texts, F.col("a") == F.col("doc")).select(*by, "part", "a", F.lit(1).alias("role"), "packed", *more)
    heads = size.join(texts, F.col("b") == F.col("doc")).select(*by, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("a"), F.lit(0).alias("role"), "packed")
    met = members.unionByName(heads, allowMissingColumns=True)
    return met.repartition(partitions(pairs.sparkSession), *by, "part").sortWithinPartitions(*by, "part", "role")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: those whose bitmaps allow it go to where b is."""
    pairs = written(pairs.join(_sketch(texts, "a"), "a").join(_sketch(texts, "b"), "b").where(_possible()).select("a", "b"))

    def compare(batches):
        unzip, head, sets = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = []
                for b, part, a, role, packed in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    x = shingles(unzip.decompress(packed).decode("utf-8", "surrogatepass"))
                    if role == 0:
                        sets = [*sets, x] if head == (b, part) else [x]
                        head = (b, part)
                    elif head == (b, part) and any(linked(x, y) for y in sets):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return written(_stars(pairs, texts, ["b"]).mapInArrow(compare, "a long, b long").distinct())


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    out = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    return out.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def difference(x: np.ndarray, head: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """How x differs from head, and its need: x and y link if 2 * (100 + percent) times what their differences share is the sum of their needs or more."""
    own = np.setxor1d(x, head, assume_unique=True)
    return own, (100 + percent) * len(own) - (100 - percent) * len(x)


def least_need(x: int, need: int, head: int, apart: bool, percent: int = PERCENT) -> int:
    """The least need of a set that one of x elements may link with; one that links with the head looks only for those that don't."""
    largest = (100 - percent) * (100 * x // percent)
    return max(need - 2 * largest, -largest if apart else (100 - percent) * head + 1)


def first_differences(own: np.ndarray, need: int, least: int, frequency: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The difference's elements, rare ones first, as far as one with a need of `least` may be met there at first; and the need up to which it may be."""
    order = np.lexsort((own, frequency[_cells(own)]))
    most = 2 * (100 + percent) * (len(own) - np.arange(len(own))) - need
    enough = most >= least
    return own[order[enough]], most[enough]


def _differences(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(own, bucket, doc, of, apart, need, least) of the members a of buckets (bucket, b, a, of, apart): how they differ from b, hashed with the bucket."""

    def made(batches):
        unzip, star, sets = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                found = []
                for bucket, _, part, a, role, packed, of, apart in zip(*(c.to_pylist() for c in batch.slice(start, 512).columns), strict=True):
                    x = shingles(unzip.decompress(packed).decode("utf-8", "surrogatepass"))
                    if role == 0:
                        sets = [*sets, x] if star == (bucket, part) else [x]
                        star = (bucket, part)
                    elif star == (bucket, part) and len(x):
                        head = min(sets, key=lambda s: s.tobytes())  # of rows that share a doc_id any, but the same one in all tasks
                        own, need = difference(x, head)
                        own = mixed(own ^ mixed(np.array([bucket], np.int64).view(np.uint64)))
                        found.append((own.tobytes(), bucket, a, of, apart, need, least_need(len(x), need, len(head), apart)))
                if found:
                    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds, strict=True)], ["own", "bucket", "doc", "of", "apart", "need", "least"])

    stars = _stars(buckets.select("bucket", "b", "a", "of", "apart"), texts, ["bucket", "b"])
    return written(stars.mapInArrow(made, "own binary, bucket long, doc long, of long, apart boolean, need long, least long"))


def _differing(differences: DataFrame) -> DataFrame:
    """(element, bucket, doc, of, apart, need, most, low, lows) for the first elements of the differences.

    Of two sets that link, the one that needs less (low) has the element among its first |set| / 9. Rows that
    meet no low one there which isn't connected to all of them are left out; lows: how many low ones there are.
    """
    shared = differences.sparkSession.sparkContext.broadcast(_frequencies(differences.select("own"), _listed))

    def made(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                found = [first_differences(own, need, least, shared.value) for own, need, least in zip(_listed(some, 0), some.column(5).to_pylist(), some.column(6).to_pylist(), strict=True)]
                at = pa.array(np.repeat(np.arange(len(found)), [len(e) for e, _ in found]))
                cols = [np.concatenate([e for e, _ in found]).view(np.int64), np.concatenate([m for _, m in found]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *(some.column(k).take(at) for k in range(1, 6)), pa.array(cols[1])], ["element", "bucket", "doc", "of", "apart", "need", "most"])

    entries = written(differences.mapInArrow(made, "element long, bucket long, doc long, of long, apart boolean, need long, most long"))
    entries = entries.withColumn("low", F.col("most") >= F.col("need"))
    low = lambda f, c: f(F.when(F.col("low"), F.col(c)))
    met = entries.groupBy("element").agg(F.max("apart").alias("loose"), F.min("of").alias("one"), F.max("of").alias("other"), low(F.min, "need").alias("least"), low(F.max, "most").alias("reach"))
    met = met.where("loose and one < other and least is not null").select("element", "least", "reach")
    entries = written(entries.join(met, "element").where("least <= most and need <= reach").drop("least", "reach"))
    lows = entries.groupBy("element").agg(F.count_if("low").alias("lows"), F.count("*").alias("many")).where("lows > 0 and many > 1")
    return written(entries.join(lows.drop("many"), "element"))


def _meet(x: Column, y: Column) -> Column:
    """Whether x and y, which is low, may link and are not connected, as far as needs and places tell."""
    return (x["apart"] | y["apart"]) & (x["of"] != y["of"]) & (y["need"] <= x["need"]) & (x["need"] <= y["most"]) & (y["need"] <= x["most"])


def _pair(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, b, a, of, apart) of members (bucket, b, a): the component of a, and whether it is another than that of b, where that holds for any in the bucket."""
    label = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    out = members.join(label("a"), "a", "left").join(label("b"), "b", "left").withColumn("of", F.coalesce("of_a", "a"))
    out = written(out.select("bucket", "b", "a", "of", (F.col("of") != F.coalesce("of_b", "b")).alias("apart")))
    return out.join(out.where("apart").select("bucket").distinct(), "bucket", "left_semi")


def _round(buckets: DataFrame, texts: DataFrame, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """One round of long buckets whose members have been held against their head: pairs (a, b) to verify, and the buckets of the next round.

    A pair that links and is not connected has a member apart from the head. It shares elements of
    its differences, unless their needs sum up to nothing: then it also links with the member of the
    head's component that needs least. Elements that many low ones share make the next buckets, under heads of
    their own; a head is in none of them, so rounds end. Where these buckets hold more than `rows`
    rows, differences are common too, and all members that may link are paired instead.
    """
    differences = _differences(buckets, texts)
    least = differences.where("not apart").groupBy("bucket").agg(F.min(F.struct("need", "doc")).alias("y"))
    pairs = differences.where("apart").join(least, "bucket").where("need + y.need <= 0").select(*_pair("doc", "y.doc"))
    entries = _differing(differences)
    member = F.struct("doc", "of", "apart", "need", "most")
    lows = entries.where(F.col("low") & (F.col("lows") <= HOT)).groupBy("element").agg(F.collect_list(member).alias("docs"))
    met = entries.select("element", member.alias("x")).join(lows, "element").select("x", F.explode(F.filter("docs", lambda y: _meet(F.col("x"), y))).alias("y"))
    pairs = pairs.unionByName(met.select(*_pair("x.doc", "y.doc")))
    long = entries.where(F.col("lows") > HOT)
    headed = written(_headed(long).select(F.xxhash64("bucket", "b").alias("bucket"), "b", "a").distinct())
    if headed.count() <= rows:
        return pairs.unionByName(headed.select(*_pair("a", "b"))).distinct(), headed
    salts = F.ceil(F.col("lows") / STAR).cast("int")
    left = long.where("low").select("element", F.pmod(F.xxhash64("doc"), salts).cast("int").alias("salt"), member.alias("y"))
    right = long.select("element", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), member.alias("x"))
    all_ = left.join(right, ["element", "salt"]).where(_meet(F.col("x"), F.col("y"))).select(*_pair("x.doc", "y.doc"))
    return pairs.unionByName(all_).distinct(), None


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id reachable by links, itself included.

    Null or wordless text: an empty set, linked with nothing. Rows that share a doc_id are one node;
    a row without doc_id takes no part and has no component. Extra columns are not looked at.
    """
    runs = written(_runs(_keyed(docs)))
    leads = runs.where("note < 0").select(F.col("doc").alias("doc_id"), F.shiftright(-1 - F.col("note"), 32).alias("n_shingles"), F.col("first").alias("lead"))
    cold, own, crowded = _allocated(runs)
    met = written(_sharing(_cold_pairs(cold), own))
    texts = _candidate_texts(docs, met.select(F.col("a").alias("doc")).union(met.select("b")).union(crowded), crowded)
    more, stars = _crowded_pairs(texts.where("crowded"))
    met = written(met.unionByName(more).groupBy("a", "b").agg(F.max("n").alias("n")))

    def joined(*links: DataFrame) -> DataFrame:
        """Components of the links so far and of equal sets."""
        edges = leads.where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
        for more in links:
            edges = edges.unionByName(more.select("a", "b"))
        return written(components(edges))

    most = met.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where("nth = 1").select("a", "b")
    links, found = [], joined()

    def verify(new: DataFrame) -> None:
        nonlocal found
        new = written(new)
        if not new.isEmpty():
            links.append(_verified(new, texts))
            found = joined(*links)

    verify(most)
    verify(_apart(met.select("a", "b"), found))
    rows, done = stars.count(), met.select(*_pair("a", "b"))
    members = stars.select(F.col("b").alias("bucket"), "b", "a").distinct()
    for k in range(ROUNDS):
        buckets = written(_buckets(members, found))
        if buckets.isEmpty():
            break
        pairs, members = _round(buckets, texts, rows if k + 1 < ROUNDS else 0)
        verify(_apart(pairs, found).join(done, ["a", "b"], "left_anti"))
        if members is None:
            break
    out = leads.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.unionByName(_nameless(docs))
