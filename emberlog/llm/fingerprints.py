"""Document fingerprints by consistent weighted sampling.

A text is the multiset of its words (runs without ASCII white space); a word's weight is how often
it occurs. For each of K samples a word draws r and c from Gamma(2, 1) and b from [0, 1), all from
a hash of the word alone; with t = floor(ln(weight) / r + b) its value is
ln c - r (t - b) - r, and the sample is the (word, t) of the least value. Two texts share a sample
with a probability equal to their generalised Jaccard similarity, the sum of the smaller weights
over the sum of the larger ones, so the share of equal samples estimates it.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.bpe import text_batches
from emberlog.llm.common import range_buckets, text_or_empty, words_of

SAMPLES, SEED, REMEMBERED = 64, 0x5EED, 50_000
_STEP, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _uniform(keys: np.ndarray, n: int) -> np.ndarray:
    """n numbers in (0, 1) for each 64-bit key, by a counter and a mixing function."""
    with np.errstate(over="ignore"):
        x = keys[:, None] + np.arange(1, n + 1, dtype=np.uint64) * _STEP
        x ^= x >> np.uint64(30)
        x *= _A
        x ^= x >> np.uint64(27)
        x *= _B
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Sampler:
    """Fingerprints of texts; what the words draw is remembered for a bounded number of words."""

    def __init__(self, samples: int = SAMPLES, seed: int = SEED, remembered: int = REMEMBERED):
        self.k, self.seed, self.size = samples, seed, remembered
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.r = np.empty((0, self.k), np.float32)
        self.b = np.empty((0, self.k), np.float32)
        self.least = np.empty((0, self.k), np.float32)  # the value without r t
        self.key = np.empty(0, np.uint64)
        self.used = 0

    def _learn(self, words) -> None:
        new = [w for w in words if w not in self.place]
        if not new:
            return
        if self.used + len(new) > self.size and self.used:
            self._forget()
            new = list(words)
        need = self.used + len(new)
        if need > len(self.key):
            room = max(need, min(2 * len(self.key) + 1024, self.size))
            for name in ("r", "b", "least", "key"):
                old = getattr(self, name)
                grown = np.empty((room, *old.shape[1:]), old.dtype)
                grown[: self.used] = old[: self.used]
                setattr(self, name, grown)
        for start in range(0, len(new), 2048):
            part = new[start : start + 2048]
            key = np.fromiter((xxhash.xxh3_64_intdigest(w, self.seed) for w in part), np.uint64, len(part))
            u = _uniform(key, 5 * self.k).reshape(len(part), 5, self.k)
            r, c, b = -np.log(u[:, 0] * u[:, 1]), -np.log(u[:, 2] * u[:, 3]), u[:, 4]
            at = slice(self.used, self.used + len(part))
            self.r[at], self.b[at], self.key[at] = r, b, key
            self.least[at] = np.log(c) + r * b - r
            self.place.update(zip(part, range(self.used, self.used + len(part)), strict=True))
            self.used += len(part)

    def codes(self, words: list[bytes]) -> np.ndarray | None:
        """A 16-bit code for each sample; None for a text without words."""
        if not words:
            return None
        weights = Counter(words)
        best, code = None, None
        terms = list(weights)
        for start in range(0, len(terms), self.size):  # a vocabulary beyond the table is sampled in parts
            part = terms[start : start + self.size]
            self._learn(part)
            value, own = self._sample(part, weights)
            if best is None:
                best, code = value, own
            else:
                code = np.where(value < best, own, code)
                best = np.minimum(best, value)
        return code

    def _sample(self, part: list[bytes], weights: Counter) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))
        weight = np.log(np.fromiter(map(weights.__getitem__, part), np.float32, len(part)))
        value = self.least[at]
        many = np.flatnonzero(weight > 0)
        r = self.r[at[many]]
        t = np.floor(weight[many, None] / r + self.b[at[many]])
        value[many] -= r * t
        column = np.arange(self.k)
        chosen = value.argmin(axis=0)
        step = np.zeros(len(part), np.int64)
        step[many] = np.arange(len(many))
        turns = np.where(weight[chosen] > 0, t[step[chosen], column] if len(many) else 0, 0).astype(np.int64).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (self.key[at[chosen]] ^ (turns * _B)) * _A
        return value[chosen, column], (mixed >> np.uint64(48)).astype(np.uint16)


def to_hex(codes: np.ndarray | None) -> str:
    """Four hex digits a sample; empty for a text without words."""
    return "" if codes is None else codes.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples: 1 for two texts without words, 0 if only one has words."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


_samplers: dict[int, Sampler] = {}


def sampler(samples: int = SAMPLES) -> Sampler:
    if samples not in _samplers:
        _samplers[samples] = Sampler(samples)
    return _samplers[samples]


def fingerprints(docs: DataFrame, samples: int = SAMPLES, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every whole text; null text counts as empty; repeated rows stay."""

    def made(batches):
        for batch in text_batches(batches):
            found = [to_hex(sampler(samples).codes(words_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], [key, "fingerprint"])

    return docs.select(key, text_or_empty().alias("text")).mapInArrow(made, f"{key} {dict(docs.dtypes)[key]}, fingerprint string")


def with_next(docs: DataFrame, fold):
    """Rows placed so that each document meets the next, and a function over their Arrow batches that gives lists of
    fold((doc_id, text), (doc_id, text) of the next document) for every document, ascending by doc_id, round to the first.

    Documents are dealt to ranges of doc_id in one shuffle; the first of each range goes to the
    range before it too. Rows with equal doc_id follow each other by text; a null doc_id is first.
    """
    bucket, n = range_buckets(docs, "doc_id")
    rows = docs.select("doc_id", text_or_empty().alias("text"), bucket.alias("bucket"), F.lit(False).alias("guest"))
    low = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id")
    firsts = sorted((r.bucket, r.low) for r in docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(low.alias("low")).collect())
    firsts = firsts or [(0, None)]
    ids = [k for _, k in firsts]
    to = {own: firsts[k - 1][0] for k, (own, _) in enumerate(firsts)}  # the range before; the last for the first
    is_first = F.col("doc_id").isin([k for k in ids if k is not None])
    guests = rows.where(is_first | F.col("doc_id").isNull() if None in ids else is_first)
    moved = F.array(*(F.lit(to.get(k)).cast("int") for k in range(n)))
    guests = guests.withColumn("bucket", F.get(moved, F.col("bucket"))).withColumn("guest", F.lit(True))
    placed = rows.unionByName(guests).repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", "doc_id", "text")

    def folded(batches):
        held = None
        rows: list = []
        for batch in text_batches(batches):
            for key, text, b, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[2] != b:
                    held = None
                if guest and held is not None:
                    rows.append(fold(held[:2], (key, text)))
                    held = None  # only the first of the guests follows
                elif not guest:
                    if held is not None:
                        rows.append(fold(held[:2], (key, text)))
                    held = (key, text, b)
                if len(rows) >= 512:
                    yield rows
                    rows = []
        if rows:
            yield rows

    return placed, folded


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def against_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint held against its edited text's and the next document's."""
    memory: dict = {}

    def codes(text: str):
        return sampler(samples).codes(words_of(text))

    def fold(own, following):
        key, text = own
        a = memory.pop("codes") if memory.get("text") is text else codes(text)
        changed = edited(text, following[1])
        b = codes(changed)
        c = codes(following[1])
        memory.update(text=following[1], codes=c)
        return (key, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), to_hex(a), to_hex(b), likeness(a, b), likeness(a, c))

    placed, folded = with_next(docs, fold)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def batches_of(batches):
        for rows in folded(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return placed.mapInArrow(batches_of, RESULT)
