"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks of 20 consecutive words, one at every word. The
index of blocks is a table dealt by fingerprint over all executors: for each block its smallest
place (document, start). Every document is parsed greedily against it: a block that the index knows
from an earlier place opens a factor, which runs on while the following blocks continue at the same
source; where a factor ends, each block across the boundary is looked up for itself. Words covered
by factors of at least a block are duplicates.

Blocks that occur once are most of a corpus, and need not travel. Each block contains the least of
its 13 eight-word fingerprints (its anchor), and equal blocks have equal anchors, so anchors are
counted first, a seventh as many rows, and only blocks whose anchor is repeated go to the index. The
repeated anchors travel in a filter of a size that is bounded; what passes it wrongly is looked up
in vain, and no block is missed. Before the shuffle, blocks that repeat within a batch of a task
are settled there, so a very frequent block gives a row per batch.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.bpe import text_batches
from emberlog.llm.common import KeyFilter, key_filter, mixed, partitions, quoted, word_hash, words_of, written

BLOCK, ANCHOR = 20, 8
#: Bytes of text settled together.
TOGETHER = 2 << 20

_K, _A = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_K), k, 1 << 64))


def _rolled(own: np.ndarray, width: int) -> np.ndarray:
    """A polynomial fingerprint of each run of `width` values, in steps of four."""
    with np.errstate(over="ignore"):
        n = len(own) - width + 1
        four = ((own[:-3] * _K + own[1:-2]) * _K + own[2:-1]) * _K + own[3:]
        out = four[:n].copy()
        for k in range(4, width, 4):
            out = out * _power(4) + four[k : k + n]
        return out


def anchors(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eight-word fingerprints, and for each block the place of its anchor among them."""
    key = mixed(_rolled(own, ANCHOR))
    span = BLOCK - ANCHOR + 1
    view = np.lib.stride_tricks.sliding_window_view(key, span)
    return key, np.arange(len(view)) + view.argmin(axis=1)


def blocks(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each block, 64 and 32 bits."""
    return mixed(_rolled(own, BLOCK)), (mixed(_rolled(mixed(own + _A), BLOCK)) >> np.uint64(33)).astype(np.int32)


def _anchor_counts(docs: DataFrame) -> DataFrame:
    def counted(batches):
        for batch in text_batches(batches, TOGETHER):
            found = []
            for text in batch.column(1).to_pylist():
                own = words_of(text)
                if len(own) >= BLOCK:
                    key, at = anchors(word_hashes(own))
                    found.append(key[np.unique(at)])
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])

    return docs.select("doc_id", "text").mapInArrow(counted, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


#: Index rows have no source. A match has the smallest known place of its block: source document and start there (at).
_ROWS = "key long, check int, doc long, start int, source long, at int"
_NAMES = ["key", "check", "doc", "start", "source", "at"]
_MATCH = "doc long, start int, source long, at int"


def _row_batch(new: np.ndarray, old: np.ndarray, key, check, doc, start, head) -> pa.RecordBatch:
    """Index rows, then matches that are settled, dealt by a hash of the document."""
    n, m = int(new.sum()), int(old.sum())
    spread = mixed(doc[old].view(np.uint64)).view(np.int64)
    nothing = np.r_[np.ones(n, bool), np.zeros(m, bool)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[key[new].view(np.int64), spread]),
            pa.array(np.r_[check[new], np.zeros(m, np.int32)]),
            pa.array(np.r_[doc[new], doc[old]]),
            pa.array(np.r_[start[new], start[old]]),
            pa.array(np.r_[np.zeros(n, np.int64), doc[head[old]]], mask=nothing),
            pa.array(np.r_[np.zeros(n, np.int32), start[head[old]]], mask=nothing),
        ],
        _NAMES,
    )


def _in_order(key, check, doc, start) -> np.ndarray:
    """The order by key, check, document, start; rows mostly come in that of documents already."""
    if (doc[1:] >= doc[:-1]).all():
        order = np.argsort(key, kind="stable")
        k, c = key[order], check[order]
        if not ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():
            return order
    return np.lexsort((start, doc, check, key))


def _candidates(docs: DataFrame, repeated: KeyFilter) -> DataFrame:
    """Blocks with a repeated anchor; of equal ones in a batch only the first goes on, the others have found a source."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def made(batches):
        for batch in text_batches(batches, TOGETHER):
            parts = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if doc is None or len(words) < BLOCK:
                    continue
                own = word_hashes(words)
                key, at = anchors(own)
                places, back = np.unique(at, return_inverse=True)
                hit = np.flatnonzero(shared.value.known(key[places])[back])
                if len(hit):
                    a, b = blocks(own)
                    parts.append((a[hit], b[hit], np.full(len(hit), doc, np.int64), hit.astype(np.int32)))
            if not parts:
                continue
            key, check, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = _in_order(key, check, doc, start)
            key, check, doc, start = key[order], check[order], doc[order], start[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            old = ~new & ((doc != doc[head]) | (start != start[head]))
            yield _row_batch(new, old, key, check, doc, start, head)

    return docs.select("doc_id", "text").mapInArrow(made, _ROWS)


def _matches(candidates: DataFrame) -> DataFrame:
    """(doc, start, source, at): for each block of a document its smallest place, where that is earlier."""

    def scan(batches):
        last = None  # key, check, document, start of the open block's smallest place
        names = _NAMES[2:]
        for batch in batches:
            settled = batch.column(4).is_valid()
            ready = batch.filter(settled)
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays(ready.columns[2:], names)
            here = np.flatnonzero(~settled.to_numpy(zero_copy_only=False))
            if not len(here):
                continue
            key, check, doc, start = (batch.column(k).to_numpy()[here] for k in range(4))
            if last is not None:
                key, check, doc, start = (np.r_[x, y] for x, y in zip(last, (key, check, doc, start), strict=True))
            new = np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            old = ~new & ((doc != doc[head]) | (start != start[head]))
            if old.any():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[old], start[old], doc[head[old]], start[head[old]])], names)
            h = head[-1]
            last = key[h : h + 1], check[h : h + 1], doc[h : h + 1], start[h : h + 1]

    n = partitions(candidates.sparkSession)
    return candidates.repartition(n, "key").sortWithinPartitions("key", "check", "doc", "start").mapInArrow(scan, _MATCH)


def factors(start: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, words, source document, start there), in order: the greedy parse over known blocks.

    A block that continues the last one at its source lengthens the factor; any other opens a new
    one, also where it overlaps the last factor: that is the look across the boundary.
    """
    if not len(start):
        return []
    order = np.lexsort((at, source, start))
    start, source, at = start[order], source[order], at[order]
    once = np.r_[True, start[1:] != start[:-1]]
    start, source, at = start[once], source[once], at[once]
    go_on = (np.diff(start) == 1) & (np.diff(source) == 0) & (np.diff(at) == 1)
    heads = np.flatnonzero(np.r_[True, ~go_on])
    ends = np.r_[heads[1:], len(start)] - 1
    words = start[ends] - start[heads] + BLOCK
    return list(zip(start[heads].tolist(), words.tolist(), source[heads].tolist(), at[heads].tolist(), strict=True))


def parsed(docs: DataFrame, fold, schema: str, carry: list[str] | None = None) -> DataFrame:
    """fold(doc_id, text, factors) gives a row for every row of docs, in a pass where each text meets its matches.

    The columns in `carry` follow each row unchanged.

    Documents come in the order of doc_id; of equal blocks the one with the smallest (doc_id, start)
    stays. Null text: no words. Rows that share a doc_id count as one document, and a row without
    doc_id is neither reference nor changed. Texts of fewer than 20 words have no block.
    """
    rows, carried = docs.select("doc_id", "text"), [f"c{k}" for k in range(len(carry or []))]
    matches = _matches(_candidates(rows, key_filter(written(_anchor_counts(rows)), per_key=8)))

    def packed_texts(batches):
        zip_ = zstandard.ZstdCompressor(level=2)
        for batch in text_batches(batches):
            packed = [None if t is None else zip_.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([1] * len(packed), pa.int32()), pa.array(packed, pa.binary()), *batch.columns[2:]], ["doc", "role", "packed", *carried])

    types = {c: dict(docs.dtypes)[name] for c, name in zip(carried, carry or [], strict=True)}
    with_text = docs.select("doc_id", "text", *(F.col(quoted(name)).alias(c) for c, name in zip(carried, carry or [], strict=True)))
    texts = with_text.mapInArrow(packed_texts, ", ".join(["doc long, role int, packed binary", *(f"{c} {t}" for c, t in types.items())]))
    met = matches.withColumn("role", F.lit(0)).unionByName(texts, allowMissingColumns=True).select("doc", "role", "start", "source", "at", "packed", *carried)
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def folded(batches):
        unzip, doc, held, found = zstandard.ZstdDecompressor(), None, [], []
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            gone = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            role = batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (gone[1:] != gone[:-1]) | (role[1:] != role[:-1]), True][: len(ids) + 1]).tolist()
            rows: list = []
            texts: list[int] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = None if gone[a] else int(ids[a])
                if own != doc or own is None:
                    doc, held, found = own, [], None
                if role[a] == 0:
                    held.append(tuple(batch.column(k).slice(a, b - a).to_numpy() for k in (2, 3, 4)))
                    continue
                if found is None:
                    found = factors(*(np.concatenate(x) for x in zip(*held, strict=True))) if held and own is not None else []
                    held = []
                for k in range(a, b):
                    packed = batch.column(5)[k].as_py()
                    rows.append(fold(own, None if packed is None else unzip.decompress(packed).decode("utf-8", "surrogatepass"), found))
                    texts.append(k)
                    if len(rows) >= 256:
                        yield result(batch, rows, texts)
                        rows, texts = [], []
            if rows:
                yield result(batch, rows, texts)

    def result(batch, rows, texts):
        carried_along = [c.take(pa.array(texts)) for c in batch.columns[6:]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)), *carried_along], [*names, *carried])

    placed = met.repartition(partitions(docs.sparkSession), "doc").sortWithinPartitions("doc", "role")
    found = placed.mapInArrow(folded, ", ".join([schema, *(f"{c} {t}" for c, t in types.items())]))
    return found.withColumnsRenamed(dict(zip(carried, carry or [], strict=True)))


def covered(n: int, found: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Which of n words lie in a factor."""
    edge = np.zeros(n + 1, np.int64)
    for start, words, _, _ in found:
        edge[min(start, n)] += 1
        edge[min(start + words, n)] -= 1
    return np.cumsum(edge)[:-1] > 0


def without(text: str | None, found: list[tuple[int, int, int, int]]) -> str | None:
    """The text without the words in factors; white space before a removed word goes with it."""
    if not text or not found:
        return text
    spans = [m.span() for m in _WORD.finditer(text)]
    gone = covered(len(spans), found)
    out, at = [], 0
    for (a, b), drop in zip(spans, gone.tolist(), strict=True):
        if not drop:
            out.append(text[at:b])
        at = b
    return "".join(out).lstrip(" \t\n\v\f\r") if gone[0] else "".join(out) + text[at:]


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the text that is left.

    Null text stays null, and texts of fewer than 20 words stay as they are. Rows that share a doc_id are one document, whose matches
    count for each of them by their places; rows without doc_id stay unchanged; other columns follow, whatever their names.
    """
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    return parsed(docs, lambda doc, text, found: (doc, without(text, found)), "doc_id long, text string", carry).select(*map(quoted, docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row. Null text: no words; an empty table gives no rows; rows that share a doc_id are one document."""

    def fold(doc, text, found):
        words = words_of(text)
        gone = covered(len(words), found)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if found else b" ".join(words)
        return doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()

    return parsed(docs, fold, "doc_id long, n_words long, n_removed long, kept_sha256 string")
