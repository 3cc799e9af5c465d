"""Best-fit packing by linear grouping.

Only lengths matter for packing, and a sequence holds at most `capacity` tokens, so a corpus of any
size is a histogram of at most `capacity` counts. The driver plans on that histogram:

1. lengths above a limit are sorted and cut into groups of equal cardinality, each rounded up to
   its longest member;
2. how many sequences of which configuration of groups are best is a linear programme with one row
   per group, solved by column generation (a knapsack over the groups finds the next column);
   whole numbers of configurations are kept;
3. actual lengths take the places of the rounded ones, all but the last place of a configuration:
   rounding would waste a little there in every sequence, so it stays open as a gap of known size;
4. what is left, for the open places and then the small lengths, goes to the tightest gap that
   fits, longest first.

The plan is a list of placements: pieces of one length with ranks a to b go to sequences s, s+1, ...
at one offset. Tasks number their own pieces of each length, counts per task are summed up, and the
placement is looked up, so pieces are never dealt by length. Nothing on the driver grows with the corpus.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm import bpe
from emberlog.llm.common import free_name, quoted, written

CAPACITY, GROUPS, SMALL = 2048, 64, 1 / 3


@dataclass
class Lot:
    """Like sequences: so many, the gap left, and (length, first rank) of what each holds."""

    bins: int
    gap: int
    items: list[tuple[int, int]]

    def split(self, k: int) -> Lot:
        """Takes the first k sequences off."""
        first = Lot(k, self.gap, list(self.items))
        self.bins -= k
        self.items = [(n, rank + k) for n, rank in self.items]
        return first


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, places per group): the linear programme over whole configurations, its solution rounded down."""
    g = len(sizes)
    columns = [[capacity // s if k == j else 0 for k in range(g)] for j, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    want = np.array(demand, float)
    inverse = np.linalg.inv(basis)
    for step in range(60 * g):
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        x, prices = inverse @ want, np.ones(g) @ inverse
        value, column = knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-4:
            break
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, np.maximum(x, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
        eta = -direction / direction[out]
        eta[out] = 1 / direction[out]
        row = inverse[out].copy()
        inverse += np.outer(np.where(np.arange(g) == out, 0, eta), row)
        inverse[out] = eta[out] * row
    x = np.linalg.solve(basis, want)
    return [(int(t + 1e-6), [int(round(a)) for a in basis[:, j]]) for j, t in enumerate(x) if t >= 1 - 1e-6]


def knapsack(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration within the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = [k for k in range(len(sizes)) if prices[k] > 1e-12]
    own, worth = np.array([sizes[k] for k in order], int), np.array([prices[k] for k in order])
    low = int(own.min()) if len(own) else capacity + 1
    for c in range(low, capacity + 1):
        fits = own <= c
        value = np.where(fits, best[np.maximum(c - own, 0)] + worth, -1)
        k = int(np.argmax(value))
        best[c], choice[c] = (value[k], k) if value[k] > best[c - 1] else (best[c - 1], -1)
    column, c = np.zeros(len(sizes)), capacity
    while c >= low:
        if choice[c] < 0:
            c -= 1
        else:
            column[order[choice[c]]] += 1
            c -= int(own[choice[c]])
    return float(best[capacity]), column


#: Ways to group that are tried: lengths above this share of the capacity are large, and whether the last place stays open.
WAYS = ((SMALL, True), (SMALL / 2, True), (SMALL / 2, False))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Lot]:
    """Packs counts[length] pieces of each length (1 to capacity) into as few sequences as one of WAYS needs."""
    return min((grouped(counts, capacity, groups, *way) for way in WAYS), key=lambda lots: sum(lot.bins for lot in lots))


def grouped(counts: dict[int, int], capacity: int, groups: int, small: float, last_open: bool) -> list[Lot]:
    """One linear grouping: configurations of rounded lengths, actual ones in their places, best fit for the rest."""
    lots = [Lot(counts[capacity], 0, [(capacity, 0)])] if counts.get(capacity) else []
    large = sorted((n for n in counts if small * capacity < n < capacity and counts[n]), reverse=True)
    left = {n: [0, c] for n, c in counts.items() if 0 < n < capacity and c}  # next rank, how many remain
    total = sum(counts[n] for n in large)
    if total:
        sizes, demand, runs = [], [], []  # runs: of each group, [length, count], longest first
        share = -(-total // groups)
        room = 0
        for n in large:
            c = counts[n]
            while c:
                if not room:
                    sizes.append(n)
                    demand.append(0)
                    runs.append([])
                    room = share
                k = min(c, room)
                demand[-1] += k
                runs[-1].append([n, k])
                c, room = c - k, room - k
        sizes, demand, runs = _merged(sizes, demand, runs)
        for times, places in configurations(sizes, demand, capacity):
            slots = [j for j, a in enumerate(places) for _ in range(a)]
            lots += _filled(times, slots[: max(1, len(slots) - last_open)], runs, left, capacity)
    gaps: dict[int, list[Lot]] = {}
    order: list[int] = []

    def offer(lot: Lot) -> None:
        if lot.gap and lot.bins:
            if not gaps.get(lot.gap):
                gaps[lot.gap] = []
                insort(order, lot.gap)
            gaps[lot.gap].append(lot)

    for lot in lots:
        offer(lot)
    for n in sorted(left, reverse=True):
        rank, c = left[n]
        while c:
            at = bisect_left(order, n)
            if at == len(order):
                per = min(capacity // n, c)
                lot = Lot(c // per, capacity - per * n, [(n, rank + k * (c // per)) for k in range(per)])
                rank, c = rank + per * lot.bins, c - per * lot.bins
                lots.append(lot)
            else:
                held = gaps[order[at]]
                lot = held.pop()
                if not held:
                    del gaps[order[at]], order[at]
                if lot.bins > c:
                    rest, lot = lot, lot.split(c)
                    lots.append(lot)
                    offer(rest)
                lot.items.append((n, rank))
                lot.gap -= n
                rank, c = rank + lot.bins, c - lot.bins
            offer(lot)
    return lots


def _merged(sizes, demand, runs):
    """Groups that round to the same length are one."""
    out: list[tuple[int, int, list]] = []
    for s, d, r in zip(sizes, demand, runs, strict=True):
        if out and out[-1][0] == s:
            out[-1] = (s, out[-1][1] + d, out[-1][2] + r)
        else:
            out.append((s, d, r))
    return [list(x) for x in zip(*out, strict=True)]


def _filled(times: int, slots: list[int], runs: list[list], left: dict, capacity: int) -> list[Lot]:
    """So many sequences of one configuration, with actual lengths: a lot for each stretch of equal ones."""
    parts: list[list[tuple[int, int, int]]] = []  # of each slot: (length, first rank, how many)
    for j in slots:
        need, own = times, []
        while need and runs[j]:
            n, have = runs[j][0]
            k = min(need, have)
            own.append((n, left[n][0], k))
            left[n][0] += k
            left[n][1] -= k
            need -= k
            if k == have:
                runs[j].pop(0)
            else:
                runs[j][0][1] -= k
        parts.append(own)
    lots, at = [], 0
    while at < times:
        items, step = [], times - at
        for own in parts:
            seen = 0
            for n, rank, k in own:
                if seen <= at < seen + k:
                    items.append((n, rank + at - seen))
                    step = min(step, seen + k - at)
                    break
                seen += k
        if not items:
            break
        lots.append(Lot(step, capacity - sum(n for n, _ in items), items))
        at += step
    return lots


def placements(lots: list[Lot]) -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), sorted."""
    rows, at = [], 0
    for lot in lots:
        if lot.bins:
            offset = 0
            for n, rank in lot.items:
                rows.append((n, rank, lot.bins, at, offset))
                offset += n
            at += lot.bins
    table = np.array(rows, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def ranks(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The place of each piece among those of its length, after the `seen` ones, which are brought up to date."""
    order = np.argsort(lengths, kind="stable")
    own = lengths[order]
    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, int)
    out = np.empty(len(own), np.int64)
    out[order] = np.arange(len(own)) - np.repeat(starts, np.diff(np.r_[starts, len(own)])) + seen[own]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds sequence_id and offset to rows with a length of 1 to capacity.

    Each task numbers its pieces of a length, and that is written; what stands in the tasks before
    follows from counts by length and task: if pieces travel to their counts, it is by length and
    task, so a frequent length is no burden. Equal pieces are interchangeable. An empty table gives no rows.
    """
    part, nth, first = (free_name(pieces, c) for c in ("part", "nth", "first"))
    columns, schema = pieces.columns, ", ".join(f"{quoted(c)} {t}" for c, t in pieces.dtypes)
    at = columns.index(length)

    def number(batches):
        own, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rank = ranks(batch.column(at).to_numpy().astype(np.int64), seen)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, own), pa.int32()), pa.array(rank, pa.int64())], [*columns, part, nth])

    rows = written(pieces.mapInArrow(number, f"{schema}, {part} int, {nth} long"))
    sizes = written(rows.groupBy(quoted(length), part).agg(F.count("*").alias("n")))
    counts = {r[0]: r[1] for r in sizes.groupBy(quoted(length)).agg(F.sum("n")).collect()}  # at most capacity rows
    before = Window.partitionBy(quoted(length)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(quoted(length), part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    table = placements(plan(counts, capacity))
    keys = table[:, 0] * (1 << 42) + table[:, 1]
    met = rows.join(sizes, [length, part]).select(*(F.col(quoted(c)) for c in columns), (F.col(first) + F.col(nth)).alias(nth))

    def placed(batches):
        for batch in batches:
            n, rank = batch.column(at).to_numpy().astype(np.int64), batch.column(len(columns)).to_numpy()
            row = np.searchsorted(keys, n * (1 << 42) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(table[row, 3] + rank - table[row, 1], pa.int64()), pa.array(table[row, 4], pa.int64())], [*columns, "sequence_id", "offset"])

    return met.mapInArrow(placed, f"{schema}, sequence_id long, offset long")


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text's ids and the end id: doc_id, piece, start, length, ids_crc32 (and ids).

    Only documents longer than the capacity are cut; the first piece may be shorter, the others
    are full. Null or empty text: the end id alone. Repeated rows are packed each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def pieces(batches):
        enc = bpe.encoder(tokenizer)
        for batch in bpe.text_batches(batches):
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a:b].tobytes()
                    rows.append((key, k, a, b - a, zlib.crc32(own), own))
            cols = list(zip(*rows, strict=True))
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names)], names)

    return rows.mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame, ids: Column | str = "ids") -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a sequence holds at most the capacity, so groups are small."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col(ids) if isinstance(ids, str) else ids)))
    return packed.groupBy("sequence_id").agg(F.expr("X''").alias("none"), parts.alias("parts")).select("sequence_id", F.aggregate("parts", F.col("none"), lambda a, p: F.concat(a, p[ids])).alias("ids"))
