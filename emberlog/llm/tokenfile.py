"""Token-id files in bit or byte planes.

A file holds the ids of documents in order. Ids are cut into blocks of a fixed size; a block is
transposed, so that plane p holds byte p (or bit p) of every id, and each plane is compressed with
zstandard on its own: planes of high bits are almost constant and shrink to nothing. Document keys
and lengths are stored the same way. A chunk index at the end names the place and the size of every
plane, so that a reader can fetch any range of ids.

    "EMBERPL1" | planes of block 0 | planes of block 1 | ... | planes of keys and lengths | index | index length | "EMBERPL1"

The index is JSON: plane kind, ids per block, blocks [offset, ids, sizes of planes], documents likewise.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm import bpe
from emberlog.llm.common import range_buckets, shared_folder, text_or_empty, written

MAGIC = b"EMBERPL1"
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 26


def to_planes(values: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Byte planes of little-endian values, or bit planes, lowest first."""
    width = values.dtype.itemsize
    rows = np.ascontiguousarray(values, values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, width)
    if kind == "byte":
        return [rows[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, dtype: str, kind: str = "byte") -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if n else np.zeros((0, width), np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1) if n else np.zeros((0, 8 * width), np.uint8)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(dtype).reshape(-1)


class TokenFileWriter:
    """Appends documents to an open binary stream; holds one block at a time."""

    def __init__(self, out, kind: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        self.out, self.kind, self.block_ids, self.zip = out, kind, block_ids, zstandard.ZstdCompressor(level=level)
        self.at, self.n_ids, self.n_docs = 0, 0, 0
        self.blocks: list[list] = []
        self.doc_blocks: list[list] = []
        self.held: list[np.ndarray] = []
        self.held_n = 0
        self.keys: list[int] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _chunk(self, values: np.ndarray) -> list:
        start, planes = self.at, [self.zip.compress(p) for p in to_planes(values, self.kind)]
        for p in planes:
            self._put(p)
        return [start, len(values), [len(p) for p in planes]]

    def append(self, key: int, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.n_docs += 1
        self.held.append(ids)
        self.held_n += len(ids)
        if self.held_n >= self.block_ids:
            ids = np.concatenate(self.held)
            whole = len(ids) - len(ids) % self.block_ids
            for k in range(0, whole, self.block_ids):
                self.blocks.append(self._chunk(ids[k : k + self.block_ids].astype("<u4")))
            self.held, self.held_n = [ids[whole:]], len(ids) - whole
        if len(self.keys) >= self.block_ids:
            self._documents()

    def _documents(self) -> None:
        if self.keys:
            self.doc_blocks.append([self._chunk(np.array(self.keys, "<i8")), self._chunk(np.array(self.lengths, "<i8"))])
            self.keys, self.lengths = [], []

    def close(self) -> None:
        if self.held_n:
            self.blocks.append(self._chunk(np.concatenate(self.held).astype("<u4")))
        self._documents()
        index = json.dumps({"planes": self.kind, "block_ids": self.block_ids, "ids": self.n_ids, "blocks": self.blocks, "documents": self.doc_blocks}).encode()
        self._put(index)
        self._put(len(index).to_bytes(8, "little") + MAGIC)


class TokenFileReader:
    """Reads a file from a seekable binary stream, block by block."""

    def __init__(self, source):
        self.source, self.zip = source, zstandard.ZstdDecompressor()
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(tail[:8], "little")
        source.seek(end - 16 - size)
        self.index = json.loads(source.read(size))

    def _chunk(self, entry: list, dtype: str) -> np.ndarray:
        start, n, sizes = entry
        self.source.seek(start)
        data, planes, at = self.source.read(sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.zip.decompress(data[at : at + size]))
            at += size
        return from_planes(planes, n, dtype, self.index["planes"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the file, through the chunk index."""
        step = self.index["block_ids"]
        parts = [self._chunk(self.index["blocks"][k], "<u4") for k in range(start // step, -(-min(stop, self.index["ids"]) // step))] if stop > start else []
        return np.concatenate(parts)[start % step :][: stop - start] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        blocks = iter(self.index["blocks"])
        held = np.zeros(0, "<u4")
        for keys, lengths in self.index["documents"]:
            for key, n in zip(self._chunk(keys, "<i8").tolist(), self._chunk(lengths, "<i8").tolist(), strict=True):
                if len(held) < n:
                    parts, have = [held], len(held)
                    while have < n:
                        parts.append(self._chunk(next(blocks), "<u4"))
                        have += len(parts[-1])
                    held = np.concatenate(parts)
                yield key, held[:n]
                held = held[n:]


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, kind: str = "byte", block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every whole text and an end id, in ascending doc_id order; gives the manifest of files.

    Manifest: bucket, part, path, n_docs, n_ids; order (bucket, part) is the order of ids. Files go
    below `folder` (the shared folder by default). A task that is run again writes files of other
    names, and only files in the manifest count. Null text: only the end id. A null doc_id is
    stored as the smallest number. Repeated rows are stored each. An empty table gives no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    bucket, n = range_buckets(docs, "doc_id")
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), bucket.alias("bucket"), text_or_empty().alias("text"))

    def encoded(batches):
        enc = bpe.encoder(tokenizer)
        small = enc.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16
        for batch in bpe.text_batches(batches):
            ids = [x.astype("<u2" if small else "<u4").tobytes() for x in enc.encode_all(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([small] * len(ids)), pa.array(ids, pa.binary())], ["doc_id", "bucket", "small", "ids"])

    def files(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        writer = out = name = None
        bucket, part, made = None, 0, []

        def done():
            writer.close()
            out.close()
            made.append((bucket, part, name, writer.n_docs, writer.n_ids))

        for batch in batches:
            for key, b, small, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None or b != bucket or writer.n_ids >= file_ids:
                    if writer is not None:
                        done()
                    part = part + 1 if b == bucket else 0
                    bucket, name = b, f"{b:07d}-{part:05d}-{uuid.uuid4().hex}.planes"
                    out = store.open_output_stream(f"{base}/{name}")
                    writer = TokenFileWriter(out, kind, block_ids)
                writer.append(key, np.append(np.frombuffer(ids, "<u2" if small else "<u4").astype("<u4"), np.uint32(end_id)))
        if writer is not None:
            done()
        cols = list(zip(*made, strict=True)) if made else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array([f"{folder}/{x}" for x in cols[2]], pa.string()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["bucket", "part", "path", "n_docs", "n_ids"])

    placed = rows.mapInArrow(encoded, "doc_id long, bucket int, small boolean, ids binary").repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "ids")
    return written(placed.mapInArrow(files, "bucket int, part int, path string, n_docs long, n_ids long"))


def read(spark: SparkSession, manifest: DataFrame, fold, schema: str) -> DataFrame:
    """Reads the files of a manifest: fold(start, documents) yields Arrow batches for each file; start counts the ids of all files before."""
    totals = {r.bucket: r.n for r in manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}  # as many as range buckets
    starts, at = [], 0
    for b in sorted(totals):
        starts.append((b, at))
        at += totals[b]
    within = Window.partitionBy("bucket").orderBy("part")
    base = spark.createDataFrame(starts or [(0, 0)], "bucket int, base long")
    files = manifest.withColumn("before", F.sum("n_ids").over(within) - F.col("n_ids")).join(F.broadcast(base), "bucket").select("path", (F.col("base") + F.col("before")).alias("start"))

    def folded(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    yield from fold(start, TokenFileReader(source).documents())

    return files.repartition(max(1, len(totals)), "path").mapInArrow(folded, schema)


def summary(start: int, documents: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Of each document in a file: key, ids before it, ids, checksum."""
    rows: list[tuple] = []

    def batch():
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([None if k == -(1 << 63) else k for k in cols[0]], pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    for key, ids in documents:
        rows.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
        if len(rows) >= 8192:
            yield batch()
            rows.clear()
    if rows:
        yield batch()
