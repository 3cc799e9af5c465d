"""What the operators of this subpackage share: tables, the shared folder, words."""

from __future__ import annotations

import atexit
import ctypes
import math
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="emberlog-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/emberlog-{uuid.uuid4().hex}"


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: lineage ends there and a lost executor loses nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as Spark's parser takes it, dots and back ticks included."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space. bytes.split() cuts at exactly x20 and x09 to x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


#: Words whose hashes a worker remembers.
WORDS = 50_000


class _Words(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        own = self[word] = xxhash.xxh3_64_intdigest(word)
        return own


#: The hash of a word, in a table that all operators of a worker share.
word_hash = _Words().__getitem__


def give_back() -> None:
    """Returns freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_buckets(df: DataFrame, key: str, n: int | None = None) -> tuple[Column, int]:
    """An expression for the key's range, 0 to n-1 in ascending order, and n; ranges hold about equally many rows.

    Only the key column is read. Equal keys share a range; a null key sorts first, into range 0.
    A row looks at about twice the square root of the cut points: first at one of each block of them, then at its block.
    """
    n = n or partitions(df.sparkSession)
    shares = [k / n for k in range(1, n)]
    cuts = (df.agg(F.percentile_approx(key, shares, 10000)).first()[0] if shares else None) or []
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0), 1
    below = lambda some: F.aggregate(some, F.lit(0), lambda k, c: k + F.when(F.col(key) > c, 1).otherwise(0))
    width = math.isqrt(len(cuts) - 1) + 1
    before = below(F.array(*map(F.lit, cuts[::width]))) * width - width  # cut points in front of the key's block
    inside = below(F.slice(F.array(*map(F.lit, cuts)), F.greatest(before, F.lit(0)) + 1, F.lit(width)))
    return F.when(before < 0, 0).otherwise(before + inside).cast("int"), len(cuts) + 1


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits of a filter's block.
FILTER_BLOCK = 1 << 16


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


class KeyFilter:
    """A blocked Bloom filter of 64-bit keys: no key that was put in is missed; of others a few pass."""

    def __init__(self, blocks: int):
        self.bits = np.zeros((blocks, FILTER_BLOCK // 8), np.uint8)

    @staticmethod
    def places(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each key, and three bits there."""
        with np.errstate(over="ignore"):
            own = mixed(keys.view(np.uint64) + _MIX[0])
            inside = mixed(own + _MIX[0])
        return (own % np.uint64(blocks)).astype(np.int64), np.stack([((inside >> np.uint64(16 * k)) % np.uint64(FILTER_BLOCK)).astype(np.int64) for k in range(3)])

    def __contains__(self, key: int) -> bool:
        return bool(self.known(np.array([key], np.int64))[0])

    def known(self, keys: np.ndarray) -> np.ndarray:
        block, bit = self.places(keys, len(self.bits))
        return ((self.bits[block, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def key_filter(keys: DataFrame, per_key: int = 16, most_bytes: int = 32 << 20) -> KeyFilter:
    """The filter of a table's first column (64-bit keys), with so many bits for each counted row, and no more than most_bytes.

    Rows are dealt by block, so each task makes whole blocks, and the driver receives no more than
    the filter. Beyond the bound more keys pass that were not put in: that costs time, no result.
    """
    name, n = keys.columns[0], keys.count()
    blocks = 1
    while blocks * FILTER_BLOCK < per_key * n and blocks * FILTER_BLOCK < 8 * most_bytes:
        blocks *= 2
    found = KeyFilter(blocks)

    def dealt(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(KeyFilter.places(batch.column(0).to_numpy(), blocks)[0]), batch.column(0)], ["block", "key"])

    def marked(batches):
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = KeyFilter.places(batch.column(1).to_numpy(), blocks)
            for b in np.unique(block).tolist():
                at = bit[:, block == b].ravel()
                np.bitwise_or.at(own.setdefault(b, np.zeros(FILTER_BLOCK // 8, np.uint8)), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for b, bits in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    rows = keys.select(F.col(name).cast("long").alias("key")).mapInArrow(dealt, "block long, key long").repartition(partitions(keys.sparkSession), "block")
    for row in rows.mapInArrow(marked, "block long, bits binary").collect():
        found.bits[row.block] |= np.frombuffer(row.bits, np.uint8)
    return found
