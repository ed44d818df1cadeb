"""What the corpus operators share: reading, shared storage, words and hashes over Arrow buffers.

Texts are handled as UTF-8 bytes straight from Arrow buffers, a few MB at a time, so memory does not
depend on the size of a batch. Hashes are polynomial over random 64-bit symbols, taken from running
sums, so that the hash of any span costs two look-ups.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import clear, run_dir, saved, shared_dir  # noqa: F401

#: Bytes of text handled at once; a longer document is handled alone. Arrays over them take up to 100 times as much.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C55
_SYMBOL = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, *carried: str) -> DataFrame:
    """doc_id, text and the carried columns, null texts as empty ones; rows without doc_id name no document and are left out."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *carried)


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def least_hashed(rows: DataFrame, limit: int) -> DataFrame:
    """About `limit` rows, those of the smallest hashes of doc_id (all rows of a doc_id, and all that tie with
    the last). Only hashes are gathered to find the bound."""
    last = rows.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(limit).agg(F.max("h"), F.count("*")).first()
    return rows if last[1] < limit else rows.where(F.xxhash64("doc_id") <= last[0])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        both = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


class Spans:
    """Hashes of any span of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        p, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * p[:-1], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _SYMBOL[data]


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of runs of rows that hold about `limit` bytes. No nulls."""
    a = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    n = len(a)
    if not n:
        return
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + n + 1]
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if a.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, per row, the number of the first (one more at the end)."""
    n = len(data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:n]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(byte_symbols(data)).of(starts, ends)


def release() -> None:
    """Gives freed memory back to the system: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable) -> Callable:
    """run over the batches of a partition, and what it freed given back when it ends."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return over


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each key in a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = column(batch, key)
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, b in zip(cut[:-1], cut[1:]):
            if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 1 << 16) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by key, about `least` rows at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            k = column(batch, key)
            cut = int(np.searchsorted(k, k[-1]))
            if cut:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
                held, n = [batch.slice(cut)], batch.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Groups of the numbers below n."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the smallest id that links lead to.

    Each round takes the least component of the neighbours, then that one's own; tables are written each round."""
    both = saved(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = saved(both.groupBy("a").agg(F.min("b").alias("r")).select("a", F.least("a", "r").alias("r")))
    while True:
        near = both.join(now.select(F.col("a").alias("b"), "r"), "b").groupBy("a").agg(F.min("r").alias("m"))
        step = now.join(near, "a").select("a", F.least("r", "m").alias("r"), F.col("r").alias("was"))
        own = now.select(F.col("a").alias("r"), F.col("r").alias("rr"))
        new = saved(step.join(own, "r", "left").select("a", F.coalesce(F.least("r", "rr"), "r").alias("r"), "was"))
        if not new.where("r <> was").limit(1).count():
            return new.select(F.col("a").alias("id"), F.col("r").alias("component"))
        now = new.select("a", "r")
