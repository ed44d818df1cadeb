"""Harmonic packing of token ids into sequences of one capacity.

A piece of length l belongs to class j = capacity // l, and a bin of class j takes exactly j pieces of
that class. Bins are filled by each worker for itself while it reads its rows; nothing is shuffled.
Documents are cut into whole sequences, then powers of two down to `least` (which fill the bins of
their classes without a gap), then a tail. What a worker has left when its rows end is laid largest
first into few last bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_text, tidy
from .tokens import encoder, vocabulary

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


def cuts(n: int, capacity: int = 1024, least: int = 32) -> list[int]:
    """Lengths of the pieces of n tokens, in order; they sum to n."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity
    while size > least:
        size //= 2
        while size >= least and rest >= size:
            out.append(size)
            rest -= size
    return out + [rest] * (rest > 0)


def padded(length: int, capacity: int) -> int:
    return length if length & (length - 1) == 0 else capacity


class Bins:
    """Open bins by class; `put` and `close` return full bins, lists of pieces (length, anything)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: dict[int, list] = {}

    def put(self, length: int, piece) -> list | None:
        j = self.capacity // length
        held = self.open.setdefault(j, [])
        held.append((length, piece))
        return self.open.pop(j) if len(held) == j else None

    def close(self) -> list[list]:
        bins: list[list] = []
        room: list[int] = []
        for length, piece in sorted((x for held in self.open.values() for x in held), key=lambda x: -x[0]):
            k = next((i for i, r in enumerate(room) if r >= length), len(bins))
            if k == len(bins):
                bins.append([])
                room.append(self.capacity)
            bins[k].append((length, piece))
            room[k] -= length
        self.open.clear()
        return bins


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0, least: int = 32, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length
    and, if with_ids, ids (array<int>).

    Null and empty texts have the end id alone. Rows without doc_id are left out; repeated rows are packed
    each for itself. An empty table gives no rows. Other columns of docs are not read.
    """
    path = path or vocabulary("byte_bpe_50k.json")
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = Bins(capacity), TaskContext.get()
        number = (task.partitionId() if task else 0) << 40
        done: list[list] = []

        def rows() -> pa.RecordBatch:
            nonlocal number
            out: list[tuple] = []
            for pieces in done:
                at, full = 0, padded(sum(n for n, _ in pieces), capacity)
                for n, (doc, start, ids, total) in pieces:
                    out.append((doc, start, n, zlib.crc32(ids), total, number, at, full, *([np.frombuffer(ids, "<u4").astype(np.int32)] * with_ids)))
                    at += n
                number += 1
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

        encode = encoder(path).column
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part)):
                    ids = ids.tobytes() + end
                    total, start = len(ids) // 4, 0
                    for n in cuts(total, capacity, least):
                        full = bins.put(n, (doc, start, ids[4 * start : 4 * (start + n)], total))
                        if full:
                            done.append(full)
                        start += n
                yield rows()
        done.extend(bins.close())
        yield rows()

    return id_text(docs).mapInArrow(tidy(run), SCHEMA + ", ids array<int>" * with_ids)
