"""Token ids in files: one zstandard frame per document, all with one shared dictionary.

A shard holds documents in ascending doc_id order. Layout: frames; then the index (doc_id int64, offset
uint64 with one more at the end, number of ids uint32, each as one array); then a footer with the
number of documents, the place of the index, bytes per id, the dictionary's SHA-256 and a mark. The
dictionary lies beside the shards, named by its hash; manifest.json lists the shards and the number of
ids before each. A document is read with one seek, without its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, least_hashed, parts, shared_dir
from .tokens import encoder, vocabulary

FOOTER = struct.Struct("<QQI32s8s")
MARK = b"LLIDFIL1"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def storage(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class Writer:
    """Writes a shard under another name and moves it into place, so a repeated task leaves one whole file."""

    def __init__(self, uri: str, dictionary: bytes, width: int, level: int = 3):
        self.fs, self.path = storage(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
        self.hash, self.width = hashlib.sha256(dictionary).digest(), width
        self.docs, self.sizes, self.counts = [], [0], []

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        frame = self.compressor.compress(ids.astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.docs.append(doc_id)
        self.sizes.append(len(frame))
        self.counts.append(len(ids))

    def close(self) -> tuple[int, int]:
        offsets = np.cumsum(np.array(self.sizes, dtype="<u8"), dtype="<u8")
        for x in (np.array(self.docs, dtype="<i8"), offsets, np.array(self.counts, dtype="<u4")):
            self.out.write(x.tobytes())
        self.out.write(FOOTER.pack(len(self.docs), int(offsets[-1]), self.width, self.hash, MARK))
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.docs), int(sum(self.counts))


class Reader:
    def __init__(self, uri: str, dictionary: bytes):
        self.fs, path = storage(uri)
        self.file = self.fs.open_input_file(path)
        size = self.file.size()
        n, at, self.width, digest, mark = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if mark != MARK or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard of this dictionary")
        index = self.file.read_at(size - FOOTER.size - at, at)
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 8 * n + 8 * (n + 1))
        self.decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the shard."""
        at, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return np.frombuffer(self.decompressor.decompress(self.file.read_at(end - at, at)), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.doc_ids, doc_id))
        return self.ids(k) if k < len(self.doc_ids) and self.doc_ids[k] == doc_id else None

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(len(self.doc_ids)):
            yield int(self.doc_ids[k]), self.ids(k)


def trained(docs: DataFrame, path: str, width: int, sample: int, size: int) -> bytes:
    """A dictionary from all ids of `sample` documents, those of the smallest hashes of doc_id, in one task. zstandard
    wants many short samples, so long documents are several of them.

    Empty where the sample holds too little to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [t for b in batches for t in b.column(0).to_pylist()]
        own = [raw[i : i + 8192] for x in encoder(path).encode(texts) for raw in [x.astype(f"<u{width}").tobytes()] for i in range(0, len(raw), 8192)]
        try:
            data = zstandard.train_dictionary(size, own).as_bytes()
        except zstandard.ZstdError:
            data = b""
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    chosen = least_hashed(docs, sample).select("text")
    return bytes(chosen.repartition(1).mapInArrow(run, "data binary").first()[0])


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 0, sample: int = 512, dictionary_size: int = 1 << 16, level: int = 3) -> str:
    """Writes all docs and returns the folder. Null texts are empty; rows without doc_id are left out.

    `sample` bounds the documents that the dictionary is trained on and nothing else. The driver sees one
    row per shard. Rows with equal doc_id stand side by side, in an order fixed by their texts. An empty table
    gives files without documents; other columns are not read.
    """
    spark = docs.sparkSession
    path = path or vocabulary("byte_bpe_50k.json")
    folder = folder or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    docs = id_text(docs)
    width = 2 if encoder(path).library.get_vocab_size() <= 1 << 16 else 4
    dictionary = trained(docs, path, width, sample, dictionary_size)
    fs, at = storage(folder)
    fs.create_dir(at, recursive=True)
    digest = hashlib.sha256(dictionary).hexdigest()
    with fs.open_output_stream(f"{at}/{digest}.dictionary") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).column
        shard = TaskContext.get().partitionId()
        out = Writer(f"{folder}/{shard:08d}.ids", shared.value, width, level)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part)):
                    out.add(doc, np.append(ids, np.uint32(end_id)))
        n, total = out.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n]), pa.array([total])], names=["shard", "docs", "ids"])

    ordered = docs.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards, before = [], 0
    for shard, n, total in sorted(map(tuple, ordered.mapInArrow(run, "shard long, docs long, ids long").collect())):
        shards.append({"file": f"{shard:08d}.ids", "docs": n, "ids": total, "start": before})
        before += total
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(json.dumps({"dictionary": digest, "width": width, "end_id": end_id, "ids": before, "shards": shards}).encode())
    return folder


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if with_ids, ids."""
    fs, at = storage(folder)
    manifest = json.loads(fs.open_input_file(f"{at}/manifest.json").readall())
    digest = manifest["dictionary"]
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        dictionary = fs.open_input_file(f"{at}/{digest}.dictionary").readall()
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for doc, ids in Reader(f"{folder}/{name}", dictionary):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] * with_ids)))
                    start += len(ids)
                    if len(rows) >= 4096:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    shards = [(x["file"], x["start"]) for x in manifest["shards"] if x["docs"]]
    schema = SCHEMA + ", ids array<int>" * with_ids
    if not shards:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(shards, "file string, start long").repartitionByRange(min(len(shards), max(1, parts(spark))), "file")
    return files.mapInArrow(run, schema)
