"""Language-model scores by context-tree weighting over bytes.

The model's text is the document's lower-cased words with one space between them and an end mark. A byte is
eight binary decisions; each decision, given those before it in its byte, has a context tree of its own over
the `DEPTH` bytes before. A node's counts have a Krichevsky-Trofimov probability Pe; its weighted
probability is Pw = (Pe + product of its children's Pw) / 2, and Pe at full depth. The predictive probability
mixes all depths: at each node Pe / (2 Pw) of the node's own estimate, the rest from the node one byte
deeper. A node without counts is like any other: it says one half.

A byte's probability depends on the run of it and the DEPTH bytes before alone. So each group of documents
(what one task wrote) hands in its distinct runs, with their counts in training texts; trees are built where
runs with the same two nearest bytes meet, below which they are independent, and every run's score goes back
to the groups that asked for it, as a table in the shared folder. Words and their counts travel the same way.
Nothing but the nodes of depth 0 and 1 (at most 65 535) is sent to all tasks. Scores are whole numbers of
2 ** -24, so sums do not depend on how rows lie.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, id_text, lowered, mixed, parts, release, run_dir, runs as whole_groups, saved, signed, text_chunks, word_hashes, word_spans
from .idfile import storage
from .toxicity import held_out

#: Context bytes; runs that are taken together in a tree (more only if they share the two nearest bytes).
DEPTH, BLOCK = 5, 200_000
END, GRAMS, WORDS = 10, 0, 1
#: Units of a score and of a word's logarithm.
UNIT, WORD_UNIT = 2.0**24, 2.0**32
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8.0
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    for k in range(8):
        out -= np.log(x + k)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a string of n0 zeros and n1 ones."""
    n = n0 + n1
    out = np.where(n == 1, HALF, 0.0)
    some = np.flatnonzero(n > 1)
    a, b = n0[some], n1[some]
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - np.log(np.pi)
    return out


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte runs (the nearest of DEPTH before first, last the byte itself) of the model's texts, the first of each row, hashes of the words and the first of each row.

    Before a text stand zero bytes."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = np.diff(first)
    size = ends - starts + 1
    row = np.repeat(np.arange(len(words)), words)
    length = np.bincount(row, size, len(words)).astype(np.int64)
    length[words == 0] = 1
    begin = np.cumsum(length + DEPTH) - length
    out = np.full(int(length.sum()) + DEPTH * len(words), 32, np.uint64)
    if len(starts):
        to = begin[row] + (np.cumsum(size) - size) - np.repeat((np.cumsum(size) - size)[first[:-1][words > 0]], words[words > 0])
        n = size - 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to, n) + at] = data[np.repeat(starts, n) + at]
    out[begin + length - 1] = END
    pad = (begin[:, None] - 1 - np.arange(DEPTH)[None, :]).ravel()
    out[pad] = 0
    runs = np.zeros(len(out) - DEPTH, np.uint64)
    for k in (*range(DEPTH - 1, -1, -1), DEPTH):
        runs = (runs << np.uint64(8)) | out[k : len(out) - DEPTH + k]
    real = np.ones(len(out), bool)
    real[pad] = False
    return runs[real[DEPTH:]], np.cumsum(length) - length, word_hashes(data, starts, ends), first


class Tally:
    """Counts of 64-bit keys; a count may be 0."""

    def __init__(self):
        self.keys, self.counts, self.size, self.limit = [], [], 0, 1_000_000

    def add(self, keys: np.ndarray, counted: bool = True) -> None:
        if not len(keys):
            return
        keys, counts = np.unique(keys, return_counts=True)
        self.merged(keys, counts.astype(np.int64) * counted)

    def merged(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size > self.limit and len(self.keys) > 8:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        keys, counts = keys[head], np.add.reduceat(counts, head)
        self.keys, self.counts, self.size = [keys], [counts], 0
        self.limit = max(1_000_000, len(keys) // 2)
        return keys, counts


def squeezed(x: np.ndarray) -> bytes:
    """An array as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def restored(data: bytes, kind) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return squeezed(np.diff(keys, prepend=np.uint64(0)))


def restored_keys(data: bytes) -> np.ndarray:
    return np.cumsum(restored(data, np.uint64), dtype=np.uint64)


def nearest(runs: np.ndarray) -> np.ndarray:
    """The two nearest context bytes of byte runs."""
    return runs >> np.uint64(8 * (DEPTH - 1))


def grouped_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the number of the task that writes them."""
    task = TaskContext.get()
    g = task.partitionId() if task else 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, g, np.int32))], names=[*batch.schema.names, "g"])


def same_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        g = column(batch, "g")
        cut = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(cut[:-1], cut[1:]):
            if b > a:
                yield int(g[a]), batch.slice(a, b - a)


def gathered(p: int):
    """The distinct byte runs and words of each group of documents with their counts in training texts, a row for each kind and part."""

    def rows(g: int, tallies) -> Iterator[pa.RecordBatch]:
        for kind, tally in zip((GRAMS, WORDS), tallies):
            keys, counts = tally.merge()
            part = (mixed(nearest(keys) if kind == GRAMS else keys) % np.uint64(p)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(p + 1))
            out = [(kind, k, g, squeezed_keys(keys[order[a:b]]), squeezed(counts[order[a:b]])) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["kind", "part", "g", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tallies = None, (Tally(), Tally())
        for g, batch in same_group(batches):
            if now is not None and g != now:
                yield from rows(now, tallies)
                tallies = (Tally(), Tally())
            now = g
            learns = column(batch, "train")
            for i, j, data, offsets in text_chunks(batch, limit=1 << 20):
                found, begin, words, first = stream(data, offsets)
                for tally, keys, size in ((tallies[0], found, np.diff(np.append(begin, len(found)))), (tallies[1], words, np.diff(first))):
                    of = np.repeat(learns[i:j], size)
                    tally.add(keys[of])
                    tally.add(keys[~of], False)
            release()
        if now is not None:
            yield from rows(now, tallies)

    return run


def added(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    tally = Tally()
    for k, c in zip(rows["keys"], rows["counts"]):
        tally.merged(restored_keys(k.as_py()), restored(c.as_py(), np.int64))
    return tally.merge()


def up(key: np.ndarray) -> np.ndarray:
    """The key of a node's parent. Keys are context bytes, the nearest first, over an 8-bit place in the byte's tree."""
    return ((key >> np.uint64(16)) << np.uint64(8)) | (key & np.uint64(255))


def parents(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, pw: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nodes one byte nearer: keys, counts, log Pw, weight of the own estimate, and for each child its parent's number."""
    above = up(key)
    order = np.argsort(above, kind="stable")
    above = above[order]
    new = np.r_[True, above[1:] != above[:-1]]
    head = np.flatnonzero(new)
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1
    n0, n1 = np.add.reduceat(n0[order], head), np.add.reduceat(n1[order], head)
    own = HALF + log_kt(n0, n1)
    both = np.logaddexp(own, HALF + np.add.reduceat(pw[order], head))
    return above[head], n0, n1, both, np.exp(np.minimum(own - both, 0)), of


def blocks(runs: np.ndarray) -> Iterator[slice]:
    """Runs in ascending order, a few whole two-byte contexts at a time."""
    near = nearest(runs)
    cut = np.append(np.flatnonzero(np.r_[True, near[1:] != near[:-1]]), len(runs))
    a = 0
    while a < len(runs):
        b = int(cut[min(np.searchsorted(cut, a + BLOCK), len(cut) - 1)])
        yield slice(a, b)
        a = b


def leaves(runs: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, ...]:
    """Nodes of full depth for the j-th bit: keys, counts; for each run its node and its bit."""
    path = runs >> np.uint64(8 - j)
    new = np.r_[True, path[1:] != path[:-1]]
    head = np.flatnonzero(new)
    bit = ((runs >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
    place = (np.uint64(1) << np.uint64(j)) | (path[head] & np.uint64((1 << j) - 1))
    key = ((path[head] >> np.uint64(j)) << np.uint64(8)) | place
    return key, np.add.reduceat(np.where(bit, 0, counts), head), np.add.reduceat(np.where(bit, counts, 0), head), np.cumsum(new) - 1, bit


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 2 with counts and log Pw, those that were met in training."""
    for rows in whole_groups(batches, "part"):
        runs, counts = added(rows)
        for s in blocks(runs):
            for j in range(8):
                key, n0, n1, _, _ = leaves(runs[s], counts[s], j)
                pw = log_kt(n0, n1)
                for _ in range(DEPTH - 2):
                    key, n0, n1, pw, _, _ = parents(key, n0, n1, pw)
                met = n0 + n1 > 0
                yield pa.RecordBatch.from_arrays([pa.array(signed(key[met])), pa.array(n0[met]), pa.array(n1[met]), pa.array(pw[met]), pa.array((key[met] >> np.uint64(16)).astype(np.int32))], names=["node", "n0", "n1", "pw", "near"])


def raised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of depth 1 from all of depth 2 with the same nearest byte; rows are sorted by node."""
    for rows in whole_groups(batches, "near"):
        key, n0, n1, pw, w, _ = parents(rows["node"].to_numpy().view(np.uint64), *(rows[c].to_numpy() for c in ("n0", "n1", "pw")))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(n0), pa.array(n1), pa.array(pw), pa.array(w)], names=["node", "n0", "n1", "pw", "w"])


def own_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1.0)


def scored(upper):
    """For each group the scores of its runs. upper: sorted keys, weights and estimates of depths 1 and 0."""

    def ones(key: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        """The probability of a one at each node of full depth, mixed over all depths."""
        p, pw, to = own_estimate(n0, n1), log_kt(n0, n1), np.arange(len(key))
        for _ in range(DEPTH - 2):
            key, n0, n1, pw, w, of = parents(key, n0, n1, pw)
            to = of[to]
            p = (w * own_estimate(n0, n1))[to] + (1 - w)[to] * p
        for keys, w, own in upper.value:
            key = up(key)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            met = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            w_, own_ = (np.where(met, x[at], 0.5) if len(keys) else np.full(len(key), 0.5) for x in (w, own))
            p = (w_ * own_)[to] + (1 - w_)[to] * p
        return p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, "part"):
            runs, counts = added(rows)
            value = np.zeros(len(runs), np.int32)
            for s in blocks(runs):
                total = np.zeros(s.stop - s.start)
                for j in range(8):
                    key, n0, n1, of, bit = leaves(runs[s], counts[s], j)
                    p = ones(key, n0, n1)[of]
                    total += np.log10(np.where(bit, p, 1 - p))
                value[s] = np.rint(total * UNIT)
            yield from answers(rows, runs, value, GRAMS)
            release()

    return run


def answers(rows: pa.Table, keys: np.ndarray, value: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for g, own in zip(rows["g"].to_pylist(), rows["keys"]):
        own = own.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([kind], pa.int32()), pa.array([own], pa.binary()), pa.array([squeezed(value[np.searchsorted(keys, restored_keys(own))])], pa.binary())], names=["g", "kind", "keys", "value"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each group the counts of its words in training."""
    for rows in whole_groups(batches, "part"):
        yield from answers(rows, *added(rows), WORDS)


def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, "part"):
        counts = added(rows)[1]
        yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())]), pa.array([int((counts > 0).sum())])], names=["n", "distinct"])


def written(folder: str):
    """A file for each group: its parts' keys and values, as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = storage(folder)
        for rows in whole_groups(batches, "g", 1):
            for g in np.unique(rows["g"].to_numpy()).tolist():
                own = rows.filter(pa.compute.equal(rows["g"], g))
                part = f"{at}/{g}.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f, pa.ipc.new_stream(f, own.schema) as out:
                    out.write_table(own)
                fs.move(part, f"{at}/{g}.scores")
                yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32())], names=["g"])

    return run


class Lookup:
    """Values of known 64-bit keys: one slot by hash each, those whose slot is taken in a sorted list."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        self.keys, self.values = np.full(1 << bits, np.uint64(2**64 - 1)), np.zeros(1 << bits, values.dtype)
        self.keys[slot], self.values[slot] = keys, values
        rest = np.flatnonzero(self.keys[slot] != keys)
        rest = rest[np.argsort(keys[rest])]
        self.rest, self.rest_values = keys[rest], values[rest]

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = (mixed(keys) >> self.shift).astype(np.int64)
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != keys)
        if len(miss):
            at = np.searchsorted(self.rest, keys[miss])
            if not len(self.rest) or at.max() >= len(self.rest) or (self.rest[at] != keys[miss]).any():
                raise ValueError("a run or word was not handed in")
            out[miss] = self.rest_values[at]
        return out


def lookups(folder: str, g: int) -> tuple[Lookup, Lookup]:
    fs, at = storage(folder)
    with fs.open_input_stream(f"{at}/{g}.scores") as f:
        rows = pa.ipc.open_stream(f).read_all()
    out = []
    for kind, dtype in ((GRAMS, np.int32), (WORDS, np.int64)):
        own = rows.filter(pa.compute.equal(rows["kind"], kind))
        keys = [restored_keys(x.as_py()) for x in own["keys"]]
        values = [restored(x.as_py(), dtype) for x in own["value"]]
        out.append(Lookup(np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, dtype), *values])))
    return out[0], out[1]


def summed(folder: str):
    """For each row its tokens, known words, the logarithms of their counts, score and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for g, batch in same_group(batches):
            if g != now:
                scores = counts = None
                (scores, counts), now = lookups(folder, g), g
            for i, j, data, offsets in text_chunks(batch, limit=1 << 20):
                runs, begin, words, first = stream(data, offsets)
                c, rows = counts.of(words), j - i
                known, base = (np.r_[0, np.cumsum(x)] for x in (c > 0, np.rint(np.log10(c + 1.0) * WORD_UNIT).astype(np.int64)))
                out = [np.diff(first) + 1, np.diff(known[first]), np.diff(base[first]), np.add.reduceat(scores.of(runs), begin, dtype=np.int64), np.diff(np.append(begin, len(runs)))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, rows), *(pa.array(x.astype(np.int64)) for x in out)], names=["doc_id", "n_tokens", "n_known", "base", "score", "n_bytes"])
            release()

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Null texts are empty: one token, the end. Learns from documents whose crc32(doc_id as text) mod 7 is not
    2. Rows with equal doc_id are one document of several texts: their counts and scores are added. Rows
    without doc_id are left out, an empty table gives no rows; without training documents every bit of a
    byte has probability one half. Other columns are not read.
    """
    spark = docs.sparkSession
    p = parts(spark)
    given = id_text(docs).withColumn("train", ~held_out(7, 2))
    docs = saved(given.mapInArrow(grouped_rows, "doc_id long, text string, train boolean, g int"))
    tallies = saved(docs.mapInArrow(gathered(p), "kind int, part int, g int, keys binary, counts binary"))

    def met(kind: int) -> DataFrame:
        return tallies.where(F.col("kind") == kind).select("part", "g", "keys", "counts").repartition(p, "part").sortWithinPartitions("part", "g")

    second = saved(met(GRAMS).mapInArrow(summaries, "node long, n0 long, n1 long, pw double, near int"))
    # at most 256 x 255 nodes of depth 1, from which those of depth 0 follow
    top = second.repartition(p, "near").sortWithinPartitions("near", "node").mapInArrow(raised, "node long, n0 long, n1 long, pw double, w double").orderBy("node").toArrow()
    key, n0, n1, pw, w = top["node"].to_numpy().view(np.uint64), *(top[c].to_numpy() for c in ("n0", "n1", "pw", "w"))
    upper = [(key, w, own_estimate(n0, n1))]
    if len(key):
        key, n0, n1, pw, w, _ = parents(key, n0, n1, pw)
        upper.append((key, w, own_estimate(n0, n1)))
    else:
        upper.append(upper[0])
    shared = spark.sparkContext.broadcast(upper)
    n, distinct = met(WORDS).mapInArrow(totals, "n long, distinct long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = docs.where("train").count()
    total, distinct = n + ends, distinct + (ends > 0)
    back = "g int, kind int, keys binary, value binary"
    folder = f"{run_dir(spark)}/scores-{uuid.uuid4().hex}"
    fs, at = storage(folder)
    fs.create_dir(at, recursive=True)
    found = met(GRAMS).mapInArrow(scored(shared), back).union(met(WORDS).mapInArrow(counted, back))
    found.repartition(p, "g").sortWithinPartitions("g").mapInArrow(written(folder), "g int").count()
    rows = docs.mapInArrow(summed(folder), "doc_id long, n_tokens long, n_known long, base long, score long, n_bytes long")
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("texts"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score", "n_bytes")))
    # every text has one end, and in training it was met once for each document
    points = F.col("score") / F.lit(UNIT)
    return sums.select(
        "doc_id", held_out(7, 2).alias("held_out"), "n_tokens",
        (F.col("n_known") + (F.col("texts") if ends else F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") / F.lit(WORD_UNIT) + F.col("texts") * float(np.log10(ends + 1.0)) - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        points.alias("score"), "n_bytes", (-points / float(np.log10(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
