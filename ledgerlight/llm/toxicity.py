"""Toxic sentences from document labels: multiple-instance learning with noisy-or.

A sentence is toxic with probability p = sigmoid(b + sum of its words' weights); a document is toxic
unless every one of its sentences is clean: P = 1 - prod(1 - p). Weights are fitted on document labels
by gradient ascent on the likelihood of P, so the sentences' own scores come from document labels alone.
Words and their beginnings, lower-cased and hashed, are what has weights; a text's words are its only inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Spans, byte_symbols, id_text, least_hashed, lowered, mixed, release, text_chunks, tidy, word_spans

#: Weights; words share one where their hashes meet. Lengths in bytes of the beginnings that have weights of their own.
BITS, STEMS = 18, (4, 5, 6)
#: A sentence's log-odds where nothing has been learned.
PRIOR = -8.0
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, worst_score double, worst_start long, worst_end long"
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "\"'()[]{}<>,;:.!?*_-"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def held_out(modulus: int, rest: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and beginnings; the sentence of each; the row of each sentence and its first and last byte.

    A sentence ends with a word that ends in . ! ? or before a line end. Points around words are left off.
    Rows without words have no sentence."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, z, z
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = _STOP[data[ends - 1]]
    stop[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (row[1:] != row[:-1])
    head = np.flatnonzero(np.r_[True, stop[:-1]])
    a, b = starts.copy(), ends.copy()
    for _ in range(3):
        a += (a < b - 1) & _EDGE[data[a]]
        b -= (b > a + 1) & _EDGE[data[b - 1]]
    spans = Spans(byte_symbols(data))
    own = np.cumsum(np.r_[False, stop[:-1]])
    hashes, sentences = [spans.of(a, b)], [own]
    for k in STEMS:
        longer = np.flatnonzero(b - a > k)
        hashes.append(mixed(spans.of(a[longer], a[longer] + k) + np.uint64(k)))
        sentences.append(own[longer])
    last = np.r_[head[1:], len(starts)] - 1
    word = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return word, np.concatenate(sentences), row[head], starts[head] - offsets[row[head]], ends[last] - offsets[row[head]]


def sentence_log_clean(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))"""
    return -np.logaddexp(0, z)


def telling(texts: list[pa.RecordBatch], labels: list[np.ndarray], least_z: float) -> np.ndarray:
    """Which words stand in toxic documents more or less often than chance has it, by a z of two shares."""
    size = 1 << BITS
    a, b, n1, n0 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for batch, y in zip(texts, labels):
        n1, n0 = n1 + y.sum(), n0 + len(y) - y.sum()
        for i, _, data, offsets in text_chunks(batch):
            word, own, row, *_ = sentence_words(data, offsets)
            pair = np.unique(row[own] * size + word)
            toxic = y[i + (pair >> BITS)]
            a += np.bincount(pair % size, toxic, size)
            b += np.bincount(pair % size, 1 - toxic, size)
    n1, n0 = max(n1, 1), max(n0, 1)
    share = (a + b + 1) / (n1 + n0 + 2)
    z = ((a + share) / (n1 + 1) - (b + share) / (n0 + 1)) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (np.abs(z) >= least_z) & (a + b >= 2)


def fitted(batches: Iterator[pa.RecordBatch], steps: int, rate: float, l2: float, least_z: float) -> np.ndarray:
    """Weights and, last, the bias, from text and toxic. The texts are read twice, first for the words that tell
    anything; only those are held."""
    texts, labels = [], []
    for batch in batches:
        labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        texts.append(batch.select(["text"]))
    out = np.zeros((1 << BITS) + 1)
    out[-1] = PRIOR
    if not texts:
        return out
    use = telling(texts, labels, least_z)
    words, sentences, rows, n_sentences, n_rows = [], [], [], 0, 0
    for batch in texts:
        for i, j, data, offsets in text_chunks(batch):
            w, own, r, *_ = sentence_words(data, offsets)
            keep = use[w]
            words.append(w[keep])
            sentences.append(own[keep] + n_sentences)
            rows.append(r + n_rows)
            n_sentences += len(r)
            n_rows += j - i
    if not n_sentences:
        return out
    y = np.concatenate(labels)
    word, own, row = np.concatenate(words), np.concatenate(sentences), np.concatenate(rows)
    seen, word = np.unique(word, return_inverse=True)
    w, b = np.zeros(len(seen)), -4.0
    m, v = np.zeros(len(seen) + 1), np.zeros(len(seen) + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(own, w[word], n_sentences) if len(word) else np.full(n_sentences, b)
        clean = np.minimum(np.bincount(row, sentence_log_clean(z), len(y)), -1e-12)
        # d log-likelihood / d log-clean: -1 for clean documents' losses, exp(clean) / (1 - exp(clean)) for toxic ones
        pull = np.where(y > 0, np.exp(clean) / -np.expm1(clean), -1.0)
        p = np.exp(-np.logaddexp(0, -z))
        g_s = pull[row] * p
        g = np.append(np.bincount(word, g_s[own], len(seen)) - l2 * w, g_s.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w + step[:-1], b + step[-1]
    out[seen], out[-1] = w, b
    return out


def train(labelled: DataFrame, steps: int = 250, rate: float = 0.1, l2: float = 0.3, least_z: float = 4.0) -> np.ndarray:
    """Weights from labelled (doc_id, text, toxic), in one task.

    Without any row, every text scores as a prior."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = fitted(batches, steps, rate, l2, least_z).astype("<f4")
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    chosen = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))
    got = chosen.repartition(1).mapInArrow(tidy(run), "at long, w float").toArrow()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[-1] = PRIOR
    weights[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted and the most toxic sentence: its score
    and its place in the UTF-8 bytes of the text.

    Null and empty texts score as one sentence without words would (near 0) and have no sentence. Rows
    without doc_id are left out; repeated rows come out repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    names = [x.split()[0] for x in SCHEMA.split(", ") if not x.startswith("held")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        bias = float(w[-1])
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in text_chunks(batch):
                word, own, row, start, end = sentence_words(data, offsets)
                n = j - i
                clean = np.zeros(n)
                count = np.bincount(row, minlength=n)
                best, a, b = np.full(n, np.nan), np.full(n, -1), np.full(n, -1)
                if len(row):
                    z = bias + np.bincount(own, w[word], len(row))
                    clean = np.bincount(row, sentence_log_clean(z), n)
                    order = np.lexsort((-start, z, row))
                    last = order[np.r_[row[order][1:] != row[order][:-1], True]]
                    best[row[last]], a[row[last]], b[row[last]] = np.exp(-np.logaddexp(0, -z[last])), start[last], end[last]
                clean[count == 0] = -np.logaddexp(0, bias)
                p = np.clip(-np.expm1(clean), 0, 1)
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, n), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(count.astype(np.int64)), pa.array(best, mask=none), pa.array(a.astype(np.int64), mask=none), pa.array(b.astype(np.int64), mask=none)], names=names
                )

    out = id_text(docs).mapInArrow(tidy(run), ", ".join(x for x in SCHEMA.split(", ") if not x.startswith("held")))
    return out.withColumn("held_out", held_out(5, 0)).select(*(x.split()[0] for x in SCHEMA.split(", ")))


def trained(docs: DataFrame, labels: DataFrame, sample: int = 12_000, **parameters) -> np.ndarray:
    """Weights learned from the labelled documents that are not held out.

    labels: doc_id, toxic; a document with several labels is learned from once for each value, and labels
    other than 0 and 1 teach nothing. `sample` bounds the labels that are learned from, those of the smallest
    hashes of doc_id, and so the memory of the one task that fits (about 50 MB of text); it bounds nothing else."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(5, 0)).distinct()
    # at most `sample` + 1 rows of two numbers, so they can be sent to every task
    return train(id_text(docs).join(F.broadcast(least_hashed(known, sample)), "doc_id"), **parameters)


def classify(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """Trains on labels and scores all of docs; see trained and score."""
    return score(docs, trained(docs, labels, **parameters))


def probability(weights: np.ndarray, spark: SparkSession):
    """A column function: the score of a text column, so that rows can be filtered as they are; a null text is empty."""
    shared = spark.sparkContext.broadcast(weights)

    # texts stay in Arrow buffers; as strings of Python they would be held twice
    @F.arrow_udf("double")
    def of(text: pa.Array) -> pa.Array:
        w = shared.value
        bias, out = float(w[-1]), np.zeros(len(text))
        batch = pa.RecordBatch.from_arrays([text.fill_null("")], names=["text"])
        for i, j, data, offsets in text_chunks(batch):
            word, own, row, _, _ = sentence_words(data, offsets)
            z = bias + np.bincount(own, w[word], len(row)) if len(row) else np.zeros(0)
            clean = np.bincount(row, sentence_log_clean(z), j - i) if len(row) else np.zeros(j - i)
            clean[np.bincount(row, minlength=j - i) == 0] = -np.logaddexp(0, bias)
            out[i:j] = np.clip(-np.expm1(clean), 0, 1)
        release()
        return pa.array(out)

    return of
