"""Removal of passages that occurred before, by automata over recurring phrases.

Segments of documents meet by anchor (see repeats). In each shard the windows that recur are confirmed,
compiled into Aho-Corasick automata with a letter for each word, at most `PATTERNS` phrases each, and all
the shard's segments are streamed through them in document order. The first occurrence of a phrase stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Spans, column, id_text, runs, text_chunks, tidy, word_hashes, word_spans
from .repeats import Words, covered, packed, removals, unpacked

#: Phrases in one automaton, and segments that are taken together (more only if they share an anchor).
PATTERNS, ROWS = 50_000, 16_384
#: Different segments of one anchor that go to one task: about 150 bytes each. Beyond that see repeats.
CROWD = 4096
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def letter(k: int) -> str:
    """A character for the k-th word; surrogates are passed over."""
    return chr(k + 1 if k < 0xD7FF else k + 0x801)


def located(window: int):
    """For each segment the windows that occurred before it or earlier in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "anchor", ROWS):
            out = shard(rows, window)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["doc_id", "place"])

    return tidy(run)


def shard(rows: pa.Table, window: int) -> list[tuple[int, int]]:
    doc, (place, n, _) = rows["doc_id"].to_numpy(), unpacked(rows["place"].to_numpy())
    order = np.lexsort((place, doc))
    order = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0)]]
    rows = rows.take(order)
    doc, place, n = doc[order], place[order], n[order]
    words, phrase, of = [], [], []
    done = 0
    for batch in rows.combine_chunks().to_batches():
        for i, j, data, offsets in text_chunks(batch):
            starts, ends, first = word_spans(data, offsets)
            h = word_hashes(data, starts, ends)
            count = np.maximum(0, np.diff(first) - window + 1)
            at = np.arange(count.sum()) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
            phrase.append(Spans(h).of(at, at + window))
            of.append(np.repeat(np.arange(done + i, done + j), count))
            words += [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        done += batch.num_rows
    phrase, of = np.concatenate(phrase), np.concatenate(of)
    at = np.arange(len(of)) - np.searchsorted(of, of)
    keys, example, which, many = np.unique(phrase, return_index=True, return_inverse=True, return_counts=True)
    recurring = np.flatnonzero(many > 1)
    out: list[tuple[int, int]] = []
    for k in range(0, len(recurring), PATTERNS):
        own = recurring[k : k + PATTERNS]
        use = np.zeros(len(keys), bool)
        use[own] = True
        streamed = np.unique(of[use[which]])
        names, spelled = np.unique(np.concatenate([words[r] for r in streamed]), return_inverse=True)
        letters = [letter(x) for x in range(len(names))]
        cut = np.cumsum([0, *(len(words[r]) for r in streamed)])
        text = {int(r): "".join([letters[x] for x in spelled[a:b].tolist()]) for r, a, b in zip(streamed, cut[:-1], cut[1:])}
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for x in own.tolist():
            e = example[x]
            s = int(at[e])
            automaton.add_word(text[int(of[e])][s : s + window], x)
        automaton.make_automaton()
        seen: set[int] = set()
        for r, t in text.items():
            d, first = int(doc[r]), int(place[r])
            run_start = run_end = -1
            for end, x in automaton.iter(t):
                if x in seen:
                    s = first + end - window + 1
                    if s == run_end and s - run_start < 4096:
                        run_end = s + 1
                    else:
                        if run_end > run_start:
                            out.append((d, packed(run_start, run_end - run_start, 0)))
                        run_start, run_end = s, s + 1
                else:
                    seen.add(x)
            if run_end > run_start:
                out.append((d, packed(run_start, run_end - run_start, 0)))
    return out


def remove(docs: DataFrame, window: int = 20, gram: int = 8, with_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if with_text, kept; then the carried columns of docs.

    A word goes if a window of `window` words over it starts earlier too: in a smaller doc_id, or before it
    in the same document. kept_sha256 is of the words that stay, joined by a space; kept is these words
    where any went, else the text as it was. Null texts have no words. Rows with equal doc_id count as one
    document: places found in any of them go from each; equal rows do not remove each other. Rows without
    doc_id are left out, an empty table gives no rows, columns that are not carried are not read.
    """
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for d, t, g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(part.num_columns - 1)):
                    words = t.encode().split()
                    n = len(words)
                    if g.is_valid:
                        words = [words[k] for k in np.flatnonzero(~covered(g.values.to_numpy(), n, window)).tolist()]
                    kept = b" ".join(words)
                    rows.append((d, n, n - len(words), hashlib.sha256(kept).hexdigest(), *([kept.decode() if len(words) < n else t] * with_text)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(zip(*rows), kinds)), *part.columns[2:-1]], names=[*names, *carried])

    given = id_text(docs, *carried)
    found = removals(given, Words, window, gram, True, located(window), CROWD).select("doc_id", "text", *carried, "gone")
    schema = SCHEMA + ", kept string" * with_text + "".join(f", `{c}` {given.schema[c].dataType.simpleString()}" for c in carried)
    return found.mapInArrow(tidy(run), schema)
