"""What the two exact substring operators share: anchors, exchange and the texts around recurring ones.

Every window of `window` symbols has an anchor: the first least gram of `gram` symbols in it. Equal windows
have equal anchors at equal places. Consecutive windows with one anchor make a segment, so a text is a few
segments for each `window` symbols, not one row for each window. Segments meet by anchor; equal ones
(by two 64-bit hashes) are one, and where different segments share an anchor their texts are fetched and an
operator's own structure decides window by window. Segments whose anchor occurs once have no part in this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, byte_symbols, column, mixed, parts, runs, saved, signed, text_chunks, tidy, word_hashes, word_spans

#: A place is packed with the number of windows (less one) and the anchor's distance from the first: 2 x 12 bits.
BITS = 12


class Words:
    """Symbols are words [^\\x20\\x09-\\x0D]+."""

    @staticmethod
    def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first = word_spans(data, offsets)
        return word_hashes(data, starts, ends), first, starts, ends


class Bytes:
    """Symbols are bytes."""

    @staticmethod
    def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(data))
        return byte_symbols(data), offsets, at, at + 1


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the first least one."""
    place = np.arange(len(values), dtype=np.int32)
    done = 1
    while done < width:
        step = min(done, width - done)
        right = values[step:] < values[: len(values) - step]
        values = np.where(right, values[step:], values[: len(values) - step])
        place = np.where(right, place[step:], place[: len(place) - step])
        done += step
    return place


def segments(symbols: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window (counted in the row), windows, anchor's distance from it, anchor and content hashes."""
    counts = np.maximum(0, np.diff(first) - window + 1)
    if not counts.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    spans = Spans(symbols)
    at = np.arange(len(symbols) - gram + 1)
    grams = spans.of(at, at + gram)
    least = first_least(grams, window - gram + 1)
    row = np.repeat(np.arange(len(counts)), counts)
    i = np.arange(counts.sum()) + np.repeat(first[:-1] - np.cumsum(counts) + counts, counts)
    anchor = least[i].astype(np.int64)
    head = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    n = np.diff(np.r_[head, len(i)])
    low, anchor, row = i[head], anchor[head], row[head]
    content = spans.of(low, low + n - 1 + window) ^ mixed((anchor - low).astype(np.uint64))
    return row, low - first[row], n, anchor - low, grams[anchor], content


def packed(place, n, distance):
    return (place << (2 * BITS)) | ((n - 1) << BITS) | distance


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << BITS) - 1
    return x >> (2 * BITS), ((x >> BITS) & mask) + 1, x & mask


def anchored(unit, window: int, gram: int) -> Callable:
    """A row per segment, equal ones of a chunk added up beforehand: the first has their number as copies, the others
    0 and a key of their own, so that a text that repeats itself, or copies side by side, do not meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for i, j, data, offsets in text_chunks(batch):
                symbols, first, _, _ = unit.symbols(data, offsets)
                row, place, n, distance, anchor, content = segments(symbols, first, window, gram)
                doc, place = ids[i:j][row], packed(place, n, distance)
                order = np.lexsort((place, doc, content, anchor))
                anchor, content, doc, place = signed(anchor[order]), signed(content[order]), doc[order], place[order]
                new, other = changes(anchor, content, doc, place)
                anchor, content, doc, place, new = anchor[other], content[other], doc[other], place[other], new[other]
                at = np.flatnonzero(new)
                copies = np.zeros(len(new), np.int32)
                copies[at] = np.diff(np.append(at, len(new)))
                anchor = np.where(copies > 0, anchor, signed(mixed((doc * 1_000_003 + place).astype(np.uint64))))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(doc), pa.array(place), pa.array(copies)], names=["anchor", "content", "doc_id", "place", "copies"])

    return tidy(run)


def changes(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In sorted rows: which start another segment, and which are no repeated row of the one before."""
    first = np.arange(len(anchor)) == 0
    new, other = first.copy(), first.copy()
    new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
    other[1:] = new[1:] | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    return new, other


#: What becomes of a segment: all its windows recur; to be looked at; the same, and equal ones exist; to be met window by window.
GONE, ASK, ASK_TWICE, SPLIT = 0, 1, 2, 3
#: Different segments of one anchor whose texts go to one task, if an operator does not say; beyond that each window is met by its own hash.
CROWD = 4096


def met(keep_first: bool, crowd: int) -> Callable:
    """Rows of a partition sorted by anchor: which segments recur as a whole, and which share an anchor with others."""

    def rows(anchor: np.ndarray, doc: np.ndarray, place: np.ndarray, what: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(doc), 1 << 16):
            r = slice(k, k + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(anchor[r]), pa.array(doc[r]), pa.array(place[r]), pa.array(what[r].astype(np.int32))], names=["anchor", "doc_id", "place", "what"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "anchor"):
            yield from some(*(t[c].to_numpy() for c in ("anchor", "content", "doc_id", "place", "copies")))

    def some(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, place: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        over = copies == 0
        yield from rows(anchor[over], doc[over], place[over], np.full(int(over.sum()), GONE))
        anchor, content, doc, place, copies = (x[~over] for x in (anchor, content, doc, place, copies))
        _, of, many = np.unique(anchor, return_inverse=True, return_counts=True)
        again = (many[of] > 1) | (copies > 1)
        order = np.flatnonzero(again)
        order = order[np.lexsort((place[order], doc[order], content[order], anchor[order]))]
        anchor, content, doc, place, copies = (x[order] for x in (anchor, content, doc, place, copies))
        new, other = changes(anchor, content, doc, place)
        anchor, content, doc, place, copies, new = (x[other] for x in (anchor, content, doc, place, copies, new))
        if not len(anchor):
            return
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        group, of_anchor = np.cumsum(new) - 1, np.cumsum(new_anchor) - 1
        copies = np.bincount(group, copies)[group]
        kinds = np.bincount(of_anchor, new)[of_anchor]
        ask = new & (kinds > 1)
        gone = ~new if keep_first else copies > 1
        yield from rows(anchor[gone], doc[gone], place[gone], np.full(int(gone.sum()), GONE))
        yield from rows(anchor[ask], doc[ask], place[ask], np.where(kinds[ask] > crowd, SPLIT, np.where(copies[ask] > 1, ASK_TWICE, ASK)))

    return tidy(run)


def fetched(unit, window: int) -> Callable:
    """The bytes of each segment that is asked for (asked: structs of anchor, place, what)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asked = column(batch, "doc_id"), batch.column(batch.schema.get_field_index("asked"))
            counts = np.diff(asked.offsets.to_numpy())
            flat = asked.flatten()
            anchor, place, what = (flat.field(c).to_numpy() for c in ("anchor", "place", "what"))
            ends = np.cumsum(counts)
            for i, j, data, offsets in text_chunks(batch):
                _, first, starts, stops = unit.symbols(data, offsets)
                a, b = int(ends[i] - counts[i]), int(ends[j - 1])
                row = np.repeat(np.arange(j - i), counts[i:j])
                at, n, _ = unpacked(place[a:b])
                low = first[row] + at
                size = stops[low + n + window - 2] - starts[low]
                to = np.concatenate([[0], np.cumsum(size)])
                text = data[np.repeat(starts[low] - to[:-1], size) + np.arange(to[-1])]
                column_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([pa.array(anchor[a:b]), pa.array(ids[i:j][row]), pa.array(place[a:b]), pa.array(what[a:b]), column_.cast(pa.binary())], names=["anchor", "doc_id", "place", "what", "text"])

    return tidy(run)


def joined(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Single windows of documents as packed runs of at most 2048."""
    by = np.lexsort((places, docs))
    docs, at = docs[by], places[by]
    head = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (at[1:] > at[:-1] + 1) | (at[1:] // 2048 != at[:-1] // 2048)]) if len(docs) else np.zeros(0, np.int64)
    if not len(head):
        return docs, at
    last = np.append(head[1:], len(docs)) - 1
    return docs[head], packed(at[head], at[last] - at[head] + 1, 0)


def each_window(unit, window: int) -> Callable:
    """Two hashes and the place of every window of the segments given (columns doc_id, place, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, place = column(batch, "doc_id"), unpacked(column(batch, "place"))[0]
            for i, j, data, offsets in text_chunks(batch):
                symbols, first, _, _ = unit.symbols(data, offsets)
                count = np.maximum(0, np.diff(first) - window + 1)
                row = np.repeat(np.arange(j - i), count)
                at = np.arange(count.sum()) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
                h1, h2 = Spans(symbols).of(at, at + window), Spans(mixed(symbols)).of(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), pa.array(ids[i:j][row]), pa.array(place[i:j][row] + at - first[row])], names=["h1", "h2", "doc_id", "at"])

    return tidy(run)


def recurring(keep_first: bool) -> Callable:
    """The windows (sorted by hashes, doc_id, at) whose hashes another place has too; with keep_first those after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row so far, and whether it has been given out or, with keep_first, need not be
        last, settled = None, True
        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([column(b, c) for c in ("h1", "h2", "doc_id", "at")])
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            same = np.r_[False, (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)]
            other = np.r_[False, (rows[2:, 1:] != rows[2:, :-1]).any(axis=0)]
            # of equal hashes: places that differ from the one before; repeated rows of one place do not count
            again = same & other
            gone = again.copy()
            if not keep_first:
                head = np.flatnonzero(~same)
                first = np.flatnonzero(np.add.reduceat(again, head) > 0)
                gone[head[first]] = True
                if last is not None and settled:
                    gone[0] = False
            doc, at = rows[2, gone], rows[3, gone]
            # the last group may go on: its first row is kept back in place of its last, and is given out once
            start = int(np.flatnonzero(~same)[-1])
            was = settled if last is not None and start == 0 else False
            settled = bool(was or (not keep_first and gone[start]))
            last = np.concatenate([rows[:2, -1], rows[2:, -1]]) if keep_first or settled else rows[:, start]
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at << (2 * BITS))], names=["doc_id", "place"])

    return tidy(run)


def met_by_window(texts: DataFrame, unit, window: int, keep_first: bool) -> DataFrame:
    """(doc_id, place) of the windows to remove in segments of crowded anchors: equal hashes of windows stand together after one
    exchange and are passed through in order, so no group is held, however large."""
    w = texts.mapInArrow(each_window(unit, window), "h1 long, h2 long, doc_id long, at long")
    w = w.repartition(parts(texts.sparkSession), "h1").sortWithinPartitions("h1", "h2", "doc_id", "at")
    return w.mapInArrow(recurring(keep_first), "doc_id long, place long")


def removals(docs: DataFrame, unit, window: int, gram: int, keep_first: bool, decide: Callable, crowd: int | None = None) -> DataFrame:
    """docs (doc_id, text and more) with gone: packed places of windows to remove, or null.

    decide: batches (anchor, doc_id, place, what, text), sorted by anchor, to batches (doc_id, place)."""
    p = parts(docs.sparkSession)
    plain = docs.select("doc_id", "text")
    rows = plain.mapInArrow(anchored(unit, window, gram), "anchor long, content long, doc_id long, place long, copies int")
    known = saved(rows.repartition(p, "anchor").sortWithinPartitions("anchor").mapInArrow(met(keep_first, CROWD if crowd is None else crowd), "anchor long, doc_id long, place long, what int"))

    def texts(wanted) -> DataFrame:
        """Texts of the segments asked for; all calls and the last join read one exchange of the documents."""
        asked = known.where(wanted).groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place", "what")).alias("asked"))
        return plain.join(asked, "doc_id").mapInArrow(fetched(unit, window), "anchor long, doc_id long, place long, what int, text binary")

    decided = texts(F.col("what").isin(ASK, ASK_TWICE)).repartition(p, "anchor").sortWithinPartitions("anchor").mapInArrow(decide, "doc_id long, place long")
    if known.where(F.col("what") == SPLIT).limit(1).count():
        decided = decided.union(met_by_window(texts(F.col("what") == SPLIT), unit, window, keep_first))
    gone = known.where(F.col("what") == GONE).select("doc_id", "place").union(decided).groupBy("doc_id").agg(F.collect_list("place").alias("gone"))
    return docs.join(gone, "doc_id", "left")


def covered(gone: np.ndarray | None, n: int, window: int) -> np.ndarray:
    """Which of n symbols are in a window to remove."""
    edge = np.zeros(n + 1, np.int64)
    if gone is not None and len(gone):
        at, windows, _ = unpacked(np.asarray(gone, dtype=np.int64))
        ok = at + windows + window - 1 <= n
        np.add.at(edge, at[ok], 1)
        np.add.at(edge, (at + windows + window - 1)[ok], -1)
    return np.cumsum(edge[:-1]) > 0
