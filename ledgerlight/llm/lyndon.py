"""Suffix arrays by Lyndon grouping, and removal of byte strings that occur elsewhere.

`suffix_array` first groups suffixes by their longest Lyndon prefix: groups are taken in descending order,
and every suffix of a group hands its context to the nearest suffix before it that lies in a smaller
group (previous-smaller pointers), which moves to a new group right above its own. Then suffixes come out
in ascending order; each emits those whose Lyndon prefix ends where it starts, found along the same
pointers, into the next place of their group. Both phases take linear time; nothing is renamed recursively.

`remove` meets segments of documents by anchor (see repeats). In each shard all their texts are cut into
phrases, ended by a rule that only looks at the bytes themselves, and named in byte order. One suffix array of
the whole shard, at every phrase of every text, puts equal strings side by side; what neighbours share, to
the right and, read backwards, to the left of their first phrase start, says which windows recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Spans, byte_symbols, column, id_text, runs, tidy
from .repeats import ASK, Bytes, covered, joined, removals, unpacked

#: Segments that are taken together (more only if they share an anchor).
ROWS = 4096
#: White space, and the bytes after which it ends a phrase at first: about a third of all.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CERTAIN = (np.arange(256) * 37 % 256 % 3 == 0) & ~SPACE
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text) + 1
    least = min(text, default=0) - 1
    s = [*text, least]
    # suffixes in the order of their groups; a group is named by its first place
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and s[i] != s[order[k - 1]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = sorted(order[g:end])
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            # those that took more contexts rise higher; of one count, those of one group move together
            moves: dict[tuple[int, int], list[int]] = {}
            for p, c in count.items():
                moves.setdefault((-c, group[p]), []).append(p)
            for _, old in sorted(moves):
                moved = moves[(_, old)]
                if len(moved) == size[old]:
                    continue
                size[old] -= len(moved)
                new = old + size[old]
                size[new] = len(moved)
                at = new + len(moved) - 1
                for p in moved:
                    other = order[at]
                    k = place[p]
                    order[k], place[other] = other, k
                    order[at], place[p] = p, at
                    at -= 1
                for p in moved:
                    group[p] = new
        end = g
    out = [0] * n
    free = list(range(n))
    out[0] = n - 1
    filled = [False] * n
    filled[n - 1] = True
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not filled[i]:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            filled[i] = True
            i = before[i]
    return out[1:]


def ends_of_phrases(data: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Which bytes end a phrase, by a rule that looks at the byte and the one before it in its text alone, so that
    equal strings are cut alike; the first rule under which no phrase is longer than `most`. starts: of the texts.

    A phrase is ended by white space after certain bytes, else by any white space, else by more and more bytes."""
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[starts] = 32
    ends = SPACE[data]
    rules = [ends & CERTAIN[before], ends]
    single = SPACE.copy()
    while True:
        ends = rules.pop(0) if rules else single[data]
        cut = np.union1d(starts, np.append(np.flatnonzero(ends) + 1, len(data)))
        long = np.flatnonzero(np.diff(cut) > most)
        if not len(long):
            return ends
        if not rules:
            held = np.zeros(256, np.int64)
            for k in long[:1024]:
                held[np.unique(data[cut[k] : cut[k + 1]])] += 1
            total = np.bincount(data, minlength=256)
            usual = np.flatnonzero(held * 2 >= held.max())
            single[usual[np.argmin(total[usual])]] = True


def shared_bytes(data: np.ndarray, left: np.ndarray, right: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many bytes are equal from left and from right on, up to `room`."""
    out = np.zeros(len(left), np.int64)
    most = int(room.max(initial=0))
    wide = np.concatenate([data, np.zeros(most + 64, np.uint8)])
    alive, done = np.arange(len(left)), 0
    while len(alive) and done < most:
        step = 64 if done else 32
        view = np.lib.stride_tricks.sliding_window_view(wide, step)
        on = []
        for k in range(0, len(alive), 16384):
            i = alive[k : k + 16384]
            differ = view[left[i] + done] != view[right[i] + done]
            some = differ.any(axis=1)
            out[i] = done + np.where(some, differ.argmax(axis=1), step)
            on.append(i[~some & (done + step < room[i])])
        alive, done = np.concatenate(on), done + step
    return np.minimum(out, room)


def side_classes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of texts, and by rank the bytes at the beginning that one shares with the text of the rank before."""
    distinct = sorted(set(texts))
    rank = {t: k for k, t in enumerate(distinct)}
    size = np.array([len(t) for t in distinct], np.int64)
    at = np.cumsum(size) - size
    data = np.frombuffer(b"".join(distinct), np.uint8)
    shared = np.zeros(len(distinct), np.int64)
    shared[1:] = shared_bytes(data, at[:-1], at[1:], np.minimum(size[:-1], size[1:]))
    return np.array([rank[t] for t in texts], np.int64), shared


def found(window: int):
    """For each segment the windows that another segment has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "anchor", ROWS):
            out = shard(rows, window)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "place"])

    return tidy(run)


def shard(rows: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of windows that occur at another place of the shard's texts too, those of segments that are asked for.

    One suffix array over all phrases of all texts; a window starts d bytes before its first phrase start (the
    first that its own bytes decide) and recurs if a neighbouring suffix shares window - d bytes to the right
    and has the same d bytes on its left."""
    doc, what, anchor = (rows[c].to_numpy() for c in ("doc_id", "what", "anchor"))
    place = unpacked(rows["place"].to_numpy())[0]
    order = np.lexsort((rows["place"].to_numpy(), doc, anchor))
    order = order[np.r_[True, (np.diff(doc[order]) != 0) | (np.diff(place[order]) != 0) | (anchor[order][1:] != anchor[order][:-1])]]
    texts = rows["text"].take(order).to_pylist()
    doc, what, place = (x[order] for x in (doc, what, place))
    size = np.array([len(t) for t in texts], np.int64)
    stop = np.cumsum(size)
    begin = stop - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = ends_of_phrases(data, begin, window * 3 // 4)
    start = np.union1d(begin, np.flatnonzero(ends[:-1]) + 1)
    of = np.searchsorted(begin, start, side="right") - 1
    until = np.append(start[1:], len(data))
    # phrases named in the order of their bytes; a text ends with a symbol under all names
    key, first, name = np.unique(Spans(byte_symbols(data)).of(start, until), return_index=True, return_inverse=True)
    spelled = [data[x:y].tobytes() for x, y in zip(start[first].tolist(), until[first].tolist())]
    by = np.argsort(np.array(sorted(range(len(spelled)), key=spelled.__getitem__)))
    symbols = np.insert(by[name] + 1, np.flatnonzero(np.diff(of, append=-1)) + 1, 0)
    suffix = np.array(suffix_array(symbols.tolist()), np.int64)
    number = np.cumsum(symbols > 0) - 1
    suffix = number[suffix[symbols[suffix] > 0]]
    at, room = start[suffix], stop[of[suffix]] - start[suffix]
    right_shared = np.zeros(len(suffix), np.int64)
    right_shared[1:] = shared_bytes(data, at[:-1], at[1:], np.minimum(np.minimum(room[:-1], room[1:]), window))
    rank = np.empty(len(suffix), np.int64)
    rank[suffix] = np.arange(len(suffix))
    # windows from one byte before the phrase start before (or the text's start) to two bytes before this one
    inner = np.flatnonzero(start > begin[of])
    low = np.maximum(begin[of[inner]], start[inner - 1] - 1)
    width = start[inner] - low
    left_rank, left_shared = side_classes([data[x:y][::-1].tobytes() for x, y in zip(low.tolist(), start[inner].tolist())])
    docs, places = [], []
    for d in range(2, int(width.max(initial=0)) + 1):
        # a start that lies one byte after the start before is the next start's to decide
        has = inner[width >= d]
        if not len(has):
            break
        r = np.cumsum(right_shared < window - d)[rank[has]]
        l = np.cumsum(left_shared < d)[left_rank[width >= d]]
        _, group, many = np.unique(l * (len(suffix) + 1) + r, return_inverse=True, return_counts=True)
        hit = has[(many[group] > 1) & (what[of[has]] == ASK)]
        docs.append(doc[of[hit]])
        places.append(place[of[hit]] + start[hit] - d - begin[of[hit]])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return joined(np.concatenate(docs), np.concatenate(places))


def remove(docs: DataFrame, window: int = 400, gram: int = 200, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if with_text, kept (binary).

    Texts are their UTF-8 bytes; a byte goes if a string of `window` bytes over it also starts anywhere
    else. Null texts are empty. Rows with equal doc_id count as one document: places found in any of them
    go from each, and equal rows are not elsewhere. Rows without doc_id are left out, an empty table gives
    no rows, other columns are not read.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = column(batch, "doc_id").tolist(), batch.column(batch.schema.get_field_index("text"))
            gone = batch.column(batch.schema.get_field_index("gone"))
            for i in range(0, len(ids), 512):
                rows = []
                for d, t, g in zip(ids[i : i + 512], texts.slice(i, 512).to_pylist(), gone.slice(i, 512)):
                    kept, removed, spans = t.encode(), 0, 0
                    n = len(kept)
                    if g.is_valid:
                        cut = covered(g.values.to_numpy(), n, window)
                        removed, spans = int(cut.sum()), int((cut & ~np.r_[False, cut[:-1]]).sum())
                        kept = np.frombuffer(kept, np.uint8)[~cut].tobytes()
                    rows.append((d, n, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] * with_text)))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return removals(id_text(docs), Bytes, window, gram, False, found(window)).mapInArrow(tidy(run), SCHEMA + ", kept binary" * with_text)
