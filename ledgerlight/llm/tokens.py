"""Token ids by the tokenizers library, piece by piece.

A byte-level vocabulary cuts a text before every single space, around every single line end and before a
point that ends a word, so the pieces between these can be encoded alone. Pieces recur: the library gets
each new one once, a line each in a longer text, and its ids are kept in sorted arrays. Texts with other
white space, runs of it or special tokens go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import CHUNK, Spans, byte_symbols, text_chunks

_RARE = np.zeros(256, bool)
_RARE[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(c) for c in ".,;:!?"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def odd_bytes(data: np.ndarray) -> np.ndarray:
    """Places of white space other than space and line end, or of what may be some or a special token."""
    a, b = data[:-1], data[1:]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80) | (a == ord("<")) & (b == ord("|"))
    return np.concatenate([np.flatnonzero(_RARE[data]), np.flatnonzero(two)])


class Encoder:
    #: Pieces remembered at once (about 40 bytes each), and pieces given to the library in one text.
    LIMIT, LINES = 1_000_000, 4096

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        line = self.library.encode("a\n b\n", add_special_tokens=False).ids
        end = self.library.encode("\n", add_special_tokens=False).ids
        if len(end) != 1 or line.count(end[0]) != 2:
            raise ValueError("the vocabulary does not keep line ends apart")
        self.line = end[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return self.column(pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"]))

    def column(self, batch: pa.RecordBatch, limit: int = 2 * CHUNK) -> list[np.ndarray]:
        """The ids of each row's text; no nulls."""
        out: list[np.ndarray] = []
        for _, _, data, offsets in text_chunks(batch, limit=limit):
            out += self._chunk(data, offsets)
        return out

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n, rows = len(data), len(offsets) - 1
        if not n:
            return [np.zeros(0, "<u4")] * rows
        space, line = data == 32, data == 10
        white = space | line
        last = np.zeros(n, bool)
        last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
        before_white = np.r_[white[1:], True] | last
        odd = np.zeros(rows + 1, bool)
        wrong = np.concatenate([np.flatnonzero(before_white & (space | line & ~last)), odd_bytes(data)])
        odd[np.searchsorted(offsets, wrong, side="right") - 1] = True
        odd = odd[:rows]
        begins = white.copy()
        begins[1:] |= line[:-1]
        begins[offsets[:-1][offsets[:-1] < n]] = True
        begins[1:] |= _POINT[data[1:]] & _LETTER[data[:-1]] & before_white[1:]
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)
        if odd.any():
            fine = ~odd[np.searchsorted(offsets, starts, side="right") - 1]
            starts, ends = starts[fine], ends[fine]
        keys, first, of = np.unique(Spans(byte_symbols(data)).of(starts, ends), return_index=True, return_inverse=True)
        self._learn(keys, data, starts[first], ends[first])
        at = np.searchsorted(self.keys, keys)
        length = self.length[at][of]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.start[at][of] - total[:-1], length) + np.arange(total[-1])] if len(starts) else np.zeros(0, "<u4")
        cut = total[np.searchsorted(starts, offsets)]
        out = [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        if odd.any():
            which = np.flatnonzero(odd).tolist()
            for k, x in zip(which, self.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in which])):
                out[k] = x
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) > self.LIMIT:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys
        if not new.any():
            return
        keys, starts, ends, at = keys[new], starts[new], ends[new], at[new]
        size = ends - starts + 1
        lone = data[starts] == 10
        texts = []
        for i in range(0, len(keys), self.LINES):
            s, m = starts[i : i + self.LINES], size[i : i + self.LINES]
            to = np.concatenate([[0], np.cumsum(m)])
            lines = data[np.minimum(np.repeat(s - to[:-1], m) + np.arange(to[-1]), len(data) - 1)]
            lines[to[1:] - 1] = 10
            lines[to[:-1][lone[i : i + self.LINES]]] = 46
            texts.append(lines.tobytes().decode())
        ids = np.concatenate(self.whole(texts))
        stop = np.flatnonzero(ids == self.line)
        if len(stop) != len(keys):
            raise ValueError("the vocabulary does not keep line ends apart")
        begin = np.append(0, stop[:-1] + 1)
        ids[begin[lone]] = self.line
        if self.used + len(ids) > len(self.flat):
            grown = np.zeros(2 * (self.used + len(ids)), "<u4")
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(ids)] = ids
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, begin + self.used)
        self.length = np.insert(self.length, at, stop - begin)
        self.used += len(ids)


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
