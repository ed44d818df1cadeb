"""BPE encoding as a transducer with bounded lookahead, and incremental decoding.

What follows a text changes its tokenisation only near the end: a merge that the unseen text takes away
frees its left token for a later merge, and so on to the left, each time by a merge of a later rank.
`lookahead` takes the longest such chain from the merge list. So tokens that end that far before the end
of what was read are final; `Transducer` emits them and keeps the rest, in memory that depends on the
merge list alone. Words go through it one after another as one stream of symbols; those in its buffer
are merged at once, in arrays. `Decoder` turns the ids that come out into text.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import id_text
from .tokens import vocabulary

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
NONE = np.int64(1) << 40
_coders: dict[str, "Coder"] = {}


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b if b in plain else next(other)) for b in range(256)]


@functools.cache
def unassigned() -> tuple[re.Pattern, regex.Pattern]:
    """Characters that Python's tables or those of `regex` do not know; the library's may be of a later Unicode version. First a
    pattern of those below 2^16 and of all from there on, which is a look-up, then that of the characters themselves, which is slow."""
    at = np.flatnonzero([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    cut = np.flatnonzero(np.diff(at) > 1)
    exact = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, -1]])) + r"\p{Cn}]")
    low = "".join(f"\\u{c:04x}" for c in range(0x10000) if exact.match(chr(c)))
    return re.compile(f"[{low}\\U00010000-\\U0010ffff]"), exact


class Merges:
    """Merge rules (left id, right id) -> id, in order of rank."""

    def __init__(self, rules: list[tuple[int, int, int]], length: dict[int, int]):
        keys = np.array([(a << 32) | b for a, b, _ in rules], dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys, first.astype(np.int64)
        self.made = np.array([r[2] for r in rules], dtype=np.int64)
        self.lookahead = lookahead(rules, length)
        made_at: dict[int, int] = {}
        for k, (_, _, c) in enumerate(rules):
            made_at.setdefault(c, k)
        #: Every rule comes after those that make its parts: then equal merges can be made at once.
        self.ordered = all(made_at.get(x, -1) < k for k, (a, b, _) in enumerate(rules) for x in (a, b))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(a), NONE)
        key = (a << np.int64(32)) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def apply(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final tokens of many words and the word of each; word: which word each symbol is of, ascending."""
        kept_ids, kept_word = [], []
        while len(ids):
            rank = np.full(len(ids), NONE)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self.rank(ids[same], ids[same + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(ids)]))
            if (over := best == NONE).any():
                kept_ids.append(ids[over])
                kept_word.append(word[over])
                ids, word, rank, best = ids[~over], word[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            here = rank == best
            if self.ordered:
                run = here & ~np.r_[False, here[:-1] & (word[:-1] == word[1:])]
                at = np.arange(len(ids))
                here &= (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 0
            else:
                at = np.flatnonzero(here)
                here[:] = False
                here[at[np.r_[True, word[at[1:]] != word[at[:-1]]]]] = True
            ids = ids.copy()
            ids[here] = self.made[rank[here]]
            stay = ~np.r_[False, here[:-1]]
            ids, word = ids[stay], word[stay]
        if not kept_ids:
            return ids, word
        ids, word = np.concatenate(kept_ids), np.concatenate(kept_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]


def lookahead(rules: list[tuple[int, int, int]], length: dict[int, int]) -> int:
    """Symbols from the end of a text beyond which its tokens are final, whatever follows.

    A rule (x, y) at the end is uncertain over its own length. It unsettles a later rule (u, z) whose z
    starts where x starts, that is with x among the tokens at z's left edge.
    """
    left_of: dict[int, int] = {}
    reach: dict[int, int] = {}
    most = max(length.values(), default=1)
    for x, y, c in rules:
        inward, t = length[y], y
        while t is not None:
            inward = max(inward, reach.get(t, 0))
            t = left_of.get(t)
        total = length[x] + inward
        reach[x] = max(reach.get(x, 0), total)
        most = max(most, total)
        left_of.setdefault(c, x)
    return most


class Transducer:
    """Symbols in, final tokens out as soon as they are settled. ends: which symbols end a word, that is stand on the left of no merge."""

    def __init__(self, merges: Merges, length: np.ndarray, block: int = 4096, ends: np.ndarray | None = None):
        self.merges, self.length, self.block, self.ends = merges, length, block, ends
        self.held = np.zeros(0, np.int64)

    def feed(self, symbols: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(0, len(symbols), self.block):
            self.held = np.concatenate([self.held, symbols[i : i + self.block]])
            if len(self.held) > self.block + self.merges.lookahead:
                ids = self._tokens()
                ends = np.cumsum(self.length[ids])
                n = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead, side="right"))
                if n:
                    self.held = self.held[ends[n - 1] :]
                    yield ids[:n]

    def finish(self) -> np.ndarray:
        ids, self.held = self._tokens(), np.zeros(0, np.int64)
        return ids

    def _tokens(self) -> np.ndarray:
        word = np.zeros(len(self.held), np.int64)
        if self.ends is not None and len(word):
            word[1:] = np.cumsum(self.ends[self.held[:-1]])
        return self.merges.apply(self.held, word)[0]


class Decoder:
    """Ids to text, some at a time. Without a byte decoder tokens are joined by spaces; with one, bytes are
    decoded as UTF-8 incrementally, so a character may be spread over calls."""

    def __init__(self, names: list[str], byte_level: bool = False):
        import codecs

        self.names, self.byte_level, self.begun = names, byte_level, False
        self.value = {c: b for b, c in enumerate(byte_chars())} if byte_level else {}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        tokens = [self.names[i] for i in ids]
        if self.byte_level:
            return self.state.decode(bytes(self.value[c] for t in tokens for c in t), final)
        out = " " * (self.begun and bool(tokens)) + " ".join(tokens)
        self.begun |= bool(tokens)
        return out


class Coder:
    """A vocabulary of words with word ends, and its texts' normal form (NFC, white space, lower case)."""

    #: Pieces remembered at once, in each of two generations; longer pieces are not remembered.
    LIMIT, LONG = 150_000, 64
    #: Symbols that the transducer takes at once; characters of a text that are handled at once.
    STREAM, SLICE = 1 << 14, 1 << 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.names = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = t
        chars = byte_chars()
        self.symbol = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.last = np.array([vocab[c + self.end] for c in chars], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = np.array([len(t.removesuffix(self.end)) if self.end else len(t) for t in self.names], dtype=np.int64)
        length = {i: int(self.size[i]) for i in vocab.values()}
        self.merges = Merges([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], length)
        #: Tokens that end a word; None if a merge goes on after one, then words are streams of their own.
        self.ends: np.ndarray | None = np.zeros(size, bool)
        self.ends[self.last] = True
        for a, b in pairs:
            self.ends[vocab[a + b]] |= self.ends[vocab[b]]
        if self.ends[[vocab[a] for a, _ in pairs]].any() or self.ends[self.symbol].any():
            self.ends = None
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.word_with_controls = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")
        self.controls = regex.compile(r"[\x1c-\x1f]")
        #: Texts and pieces with unassigned characters take the library's own normal form and words.
        self.maybe, self.unassigned = unassigned()
        self.later_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.later_words = pre_tokenizers.Split(Regex(self.word.pattern), "removed", invert=True)
        self.space = regex.compile(r"[^\S\x1c-\x1f]+")
        self.border = regex.compile(r"[ \n](?=[0-9A-Za-z])")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def later(self, text: str) -> bool:
        """Whether it holds an unassigned character."""
        return self.maybe.search(text) is not None and self.unassigned.search("".join(set(self.maybe.findall(text)))) is not None

    def normal(self, text: str) -> str:
        if not text.isascii():
            if self.later(text):
                return self.later_normal.normalize_str(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                return "".join(c.lower() for c in text)
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Runs between white space; a piece that is a special token is marked by a leading space."""
        if self.marks is not None and "<" in text and self.marks.search(text):
            out: list[str] = []
            for k, part in enumerate(self.marks.split(text)):
                out += [" " + part] if k % 2 else self._split(part)
            return out
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        text = self.normal(text)
        return [p for p in self.space.split(text) if p] if self.controls.search(text) else text.split()

    def words(self, piece: str) -> list[str]:
        if piece.isalpha() and piece.isascii():
            return [piece]
        if not piece.isascii() and self.later(piece):
            return [w for w, _ in self.later_words.pre_tokenize_str(piece)]
        if self.controls.search(piece):
            return self.word_with_controls.findall(piece)
        return self.word.findall(piece)

    def word_ids(self, words: list[str]) -> tuple[bytes, list[int]]:
        """The tokens of all words one after another (little-endian unsigned 32-bit), all through the transducer, and where
        those of each word begin; one place more at the end."""
        raw = [w.encode() for w in words]
        if self.ends is None or not raw:
            own = [np.concatenate(list(self.stream(r))) for r in raw]
            return b"".join(x.astype("<u4").tobytes() for x in own), [0, *(4 * np.cumsum([len(x) for x in own], dtype=np.int64)).tolist()]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols, at = self.symbol[data], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) - 1
        symbols[at] = self.last[data[at]]
        machine = Transducer(self.merges, self.size, self.STREAM, self.ends)
        ids = np.concatenate([*machine.feed(symbols), machine.finish()])
        return ids.astype("<u4").tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]

    def stream(self, word: bytes) -> Iterator[np.ndarray]:
        """The tokens of one word, through the transducer."""
        machine = Transducer(self.merges, self.size)
        data = np.frombuffer(word, dtype=np.uint8)
        for i in range(0, len(data) - 1, self.STREAM):
            yield from machine.feed(self.symbol[data[i : min(i + self.STREAM, len(data) - 1)]])
        yield from machine.feed(self.last[data[-1:]])
        yield machine.finish()

    def learn(self, pieces: list[str]) -> None:
        """Remembers the ids of new pieces."""
        words: dict[str, int] = {}
        number, young = words.setdefault, self.young
        plain, other = [], []
        for p in pieces:
            if p.isalpha() and p.isascii():
                plain.append((p, number(p, len(words))))
            else:
                other.append((p, None if p[:1] == " " else [number(w, len(words)) for w in self.words(p)]))
        ids, at = self.word_ids(list(words))
        for p, k in plain:
            young[p] = ids[at[k] : at[k + 1]]
        for p, own in other:
            young[p] = np.array([self.special[p[1:]]], "<u4").tobytes() if own is None else b"".join([ids[at[k] : at[k + 1]] for k in own])

    def slices(self, text: str) -> list[str]:
        """A long text in slices, cut before a letter or digit that follows a space or line end: no word, special
        token or composed character goes over such a place."""
        out, a = [], 0
        while len(text) - a > self.SLICE and (m := self.border.search(text, a + self.SLICE)):
            out.append(text[a : m.end()])
            a = m.end()
        return [*out, text[a:]] if a else [text]

    def coded(self, texts: list[str], with_output: bool = False) -> list[tuple]:
        """For each text the number of ids, the SHA-256 of ids and decoded text and, if wanted, both: slice by slice, so that
        of a very long text only a slice is held in other forms."""
        out = []
        for short, group in itertools.groupby(texts, lambda t: len(t) <= self.SLICE):
            if short:
                out += [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), *((ids, text) if with_output else ())) for ids, text in self.code(list(group))]
                continue
            for t in group:
                n, digests, kept, decoder = 0, (hashlib.sha256(), hashlib.sha256()), ([], []), Decoder(self.names)
                for s in self.slices(t):
                    ((ids, text),) = self.code([s], decoder)
                    both = ids, text
                    n += len(ids) // 4
                    for x, h, k in zip(both, digests, kept):
                        h.update(x)
                        if with_output:
                            k.append(x)
                out.append((n, digests[0].hexdigest(), digests[1].hexdigest(), *((b"".join(kept[0]), b"".join(kept[1])) if with_output else ())))
        return out

    def code(self, texts: list[str], decoder: "Decoder | None" = None) -> list[tuple[bytes, bytes]]:
        """The ids (little-endian unsigned 32-bit) of each text and what Decoder, a new one or the one given, makes of them (UTF-8)."""
        split = [self.pieces(t) for t in texts]
        young = self.young
        missing = set().union(*split) - young.keys()
        again = {p: self.old[p] for p in missing if p in self.old}
        young.update(again)
        self.learn([p for p in missing if p not in again])
        out = []
        for own in split:
            ids = b"".join(map(young.__getitem__, own))
            out.append((ids, (decoder or Decoder(self.names)).feed(np.frombuffer(ids, "<u4").tolist(), decoder is None).encode()))
        for p in missing:
            if len(p) > self.LONG:
                young.pop(p, None)
        if len(young) > self.LIMIT:
            self.young, self.old = {}, young
        return out


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def code(docs: DataFrame, path: str | None = None, with_output: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, the SHA-256 of its ids and of the decoded text and, if
    with_output, ids (array<int>) and decoded.

    Null texts are empty; an empty text has no tokens. Rows without doc_id are left out, repeated rows come
    out repeated, an empty table gives no rows. Other columns are not read.
    """
    path = path or vocabulary("word_bpe_49k.json")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_output
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * with_output

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = []
                for doc, (n, ids_sha, text_sha, *output) in zip(part.column(0).to_pylist(), c.coded(part.column(1).to_pylist(), with_output)):
                    rows.append((doc, n, ids_sha, text_sha, *((np.frombuffer(output[0], "<u4").astype(np.int32), output[1].decode()) if with_output else ())))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    return id_text(docs).mapInArrow(run, SCHEMA + ", ids array<int>, decoded string" * with_output)
