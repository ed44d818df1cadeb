"""Similarity join on word n-grams by signature trees.

A document is its set of shingles. Equal sets are one vertex. Vertices that share a least shingle under any
of `BANDS` hash orders meet in a block; a pair at the threshold t misses all of them with probability
(1 - t) ** BANDS (9e-13 at 0.75). In a block vertices lie in a signature tree: a node holds the OR of its
members' bitmaps and the range of their sizes. The tree is traversed against itself; a pair of nodes whose
sizes are too far apart, or whose bitmaps leave too little possible overlap, is cut off whole. A pair of rows
must also agree in some of its least shingles (AGREE). Surviving pairs are joined to candidate families by a spanning forest, so a group of n costs n rows.
The sets of each family, in shards of bounded size, go through the same dual traversal again with wider
bitmaps, where a pair that is not yet connected is verified exactly on its sets; where links are counted,
every possible pair is, and a task gives one number for each vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, Union, column, components, grouped, id_text, lowered, mixed, parts, runs, saved, signed, text_chunks, tidy, word_hashes, word_spans

#: Hash orders; 64-bit words of a bitmap in blocks and in families; rows of a leaf.
BANDS, NARROW, WIDE, LEAF = 20, 8, 64, 32
#: Least shingles, of BANDS, that a pair must have in common (by 8 bits of each): at 0.75 fewer have a chance of 3e-8.
AGREE = 4
_ORDERS = np.random.default_rng(7).integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted hashes of its distinct n-word shingles, lower-cased; fewer words are one shingle."""
    data = lowered(data)
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    spans = Spans(words)
    counts = np.diff(first)
    at = np.arange(max(0, len(words) - n + 1))
    whole = spans.of(at, at + n) if len(at) else np.zeros(0, np.uint64)
    out = []
    for a, c in zip(first[:-1].tolist(), counts.tolist()):
        if c >= n:
            out.append(np.unique(whole[a : a + c - n + 1]))
        else:
            out.append(spans.of(np.array([a]), np.array([a + c])) ^ np.uint64(c) if c else np.zeros(0, np.uint64))
    return out


def bitmap(shingles: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[(shingles >> np.uint64(20)) % np.uint64(words * 64)] = 1
    return np.packbits(out).view(np.uint64)


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; an empty one has zeros."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, some = np.concatenate([*sets, np.zeros(0, np.uint64)]), size > 0
    at, out = (np.cumsum(size) - size)[some], np.zeros((2, len(sets)), np.uint64)
    if len(at):
        out[:, some] = [np.add.reduceat(mixed(flat ^ np.uint64(c)), at) for c in (1, 2)]
    return out[0], out[1]


def bands(sizes) -> np.ndarray:
    return (np.log(np.maximum(1, sizes)) / np.log(4 / 3)).astype(int)


def sort_keys(shingles: np.ndarray) -> tuple[int, int]:
    """Size band and a least hash: neighbours in this order are likely to be alike."""
    return int(bands(len(shingles))), int(mixed(shingles ^ _ORDERS[0]).min() >> np.uint64(1))


class SignatureTree:
    """Rows in a given order; levels of nodes, each over `fan` below, with ORed bitmaps and size ranges.

    A node also has the most shingles that its members hold beyond one for each bit: those can hide in
    bits that are shared."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, order: np.ndarray, fan: int = LEAF, codes: np.ndarray | None = None):
        self.order, self.fan = order, fan
        self.codes = None if codes is None else codes[order]
        sizes, maps = sizes[order], maps[order]
        self.levels = [(sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), maps)]
        while len(self.levels[-1][0]) > 1:
            low, high, hidden, m = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at), np.bitwise_or.reduceat(m, at, axis=0)))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of rows that size and bitmap leave possible, a pair of leaves at a time."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)] if top else []
        while todo:
            level, a, b = todo.pop()
            n = len(self.levels[level - 1][0])
            x = np.arange(a * self.fan, min((a + 1) * self.fan, n))
            y = x if a == b else np.arange(b * self.fan, min((b + 1) * self.fan, n))
            i, j = np.nonzero(self.possible(level - 1, x, y, percent))
            i, j = x[i], y[j]
            if level == 1:
                keep = i < j
                if keep.any():
                    yield self.order[i[keep]], self.order[j[keep]]
            else:
                keep = i <= j
                todo += [(level - 1, p, q) for p, q in zip(i[keep].tolist(), j[keep].tolist())]

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether members of nodes x and y can reach 100 * overlap >= percent * union.

        Shared shingles lie in bits that both nodes have: at most one for each such bit and those hidden."""
        low, high, hidden, maps = self.levels[level]
        most = np.minimum.outer(high[x], high[y])
        shared = np.array([np.bitwise_count(m & maps[y]).sum(axis=1, dtype=np.int64) for m in maps[x]]).reshape(len(x), len(y))
        most = np.minimum(most, shared + np.minimum.outer(hidden[x], hidden[y]))
        fits = (100 + percent) * most >= percent * np.add.outer(low[x], low[y])
        if level == 0 and self.codes is not None and fits.any():
            fits &= (self.codes[x][:, None, :] == self.codes[y][None, :, :]).sum(axis=2) >= AGREE
        return fits


def signatures(docs: DataFrame, n: int = 5) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set, the least shingle under each order, bitmap and sort keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_chunks(batch):
                sets = shingle_sets(data, offsets, n)
                size = np.array([len(s) for s in sets])
                flat, some = np.concatenate([*sets, np.zeros(0, np.uint64)]), size > 0
                at = (np.cumsum(size) - size)[some]
                (k1, k2), keys = set_hashes(sets), np.zeros((BANDS, j - i), np.uint64)
                if len(at):
                    for b, o in enumerate(_ORDERS):
                        keys[b, some] = np.minimum.reduceat(mixed(flat * o), at) * np.uint64(2 * BANDS + 1) + np.uint64(b)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(keys.T)).ravel()))
                codes = np.ascontiguousarray((mixed(keys) & np.uint64(255)).astype(np.uint8).T)
                order = [sort_keys(s) if len(s) else (0, 0) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(size, pa.int64()), pa.array(signed(k1)), pa.array(signed(k2)), rows, pa.array([bitmap(s, NARROW).tobytes() + c.tobytes() for s, c in zip(sets, codes)], pa.binary()), pa.array([o[1] for o in order], pa.int64())],
                    names=["doc_id", "n_shingles", "k1", "k2", "keys", "map", "o2"],
                )

    return id_text(docs).mapInArrow(tidy(run), "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>, map binary, o2 long")


def forest(percent: int):
    """Links of a spanning forest of the possible pairs in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "key"):
            key, ids, sizes, o2 = (rows[c].to_numpy() for c in ("key", "doc_id", "n_shingles", "o2"))
            o1 = bands(sizes)
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            out: list[tuple[int, int]] = []
            maps = rows["map"].to_pylist()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if b - a < 2:
                    continue
                own, groups = ids[a:b].tolist(), Union(b - a)
                raw = np.frombuffer(b"".join(maps[a:b]), np.uint8).reshape(b - a, 8 * NARROW + BANDS)
                tree = SignatureTree(sizes[a:b], np.ascontiguousarray(raw[:, : 8 * NARROW]).view(np.uint64), np.lexsort((o2[a:b], o1[a:b])), codes=raw[:, 8 * NARROW :])
                for i, j in tree.pairs(percent):
                    out += [(own[x], own[y]) for x, y in zip(i.tolist(), j.tolist()) if groups.join(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return tidy(run)


def overlap_linked(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """For pairs i, j of sets that are not empty, whether 100 * overlap >= percent * union. Few sets in many pairs: a pair of leaves."""
    left, a = np.unique(i, return_inverse=True)
    right, b = np.unique(j, return_inverse=True)
    size = np.array([len(sets[y]) for y in right])
    known, ids = np.unique(np.concatenate([sets[y] for y in right]), return_inverse=True)
    common = np.empty((len(left), len(right)), np.int64)
    for row, x in zip(common, left.tolist()):
        at = np.minimum(np.searchsorted(known, sets[x]), len(known) - 1)
        held = np.zeros(len(known), np.int64)
        held[at[known[at] == sets[x]]] = 1
        row[:] = np.add.reduceat(held[ids], np.cumsum(size) - size)
    both = np.array([len(sets[x]) for x in left])[a] + size[b]
    return (100 + percent) * common[a, b] >= percent * both


def verified(percent: int, n: int, count: bool):
    """Between the two parts of each shard (equal parts: within), links of a spanning forest of the true pairs as
    (a, b); with `count` also, for each vertex that has links there, a = b and n, the rows that it links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, "shard"):
            ids, side, own = rows["doc_id"].to_numpy(), rows["side"].to_numpy(), rows["own"].to_pylist()
            sets = [s for b in rows.to_batches() for _, _, data, offsets in text_chunks(b) for s in shingle_sets(data, offsets, n)]
            k1, k2 = (signed(k).tolist() for k in set_hashes(sets))
            # a row of a repeated doc_id whose set another document stands for, or that was met, is no vertex
            met: dict[tuple[int, int, int], int] = {}
            for at, (doc, a, b) in enumerate(zip(ids.tolist(), k1, k2)):
                if any(o["k1"] == a and o["k2"] == b for o in own[at]):
                    met.setdefault((doc, a, b), at)
            at = np.array(list(met.values()), np.int64)
            ids, side, sets = ids[at], side[at], [sets[x] for x in at.tolist()]
            weight = np.array([o["copies"] for x, (_, a, b) in zip(at.tolist(), met) for o in own[x] if o["k1"] == a and o["k2"] == b], np.int64)
            sizes, keys = np.array([len(s) for s in sets]), np.array([sort_keys(s) for s in sets])
            groups, degree = Union(len(ids)), np.zeros(len(ids), np.int64)
            out: list[tuple[int, int]] = []
            tree = SignatureTree(sizes, np.array([bitmap(s, WIDE) for s in sets]), np.lexsort((keys[:, 1], keys[:, 0])))
            for i, j in tree.pairs(percent):
                keep = (side[i] != side[j]) | (side[i] == 2)
                if not count:
                    keep &= np.array([groups.root(x) != groups.root(y) for x, y in zip(i.tolist(), j.tolist())])
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                true = overlap_linked(sets, i, j, percent)
                i, j = i[true], j[true]
                np.add.at(degree, i, weight[j])
                np.add.at(degree, j, weight[i])
                out += [(int(ids[x]), int(ids[y])) for x, y in zip(i.tolist(), j.tolist()) if groups.join(x, y)]
            some = np.flatnonzero(degree) if count else np.zeros(0, np.int64)
            keys = list(met)
            table = [(a, b, 0, 0, 0) for a, b in out] + [(keys[x][0], *keys[x], int(degree[x])) for x in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in table], pa.int64()) for k in range(5)], names=["a", "b", "k1", "k2", "n"])

    return tidy(run)


def similar(docs: DataFrame, n: int = 5, percent: int = 75, shard: int = 2048, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs; component_id is the smallest doc_id that
    links lead to, where two documents link at 100 * overlap >= percent * union. With `links` also n_links, the
    other rows that a row links to directly (copies each count, as do rows of its own doc_id).

    Null texts and texts without words have no shingle and link with nothing. Rows with equal doc_id are
    one vertex of the component and keep their own rows. Rows without doc_id are left out; an empty table
    gives no rows. A family of more than `shard` vertices is verified in pairs of parts, so that no task
    holds more than two parts. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = id_text(docs)
    sets = saved(signatures(docs, n))
    full = sets.where("n_shingles > 0")
    key = ["k1", "k2", "n_shingles"]
    # one vertex for each set, with what it needs, in one exchange
    reps = saved(full.groupBy(*key).agg(F.min_by(F.struct("doc_id", "keys", "map", "o2"), "doc_id").alias("v"), F.count("*").alias("copies")).select(*key, "copies", F.col("v.doc_id").alias("rep"), "v.keys", "v.map", "v.o2"))
    linked = full.select("doc_id", *key).join(reps.select(*key, "rep").hint("merge"), key)
    p = parts(spark)
    met = reps.select(F.explode("keys").alias("key"), F.col("rep").alias("doc_id"), "n_shingles", "map", "o2").repartition(p, "key").sortWithinPartitions("key")
    candidates = saved(met.mapInArrow(forest(percent), "a long, b long").distinct())
    family = components(candidates)
    sizes = family.groupBy("component").agg(F.count("*").alias("n")).withColumn("cells", F.ceil(F.col("n") / shard).cast("int"))
    own = reps.groupBy(F.col("rep").alias("id")).agg(F.collect_list(F.struct("k1", "k2", "copies")).alias("own"))
    member = family.join(sizes, "component").join(own, "id").withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int"))
    # every pair of parts of a family is a shard of its own; a part alone (side 2) is compared with itself
    member = member.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    member = member.select(F.col("id").alias("doc_id"), "own", F.when(F.col("cell") == F.col("other"), 2).when(F.col("cell") < F.col("other"), 0).otherwise(1).alias("side"), F.xxhash64("component", F.least("cell", "other"), F.greatest("cell", "other")).alias("shard"))
    # by merge at every size, as the members grow with the documents
    shards = docs.join(member.hint("merge"), "doc_id").repartition(p, "shard").sortWithinPartitions("shard")
    true = saved(shards.mapInArrow(verified(percent, n, links), "a long, b long, k1 long, k2 long, n long"))
    copies = linked.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    of = components(true.select("a", "b").where("a <> b").union(copies)).withColumnRenamed("id", "doc_id")
    if not links:
        return sets.select("doc_id", "n_shingles").join(of, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    others = true.where("n > 0").groupBy(F.col("a").alias("rep"), "k1", "k2").agg(F.sum("n").alias("n"))
    n_links = reps.join(others, ["rep", "k1", "k2"], "left").select(*key, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    rows = sets.select("doc_id", *key).join(n_links.hint("merge"), key, "left").join(of, "doc_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
