"""Exact top-k inner products by term-at-a-time accumulation.

Vectors become sparse rows of integer weights. A block of candidates is kept as postings: for each term
the places and weights of the vectors that hold it. For a block of queries each term's weights are
scattered, times its postings, into a dense array of scores; partition selection keeps the best k of the
block, and the blocks' lists are merged. Every candidate is scored for every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SCHEMA = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """vec_id and floor(factor * x) of each component as w; vectors that are null or hold null or non-finite
    components are left out, as are rows without vec_id."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * factor)).alias("w"))


class Postings:
    """Candidates by term."""

    def __init__(self, ids: np.ndarray, rows: list):
        self.ids = ids
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        weight = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        term = np.concatenate([np.arange(n) for n in lengths]) if len(rows) else np.zeros(0, np.int64)
        place = np.repeat(np.arange(len(rows)), lengths)
        use = weight != 0
        weight, term, place = weight[use], term[use], place[use]
        order = np.argsort(term, kind="stable")
        self.weight, self.place = weight[order], place[order]
        self.at = np.searchsorted(term[order], np.arange((int(lengths.max()) if len(rows) else 0) + 1))

    def term(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        return self.place[self.at[t] : self.at[t + 1]], self.weight[self.at[t] : self.at[t + 1]]

    def best(self, query_ids: np.ndarray, queries: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its k highest scores among the candidates but itself, ties to smaller ids."""
        n, terms = len(self.ids), len(self.at) - 1
        score = np.zeros((len(queries), n), np.int64)
        lists = [self.term(t) for t in range(terms)]
        full = [np.zeros(n, np.int64) if len(p) > n // 4 else None for p, _ in lists]
        for f, (p, w) in zip(full, lists):
            if f is not None:
                f[p] = w
        own = np.zeros((len(queries), terms), np.int64)
        for i, q in enumerate(queries):
            own[i, : min(terms, len(q))] = q[:terms]
        # term at a time; a block of queries small enough for its scores to stay in cache
        for i in range(0, len(queries), 4):
            block = score[i : i + 4]
            for t in range(terms):
                for r in np.flatnonzero(own[i : i + 4, t]):
                    if full[t] is not None:
                        block[r] += own[i + r, t] * full[t]
                    else:
                        p, w = lists[t]
                        block[r, p] += own[i + r, t] * w
        for i, q in enumerate(query_ids):
            s, ids = score[i], self.ids
            keep = ids != q
            if not keep.all():
                s, ids = s[keep], ids[keep]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                above = np.flatnonzero(s > least)
                level = np.flatnonzero(s == least)
                level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
                take = np.concatenate([above, level])
                s, ids = s[take], ids[take]
            yield q, ids, s


#: Query blocks that one task takes.
TOGETHER = 8


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 8192, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row of queries with the rows of
    vectors but its own (both: vec_id, w), ties to the smaller vec_id; all, if fewer.

    Candidates lie in blocks by a hash of vec_id, queries too; a task has one block of candidates and TOGETHER
    blocks of queries, so neither side of it grows with the tables. Other columns are not read. Of rows with equal vec_id all are candidates and, as
    they cannot be told apart, queries with equal vec_id answer as one, by the smallest w. Empty tables
    give no rows.
    """
    spark = vectors.sparkSession
    vectors = saved(vectors.select("vec_id", "w"))
    n = vectors.count()
    blocks = max(1, -(-n // block))
    queries = queries.groupBy("vec_id").agg(F.min("w").alias("w"))
    n_blocks = max(1, -(-queries.count() // query_block))
    packed = (
        queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
        .groupBy("q").agg(F.collect_list(F.struct("vec_id", "w")).alias("rows"))
        .select("q", "rows", F.floor(F.col("q") / TOGETHER).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    )
    candidates = vectors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((n_blocks - 1) // TOGETHER))))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = [pa.array([], pa.int64())] * 3
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays(empty, names=["query_id", "vec_id", "score"])
        index = Postings(left["vec_id"].to_numpy(), left["w"].to_pandas().tolist())
        out: list[tuple] = []
        for rows in right["rows"]:
            rows = rows.as_py()
            out += [(np.full(len(ids), q), ids, s) for q, ids, s in index.best(np.array([r["vec_id"] for r in rows]), [r["w"] for r in rows], k)]
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"])

    found = candidates.groupBy("b", "part").cogroup(packed.groupBy("b", "part")).applyInArrow(score, SCHEMA)
    best = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"))
    merged = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(best)), 1, k).alias("best"))
    return merged.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.v").alias("vec_id"), (-F.col("x.s")).alias("score"))


def brute(vectors: pd.DataFrame, query_ids: list[int], k: int) -> list[tuple]:
    """The same over a small frame (vec_id, w), for tests."""
    out = []
    for q in query_ids:
        w = np.array(vectors.loc[vectors.vec_id == q, "w"].iloc[0])
        scored = sorted((-int(np.dot(w, r.w)), r.vec_id) for r in vectors.itertuples() if r.vec_id != q)[:k]
        out += [(q, i + 1, v, -s) for i, (s, v) in enumerate(scored)]
    return out
