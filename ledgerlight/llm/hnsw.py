"""Near-duplicate vectors by navigable small-world graphs.

Vectors of one label lie in shards; each shard builds a hierarchical navigable small-world graph of its
own. Every vector queries every shard of its label. The beam goes on while it meets vectors near the
threshold, so large groups are followed whole; a sample of queries is compared with brute force and the
beam widened until they agree. Links are those with cosine >= threshold in double precision.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Union, components, mixed, parts, saved

#: Shards whose vectors ask a graph in one task.
TOGETHER = 8
SCHEMA = "vec_id long, n_links long, component_id long, kept boolean"


class Graph:
    """A hierarchical navigable small-world graph over unit rows; inner products are similarities."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, m: int = 10, build_beam: int = 32):
        self.rows, self.m, n = rows, m, len(rows)
        u = (mixed(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        self.level = np.minimum((-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int), 8)
        self.near: list[dict[int, list[int]]] = [{} for _ in range(int(self.level.max()) + 1)] if n else []
        self.ways: list[dict[int, int]] = [{} for _ in self.near]
        self.seen, self.mark = np.zeros(n, np.int64), 0
        self.top = -1
        for i in range(n):
            self._insert(i, build_beam)

    def _insert(self, i: int, beam: int) -> None:
        q, level = self.rows[i], int(self.level[i])
        if self.top < 0:
            for k in range(level + 1):
                self.near[k][i] = []
            self.top = i
            return
        at = [(float(self.rows[self.top] @ q), self.top)]
        high = int(self.level[self.top])
        for k in range(high, level, -1):
            at = self.beam(q, at, 1, k)
        for k in range(min(high, level), -1, -1):
            at = self.beam(q, at, beam, k)
            most = self.m * (2 if k == 0 else 1)
            chosen = self._diverse(at, self.m)
            self.near[k][i] = chosen
            ways = self.ways[k]
            for j in chosen:
                ways[j] = ways.get(j, 0) + 1
            for j in chosen:
                other = self.near[k][j]
                other.append(i)
                ways[i] = ways.get(i, 0) + 1
                if len(other) > most:
                    s = self.rows[other] @ self.rows[j]
                    kept = self._diverse(sorted(zip(s.tolist(), other), reverse=True), most)
                    for x in set(other).difference(kept):
                        # the last way to a row stays, or nothing would find it
                        if ways[x] == 1:
                            kept.append(x)
                        else:
                            ways[x] -= 1
                    self.near[k][j] = kept
        for k in range(high + 1, level + 1):
            self.near[k][i] = []
        if level > high:
            self.top = i

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, leaving out what is nearer to one already chosen; the nearest of the rest fill up."""
        if len(found) <= most:
            return [j for _, j in found]
        ids = [j for _, j in found]
        rows = self.rows[ids]
        sim = rows @ rows.T
        chosen: list[int] = []
        closest = np.full(len(ids), -2.0)
        for c, (s, _) in enumerate(found):
            if closest[c] < s:
                chosen.append(c)
                if len(chosen) == most:
                    break
                np.maximum(closest, sim[c], out=closest)
        if len(chosen) < most:
            taken = set(chosen)
            chosen += [c for c in range(len(ids)) if c not in taken][: most - len(chosen)]
        return [ids[c] for c in chosen]

    def beam(self, q: np.ndarray, entries: list[tuple[float, int]], width: int, level: int, floor: float = 2.0) -> list[tuple[float, int]]:
        """The best `width` found, and all met at `floor` or above, best first."""
        self.mark += 1
        seen, near, rows, mark = self.seen, self.near[level], self.rows, self.mark
        for _, j in entries:
            seen[j] = mark
        todo = [(-s, j) for s, j in entries]
        heapq.heapify(todo)
        best = list(entries)
        heapq.heapify(best)
        above: list[tuple[float, int]] = []
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0] and -s < floor:
                break
            new = np.array(near[j], dtype=np.int64)
            new = new[seen[new] != mark]
            if not len(new):
                continue
            seen[new] = mark
            for sim, x in zip((rows[new] @ q).tolist(), new.tolist()):
                if len(best) < width or sim > best[0][0] or sim >= floor:
                    heapq.heappush(todo, (-sim, x))
                    heapq.heappush(best, (sim, x))
                    if len(best) > width:
                        out = heapq.heappop(best)
                        if out[0] >= floor:
                            above.append(out)
        return sorted(best + above, reverse=True)

    def query(self, q: np.ndarray, width: int, floor: float, also: int = -1) -> list[tuple[float, int]]:
        """From the top down; where q is a row of the graph itself, from that row too."""
        at = [(float(self.rows[self.top] @ q), self.top)]
        for k in range(int(self.level[self.top]), 0, -1):
            at = self.beam(q, at, 1, k)
        if also >= 0 and all(j != also for _, j in at):
            at.append((float(self.rows[also] @ q), also))
        return self.beam(q, at, width, 0, floor)


def linked(graph: Graph, queries: np.ndarray, of_node: np.ndarray, threshold: float, width: int = 16, slack: float = 0.02, least_recall: float = 0.99, audit: int = 512) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(queries, rows of the graph, which of them have inner product >= threshold), each query once.

    of_node: the query that a row of the graph is, or -1. A query's beam follows all within twice the angle
    of the threshold; these hold whatever links with a row that links with it, so such rows are answered
    with it. What `audit` queries are answered, whichever way, is checked against all rows, a query's own row
    left out; below `least_recall` the beam and the slack are doubled, and a beam as wide as the graph is exact."""
    sample = np.arange(0, len(queries), max(1, len(queries) // audit))
    double = 2 * threshold * threshold - 1
    node_of = np.full(len(queries), -1)
    node_of[of_node[of_node >= 0]] = np.flatnonzero(of_node >= 0)

    def pool(i: int) -> list[tuple[float, int]]:
        return graph.query(queries[i], width, double - slack, int(node_of[i]))

    true = {}
    for i in sample.tolist():
        hit = graph.rows @ queries[i] >= threshold
        true[i] = int(hit.sum()) - int(node_of[i] >= 0 and hit[node_of[i]])
    while True:
        out, got = [], 0
        done = np.zeros(len(queries), bool)
        for i in range(len(queries)):
            if done[i]:
                continue
            near = pool(i)
            rows = np.array([j for _, j in near], dtype=np.int64)
            with_it = of_node[rows[np.array([s for s, _ in near]) >= threshold]]
            own = np.unique(np.append(with_it[(with_it >= 0)], i))
            own = own[~done[own]]
            done[own] = True
            for k in range(0, len(own), 512):
                part = own[k : k + 512]
                hit = queries[part] @ graph.rows[rows].T >= threshold
                out.append((part, rows, hit))
                got += sum(int((hit[r] & (rows != node_of[q])).sum()) for r, q in enumerate(part.tolist()) if q in true)
        if got >= least_recall * sum(true.values()) or width >= len(graph.rows):
            return out
        width, slack = 2 * width, 2 * slack


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors (vec_id, embedding, label).

    Vectors are compared within a label. A task has one shard and the queries of at most TOGETHER shards, so
    a label may have any number of vectors. An empty table gives no rows; other columns are not read. Null labels; vectors that are null, empty, zero or hold null or
    non-finite components; and vectors of another length link with nothing. Equal vectors of a label stand
    in the graphs once and link with each other. Rows with equal vec_id are one vertex of the component
    but keep their own rows. Rows without vec_id are left out.
    """
    x = F.col("embedding")
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = x.isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = saved(rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("key", F.when(F.col("good"), F.transform(x, lambda v: v.cast("double") + 0.0))).drop("embedding"))
    usable = rows.where("good")
    alone = usable.groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    counts = alone.groupBy("label", F.size("key").alias("dims")).agg(F.count("*").alias("n"))
    shards = F.ceil(F.col("n") / shard).cast("int")
    unique = saved(alone.withColumn("dims", F.size("key")).join(counts, ["label", "dims"]).withColumn("shards", shards).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int")).drop("n"))
    part = lambda own: F.floor(own / TOGETHER).cast("int")
    asks = unique.withColumn("part", part(F.col("own"))).withColumn("own", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    graphs = unique.withColumn("part", F.explode(F.sequence(F.lit(0), part(F.col("shards") - 1))))

    def unit(t: pa.Table) -> np.ndarray:
        a = np.array(t["key"].combine_chunks().values.to_numpy(), dtype=np.float64).reshape(t.num_rows, -1)
        a /= np.abs(a).max(axis=1, keepdims=True)
        return a / np.sqrt((a * a).sum(axis=1, keepdims=True))

    def answer(members: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["rep", "links", "near"]
        if not members.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, names=names)
        members, queries = members.sort_by("rep"), queries.sort_by("rep")
        ids, copies, asking = members["rep"].to_numpy(), members["copies"].to_numpy(), queries["rep"].to_numpy()
        asks = {int(v): k for k, v in enumerate(asking)}
        of_node = np.array([asks.get(int(v), -1) for v in ids])
        place = {int(v): k for k, v in enumerate(np.unique(np.concatenate([ids, asking])))}
        groups, every = Union(len(place)), np.array(list(place))
        links = np.zeros(len(asking), np.int64)
        node_of = np.full(len(asking), -1)
        node_of[of_node[of_node >= 0]] = np.flatnonzero(of_node >= 0)
        # links within the shard hold both ways, whichever end found them; a bit a pair of the shard's rows
        both = np.zeros((len(ids), len(ids)), bool)
        for part, rows, hit in linked(Graph(unit(members), ids), unit(queries), of_node, threshold):
            hit &= ids[rows][None, :] != asking[part][:, None]
            here = node_of[part] >= 0
            both[np.ix_(node_of[part[here]], rows)] = hit[here]
            links[part[~here]] = hit[~here] @ copies[rows]
            for q in np.flatnonzero(hit.any(axis=1)).tolist():
                groups.join(place[int(asking[part[q]])], place[int(ids[rows[hit[q].argmax()]])])
            for r in np.flatnonzero(hit.any(axis=0)).tolist():
                groups.join(place[int(ids[rows[r]])], place[int(asking[part[hit[:, r].argmax()]])])
        both |= both.T
        links[of_node[of_node >= 0]] = both[of_node >= 0] @ copies
        near = np.array([every[groups.root(place[q])] for q in asking.tolist()])
        return pa.Table.from_arrays([pa.array(asking), pa.array(links), pa.array(near)], names=names)

    keys = ["label", "dims", "own", "part"]
    p = max(parts(vectors.sparkSession), 24)
    # dealt by number, so that small tables too are spread over all cores
    members, asks = graphs.repartition(p, *keys), asks.repartition(p, *keys)
    found = saved(members.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(answer, "rep long, links long, near long"))
    of = components(found.select(F.col("rep").alias("a"), F.col("near").alias("b"))).withColumnRenamed("id", "rep")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    unique = unique.join(sums, "rep", "left").join(of, "rep", "left").select("label", "key", "copies", F.col("links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.join(unique, ["label", "key"], "left")
    return joined.select(
        "vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("component", "vec_id") == F.col("vec_id")).alias("kept")
    )
