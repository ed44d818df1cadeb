import numpy as np
import pandas as pd
import pytest

from ledgerlight.llm import hnsw, topk


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(400):
        v = r.normal(size=16)
        if k % 10 < 4 and k >= 10:
            v = np.array(rows[k % 10][1]) * (1 + k % 3) + r.normal(size=16) * 0.02 * (k % 7)
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(k % 3)))
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, rows[0][1], None), (505, rows[0][1], 0), (506, rows[0][1], 0), (507, [float("inf")] * 16, 2), (508, [1.0, 2.0], 1), (None, rows[0][1], 0), (506, rows[0][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' AS key", "1 AS rep", "2 AS links")


def usable(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("shard", [8192, 40, 7])
def test_near_duplicates(vectors, shard):
    rows = [r for r in vectors.collect() if r.vec_id is not None]
    unit = [np.array(r.embedding, float) / np.linalg.norm(np.array(r.embedding, float)) if usable(r.embedding) and r.label is not None else None for r in rows]
    up = {r.vec_id: r.vec_id for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and a.label == b.label and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                x, y = sorted((root(a.vec_id), root(b.vec_id)))
                up[y] = x
    got = hnsw.near_duplicates(vectors, shard=shard).collect()
    want = sorted((r.vec_id, n, root(r.vec_id)) for r, n in zip(rows, links))
    have = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum(n for _, n, _ in have) >= 0.99 * sum(links) and sum(links) > 100
    assert [(v, c) for v, _, c in have] == [(v, c) for v, _, c in want]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    if shard > 40:
        assert hnsw.near_duplicates(vectors.where("vec_id < 0")).count() == 0


def test_topk(vectors, spark):
    v = topk.quantised(vectors)
    frame = v.toPandas().drop_duplicates("vec_id")
    queries = [k for k in frame.vec_id if k % 20 == 0]
    one = v.where("vec_id <> 508").dropDuplicates(["vec_id"])
    frame = frame[frame.vec_id != 508]
    for block in (8192, 50):
        got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(one, one.where("vec_id % 20 = 0"), 20, block, 4).collect())
        assert got == sorted(topk.brute(frame, queries, 20))
    few = one.where("vec_id < 5")
    assert topk.search(few, few.where("vec_id = 0")).count() == 4
    assert topk.search(few.where("vec_id < 0"), few.where("vec_id < 0")).count() == 0


def test_postings_skip_zeros_and_other_lengths():
    p = topk.Postings(np.array([1, 2, 3]), [[0, 2], [1, 0], [3]])
    got = list(p.best(np.array([1]), [[5, 1, 9]], 2))
    assert [(q, dict(zip(ids.tolist(), s.tolist()))) for q, ids, s in got] == [(1, {2: 5, 3: 15})]
    assert topk.brute(pd.DataFrame({"vec_id": [1, 2], "w": [[1], [2]]}), [1], 5) == [(1, 1, 2, 2)]
