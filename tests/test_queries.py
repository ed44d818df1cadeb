"""Every query with SQL against DuckDB over the smallest tables; the others have rows, and numbers that are finite."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerlight import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)) or x is pd.NA:
        return "~"
    if hasattr(x, "year"):
        return str(x)[:10]
    return f"{float(x) + 0.0:.6f}" if isinstance(x, (float, np.floating)) or type(x).__name__ == "Decimal" else str(x)


def rows(df, floats):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(float(x)) if c in floats and cell(x) != "~" else cell(x) for c, x in zip(df.columns, r)) for r in df.astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, SF).toPandas(), duck.execute(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    floats = {c for c in got.columns for d in (got, want) if d[c].dtype.kind == "f"}
    assert rows(got, floats) == rows(want, floats)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES) - {"select_k", "gbt_oof", "gmm_segments", "bic_choice"}))
def test_runs(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    assert len(got) and len(set(got.columns)) == len(got.columns)
    for c in got.columns:
        if got[c].dtype.kind == "f":
            assert np.isfinite(got[c].dropna()).all() and got[c].notna().any(), c


def test_every_name_has_its_columns_once(spark):
    for name in ("hit_metrics_total", "timing_block", "category_distribution"):
        c = Q.QUERIES[name](spark, SF).columns
        assert len(c) == len(set(c))


def test_shared_tokens_use_every_edge(spark, tmp_path):
    """Brute force over customers and quantities that an id or quantity filter would drop."""
    lines = [(k, c, s) for k, (c, s) in enumerate([(1, 7), (1, 8), (1, 8), (2, 7), (2, 9), (3, 8), (3, 9), (20, 7), (21, 5)])]
    spark.createDataFrame([(k, c, "1-URGENT", "2000-01-01") for k, c, _ in lines], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, s, 2.0, "N") for k, _, s in lines], "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    sets: dict[int, set[int]] = {}
    for _, c, s in lines:
        sets.setdefault(c, set()).add(s)
    degrees = {a: sum(a != b and bool(sets[a] & sets[b]) for b in sets) for a in sets}
    assert {r.o_custkey: r.degree for r in Q.QUERIES["shared_token_degree"](spark, str(tmp_path)).collect()} == degrees
    pairs = {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    assert {(r.a, r.b): (r.common, r.jaccard) for r in Q.QUERIES["jaccard_pairs"](spark, str(tmp_path)).collect()} == pairs
