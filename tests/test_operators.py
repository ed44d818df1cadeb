import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.config import Roles, Settings
from ledgerlight.functions import clean, stats
from ledgerlight.operators import accounts, curves, encode, models, rules, segments, similarity
from ledgerlight.plans import discovery, mapping, segmentation
from ledgerlight.sources import extracts


def test_account_key(spark):
    df = spark.createDataFrame([("  0012 ",), ("000",), ("",), (None,), ("A01",)], "a string")
    assert [r[0] for r in df.select(clean.account_key(F.col("a"))).collect()] == ["12", "0", "0", None, "A01"]


def test_dates(spark):
    given_ = ["2024-03-05", "05-03-2024", "05/03/2024", "20240305", "05Mar2024", "05-Mar-2024", "2024/03/05"]
    df = spark.createDataFrame([(x,) for x in [*given_, "rubbish", None]], "a string")
    got = [r[0] for r in df.select(clean.parse_date(F.col("a"))).collect()]
    assert got == [dt.date(2024, 3, 5)] * 7 + [None, None]
    n = spark.createDataFrame([(20240305,), (7,)], "a int")
    assert [r[0] for r in n.select(clean.parse_date(F.col("a"), n.schema["a"].dataType)).collect()] == [dt.date(2024, 3, 5), None]


def test_tokens(spark):
    df = spark.createDataFrame([("a| B |none|",), (None,)], "a string")
    assert [r[0] for r in df.select(clean.tokens(F.col("a"))).collect()] == [["a", "B"], []]


def test_anti_join_keeps_null_accounts_and_first_of_ties(spark):
    goods = spark.createDataFrame([("01", 1), ("2", 2), (None, 3)], "a string, v int")
    fraud = spark.createDataFrame([("1", 9), (None, 9)], "a string, v int")
    assert sorted(r.v for r in extracts.without_accounts(goods, fraud, "a").collect()) == [2, 3]
    twice = spark.createDataFrame([("k", 2), ("k", 1), ("l", 5)], "a string, v int")
    assert sorted(r.v for r in extracts.keep_first(twice, ["a"], ["v"]).collect()) == [1, 5]


def test_union_relaxed_and_harmonise(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2.5, 7)], "n double, z int")
    assert sorted(map(tuple, extracts.union_relaxed([a, b]).collect()), key=str) == [(1.0, "x", None), (2.5, None, 7)]
    f = spark.createDataFrame([("12", "bad")], "n string, s string")
    assert extracts.harmonise(f, a).dtypes == [("n", "double"), ("s", "string")]
    with pytest.raises(ValueError):
        extracts.require(a, ["n", "missing"])


def test_read_and_write(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    for kind in ("parquet", "csv", "json"):
        extracts.write(df, f"{tmp_path}/t.{kind}")
        assert extracts.read_any(spark, f"{tmp_path}/t.{kind}", df.schema).count() == 2
    assert extracts.markdown(df).splitlines()[0] == "| n | s |"
    assert extracts.inspect(df).count() == 2


def test_recipe_round_trip(spark):
    df = spark.createDataFrame([(1, "5", "u", None, 0), (2, "6", "v", 1.0, 1), (3, "x", "u", 2.0, 1), (4, "8", None, None, 0)], "k int, t string, c string, v double, y int")
    r = encode.fit_recipe(df, ["t", "c", "v"], "y")
    again = encode.Recipe.loads(r.dumps())
    assert again.apply(df, ["k"]).collect() == r.apply(df, ["k"]).collect()
    assert r.lowcard["c"] == {"u": 0, "v": 1}
    new = spark.createDataFrame([(9, "w")], "k int, c string")
    assert again.apply(new, ["k"]).first()["cat__c"] == 2.0


def test_planted_leak_and_constant(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(i % 2), 1.0, float(rng.normal()), None if i % 2 else 1.0, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "k int, leak double, flat double, noise double, gone double, y int")
    kept, dropped = discovery.screen(df, ["leak", "flat", "noise", "gone"], Roles("k", "y"), Settings())
    assert kept == ["noise"] and dropped == {"leak": "leak", "flat": "constant", "gone": "leak"}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=2, max_size=60))
def test_hawkes_bounds(times):
    mu, branch, gain = accounts.em(np.array(times), 1.0)
    assert math.isnan(branch) or 0 <= branch < 1


def test_hawkes_separates():
    rng = np.random.default_rng(1)
    flat = np.sort(rng.uniform(0, 400, 400))
    burst = np.sort(np.concatenate([t + rng.exponential(0.2, 12) for t in rng.uniform(0, 400, 33)]))
    assert accounts.em(flat, 1.0)[1] < 0.35 < 0.6 < accounts.em(burst, 1.0)[1]


def test_single_event_accounts(spark):
    e = spark.createDataFrame([("a", 1.0, 1, "x", 5.0), ("b", 1.0, 2, "y", 0.0), ("b", 1.0, 3, "x", 7.0)], "u string, t double, e bigint, c string, v double")
    one = {r.u: r for r in accounts.timing(e, "u", "t", "e").collect()}
    assert one["a"].tm_cv == 0 and one["b"].tm_same_day_share == 1
    x = {(r.u, r.e): r.r for r in accounts.excitation(e, "u", "t", "e", 1.0).collect()}
    assert x == {("a", 1): 0.0, ("b", 2): 0.0, ("b", 3): 1.0}
    assert accounts.self_excitation(e, "u", "t").count() == 2
    assert accounts.composition(e, "u", "c", "v", ["x", "y"]).count() == 2
    g = accounts.transitions(e, "u", "t", "e", "c", ["x", "y"])
    assert g.groupBy("u", "from_state").agg(F.round(F.sum("p"), 9).alias("s")).where("s <> 1").count() == 0


def test_clr_and_distances(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.2, 0.3, 0.5])], "p array<double>, q array<double>")
    r = df.select(stats.total(stats.clr(F.col("p"))).alias("z"), stats.hellinger(F.col("p"), F.col("q")).alias("h"), stats.hellinger(F.col("q"), F.col("p")).alias("g"), stats.hellinger(F.col("p"), F.col("p")).alias("o"), stats.cosine(F.col("p"), F.col("p")).alias("c")).first()
    assert abs(r.z) < 1e-9 and abs(r.h - r.g) < 1e-12 and 0 < r.h <= 1 and r.o == 0 and abs(r.c - 1) < 1e-12


def test_auc_ties_and_sides(spark):
    df = spark.createDataFrame([(1.0, -1.0, 0), (1.0, -1.0, 1), (2.0, -2.0, 1), (None, None, 1)], "a double, b double, y int")
    got = {r.column: r.auc for r in curves.auc(df, ["a", "b"], "y").collect()}
    assert got == {"a": 0.75, "b": 0.25}
    empty = df.where("y > 5")
    assert curves.auc(empty, ["a"], "y").count() == 0


def test_stability(spark):
    df = spark.createDataFrame([(i % 3, (i + 1) % 3, i % 2) for i in range(60)], "a int, b int, c int")
    assert abs(curves.adjusted_rand(df, "a", "b").first()[0] - 1) < 1e-12
    assert abs(curves.adjusted_rand(df, "a", "c").first()[0]) < 0.1
    assert all(r.jaccard == 1 for r in curves.best_jaccard(df, "a", "b").collect())
    assert all(r.strength == 1 for r in curves.prediction_strength(df, "a", "b").collect())


def test_wilson(spark):
    r = spark.createDataFrame([(3, 10)], "k int, n int").select(*stats.wilson(F.col("k"), F.col("n"))).first()
    assert r[0] < 0.3 < r[1]


def test_rules(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,)], "x double")
    assert df.where(rules.Rule({"x": (1.0, None, True)}).column()).count() == 2
    assert df.where(rules.Rule({"x": (None, 1.0, False)}).column()).count() == 1
    r = rules.Rule({"x": (1.0, 2.0, True)})
    assert rules.Rule.loads(r.dumps()) == r


def planted(spark, n=1500):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        y = int(i % 15 == 0)
        a, b, c = rng.normal(size=3)
        if y:
            a, b = (a + 6, b) if i % 2 else (a, b + 6)
        rows.append((i, f"{i // 2:05d}", float(a), float(b), float(c), y))
    return spark.createDataFrame(rows, "k int, acct string, a double, b double, c double, y int")


def test_peel_finds_planted_behaviour(spark):
    found = rules.peel(planted(spark), "y", ["a", "b", "c"], rounds=2, least=10, width=5, depth=2)
    assert {c for r, *_ in found for c in r.bounds} >= {"a", "b"}
    assert rules.beam(planted(spark).where("y > 5"), "y", {}) == []


def test_folds_keep_accounts_together(spark):
    f = models.account_folds(planted(spark), "acct", "y", 3)
    assert f.count() == f.select("acct").distinct().count()


def test_contributions_add_up_and_tree_rules(spark):
    df = planted(spark)
    m = models.boosted(["a", "b", "c"], "y", depth=3, trees=4).fit(models.filled(df, ["a", "b", "c"]).withColumn("y", F.col("y").cast("double")))
    c = models.contributions(m, df, ["a", "b", "c"], "k")
    assert c.select(F.max(F.abs(stats.total(F.col("contrib")) + F.col("bias") - F.col("margin")))).first()[0] < 1e-6
    assert [r.feature for r in models.importance(c, ["a", "b", "c"], least=1).collect()][0] in ("a", "b")
    r, share, n = models.tree_rules(df, ["a", "b", "c"], "y", least=10)[0]
    assert share > 0.8 and df.where(r.column()).agg(F.avg("y")).first()[0] > 0.8


def test_discovery(spark):
    df = planted(spark)
    goods, fraud = df.where("y = 0").drop("y"), df.where("y = 1").drop("y")
    d = discovery.discover(goods, fraud, Roles("acct", "y", features=["a", "b", "c"]), "k", Settings(folds=2, trees=3, segments=2, engine="kmeans", alert_rate=0.0001, least_rows=5))
    assert d.scored.count() > 0 and d.dropped == {"n_null_raw": "constant"} and d.rules and d.summary.count() == len(d.rules)


def test_segmentation_replays(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(u, float(t), int(u * 100 + k), "xy"[k % 2 if u % 2 else 0], float(rng.uniform(1, 90))) for u in range(40) for k, t in enumerate(np.sort(rng.uniform(0, 30, 10)))]
    e = spark.createDataFrame(rows, "u int, t double, e bigint, c string, v double")
    s = segmentation.Segmentation(Roles("u", "y", "t", "e", "v", "c"), Settings(components=2, segments=2, engine="kmeans"))
    out = s.fit(e, spark.createDataFrame([(1, 1)], "u int, y int"))
    assert out.count() == 40
    s.save(f"{tmp_path}/m")
    again = segmentation.Segmentation.load(spark, f"{tmp_path}/m")
    a, b = ({r.u: r.embedding for r in m.embed(e).collect()} for m in (s, again))
    assert max(abs(x - y) for u in a for x, y in zip(a[u], b[u])) < 1e-8
    assert again.assign(e).count() == 40


def test_mapping(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 0), (3, [-1.0, 0.0], 0)], "k int, v array<double>, y int")
    c = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 1.0])], "group int, centroid array<double>")
    bars = spark.createDataFrame([(0, 0.5), (1, 0.5)], "group int, bar double")
    rows, summary = mapping.map_new(e, "k", "v", "y", c, bars)
    assert {r.k: r.cluster for r in rows.collect()} == {1: 0, 2: 1, 3: -1}
    assert summary.count() == 3


def test_hot_token_and_pairs(spark):
    edges = spark.createDataFrame([(i, "hot") for i in range(30)] + [(1, "t"), (2, "t")], "a int, t string")
    r = similarity.shared_tokens(edges, "a", "t", most=10).collect()
    assert [(x.a, x.b, x.common) for x in r] == [(1, 2, 2)]
    assert similarity.shared_tokens(edges, "a", "t").count() == 435
    assert {r.a: r.degree for r in accounts.token_degrees(edges, "a", "t").collect()}[5] == 29


def test_references_in_blocks(spark):
    a, b = spark.range(5).toDF("x"), spark.range(7).toDF("y")
    assert similarity.against(a, b, limit=3).count() == 35


def test_merge_groups():
    assert similarity.merge_groups({3: [1, 0], 5: [0.99, 0.05], 9: [0, 1]}) == {3: 0, 5: 0, 9: 1}


def test_relabel(spark):
    df = spark.createDataFrame([(5,), (5,), (2,), (-1,)], "c int")
    assert sorted(r.c for r in segments.relabel_by_size(df, "c").collect()) == [-1, 0, 0, 1]


def test_streams(spark, tmp_path):
    from ledgerlight.streaming import score

    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, s), s) for s in (0, 1, 3)] + [("b", dt.datetime(2024, 1, 1), 9)], "u string, ts timestamp, e bigint")
    e.write.parquet(f"{tmp_path}/in")
    live = score.excitation(score.files(spark, f"{tmp_path}/in", e.schema), "u", "ts", "e", 1.0)
    q = live.writeStream.format("memory").queryName("excited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.e: r.r for r in spark.table("excited").collect()}
    want = {r.e: r.r for r in accounts.excitation(e.withColumn("t", F.unix_micros("ts") / 1e6), "u", "t", "e", 1.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0])], "k int, v array<double>")
    assert {r.k: r.cluster for r in score.assign(v, "k", "v", [(0, [1.0, 0.0], 0.5), (1, [0.0, 1.0], 0.5)]).collect()} == {1: 0, 2: -1}
