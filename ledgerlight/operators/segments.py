"""Segments: hit metrics, drivers, bounds, categories, known behaviours, maps of new rows."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranks
from .encode import unpivot


def hit_metrics(df: DataFrame, segment: str, label: str, weight: float = 1.0) -> DataFrame:
    """Per segment and in TOTAL: frauds and goods, shares of each, hit rate, lift, goods per fraud (goods weighted to the population)."""
    y = F.col(label).cast("long")
    g = df.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.sum(y).alias("mule_no"), F.sum(1 - y).alias("good_no"))
    g = g.rollup("segment").agg(F.sum("mule_no").alias("mule_no"), F.sum("good_no").alias("good_no"), F.grouping("segment").alias("_all"))
    m, n = F.col("mule_no").cast("double"), F.col("good_no").cast("double")
    total = lambda c: F.max(F.when(F.col("_all") == 1, F.col(c))).over(Window.partitionBy()).cast("double")
    tm, tn = total("mule_no"), total("good_no")
    rate, rate_w = m / F.greatest(m + n, F.lit(1.0)), m / F.greatest(m + n * weight, F.lit(1.0))
    base, base_w = tm / F.greatest(tm + tn, F.lit(1.0)), tm / F.greatest(tm + tn * weight, F.lit(1.0))
    return g.select(
        F.when(F.col("_all") == 1, "TOTAL").otherwise(F.coalesce("segment", F.lit("<NULL>"))).alias("segment"), "mule_no", (m / F.greatest(tm, F.lit(1.0))).alias("mule_pct"), "good_no", (n / F.greatest(tn, F.lit(1.0))).alias("good_pct"),
        rate.alias("hit_rate"), (rate / F.greatest(base, F.lit(1e-12))).alias("lift"), (n * weight / F.greatest(m, F.lit(1.0))).alias("goods_per_mule_w"), rate_w.alias("hit_rate_w"), (rate_w / F.greatest(base_w, F.lit(1e-12))).alias("lift_w"),
    )


def drivers(df: DataFrame, cluster: str, features: list[str], quantiles: int = 25) -> DataFrame:
    """Per cluster and feature: Cohen's d, one-against-rest AUC, the side, and the threshold with the best Youden's J.

    The thresholds are the same few quantiles of the feature for all clusters: values at or above one are on its
    high side, values at or below it on its low side. Counts come from one
    pass over (cluster, feature, interval) cells, so nothing is multiplied by rows."""
    long = unpivot(df, [cluster], features).where("value IS NOT NULL").withColumnRenamed(cluster, "cluster")
    grid = [0.02 + 0.96 * k / (quantiles - 1) for k in range(quantiles)]
    cuts = long.groupBy("column").agg(F.array_sort(F.array_distinct(F.percentile("value", F.array(*map(F.lit, grid))))).alias("cuts"))
    stats = long.groupBy("column", "cluster").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    every = Window.partitionBy("column")
    n1, n0 = F.col("n").cast("double"), (F.sum("n").over(every) - F.col("n")).cast("double")
    m1, m0 = F.col("s") / n1, (F.sum("s").over(every) - F.col("s")) / F.greatest(n0, F.lit(1.0))
    v1 = (F.col("q") - n1 * m1 * m1) / F.greatest(n1 - 1, F.lit(1.0))
    v0 = (F.sum("q").over(every) - F.col("q") - n0 * m0 * m0) / F.greatest(n0 - 1, F.lit(1.0))
    pooled = F.sqrt(F.greatest(((n1 - 1) * v1 + (n0 - 1) * v0) / F.greatest(n1 + n0 - 2, F.lit(1.0)), F.lit(0.0)))
    d = stats.select("column", "cluster", "n", F.when(pooled > 0, (m1 - m0) / pooled).otherwise(0.0).alias("d"))
    # by distinct value: what of the cluster and of all lies below
    v = long.groupBy("column", "value", "cluster").agg(F.count("*").alias("c"))
    all_v = v.groupBy("column", "value").agg(F.sum("c").alias("a"))
    w = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    all_v = all_v.withColumn("below", F.coalesce(F.sum("a").over(w), F.lit(0)))
    wc = Window.partitionBy("column", "cluster").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("own", F.coalesce(F.sum("c").over(wc), F.lit(0))).join(all_v, ["column", "value"])
    wins = F.col("c") * ((F.col("below") - F.col("own")) + (F.col("a") - F.col("c")) / 2.0)
    auc = v.groupBy("column", "cluster").agg(F.sum(wins).alias("w"))
    # cells between thresholds: how many of them a value reaches, and whether it lies on the last of these
    cells = long.join(F.broadcast(cuts), "column").withColumn("k", F.size(F.filter("cuts", lambda t: t <= F.col("value"))))
    cells = cells.groupBy("column", "cluster", "k", F.coalesce(F.get("cuts", F.col("k") - 1) == F.col("value"), F.lit(False)).alias("on")).agg(F.count("*").alias("c"))
    per = cells.join(F.broadcast(cuts), "column").select("column", "cluster", "k", "on", "c", F.posexplode("cuts").alias("p", "t"))
    reaches, stays = F.col("k") > F.col("p"), (F.col("k") <= F.col("p")) | (F.col("on") & (F.col("k") == F.col("p") + 1))
    per = per.groupBy("column", "cluster", "p", "t").agg(F.sum(F.when(reaches, F.col("c")).otherwise(0)).alias("up"), F.sum(F.when(stays, F.col("c")).otherwise(0)).alias("down"), F.sum("c").alias("n1"))
    pw = Window.partitionBy("column", "p")
    per = per.withColumns({"all_up": F.sum("up").over(pw), "all_down": F.sum("down").over(pw), "n": F.sum("n1").over(pw)}).join(d.select("column", "cluster", "d"), ["column", "cluster"])
    high = F.col("d") >= 0
    tp = F.when(high, F.col("up")).otherwise(F.col("down"))
    sel = F.when(high, F.col("all_up")).otherwise(F.col("all_down"))
    j = tp / F.col("n1") - (sel - tp) / F.greatest(F.col("n") - F.col("n1"), F.lit(1))
    per = per.select("column", "cluster", "p", F.col("t").alias("threshold"), F.round(j, 12).alias("youden"), (tp / F.col("n1")).alias("coverage"), (tp / F.greatest(sel, F.lit(1))).alias("purity"))
    best = per.withColumn("_r", F.row_number().over(Window.partitionBy("column", "cluster").orderBy(F.desc("youden"), "p"))).where("_r = 1").drop("_r", "p")
    n_all = F.sum("n").over(Window.partitionBy("column"))
    out = d.withColumn("_rest", n_all - F.col("n")).join(auc, ["column", "cluster"]).join(best, ["column", "cluster"])
    # no cut better than none at all: no threshold
    some = F.col("youden") > 0
    return out.select(
        "cluster", "column", "d", F.when(F.col("_rest") > 0, F.col("w") / (F.col("n").cast("double") * F.col("_rest"))).otherwise(0.5).alias("auc"), F.when(F.col("d") >= 0, "high").otherwise("low").alias("side"),
        F.when(some, F.col("threshold")).alias("threshold"), *(F.when(some, F.col(c)).otherwise(0.0).alias(c) for c in ("youden", "coverage", "purity")),
    )


def bounds(df: DataFrame, cluster: str, features: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Per cluster and feature: the band of its middle values, the shares of the cluster and of the rest within, and their ratio."""
    long = unpivot(df, [cluster], features).where("value IS NOT NULL").withColumnRenamed(cluster, "cluster")
    b = long.groupBy("column", "cluster").agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("q"))
    b = b.select("column", F.col("cluster").alias("of"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    inside = long.join(F.broadcast(b), "column").withColumn("in", F.col("value").between(F.col("lo"), F.col("hi")).cast("double"))
    own = F.col("cluster") == F.col("of")
    g = inside.groupBy("of", "column", "lo", "hi").agg(F.avg(F.when(own, F.col("in"))).alias("inside"), F.coalesce(F.avg(F.when(~own, F.col("in"))), F.lit(0.0)).alias("outside"))
    return g.select(F.col("of").alias("cluster"), "column", "lo", "hi", "inside", "outside", (F.col("inside") / F.greatest("outside", F.lit(1e-9))).alias("selectivity"))


def condition_rates(df: DataFrame, conditions: dict[str, Column], cluster: Column, label: Column, weight: float = 1.0, least: int = 1) -> DataFrame:
    """Per condition: hits in the cluster, among frauds and among goods, shares, hit rate and lift; one pass for all."""
    c, y = F.coalesce(cluster, F.lit(False)), F.coalesce(label, F.lit(False))
    base = [F.sum(c.cast("long")).alias("_nc"), F.sum(y.cast("long")).alias("_nf"), F.sum((~y).cast("long")).alias("_ng")]
    rows = []
    for k, (text, cond) in enumerate(conditions.items()):
        x = F.coalesce(cond, F.lit(False))
        base += [F.sum((x & c).cast("long")).alias(f"c{k}"), F.sum((x & y).cast("long")).alias(f"f{k}"), F.sum((x & ~y).cast("long")).alias(f"g{k}")]
        rows.append(F.struct(F.lit(text).alias("condition"), F.col(f"c{k}").alias("cluster_hits"), F.col(f"f{k}").alias("fraud_hits"), F.col(f"g{k}").alias("good_hits")))
    t = df.agg(*base).select("_nc", "_nf", "_ng", F.inline(F.array(*rows)))
    f, g = F.col("fraud_hits").cast("double"), F.col("good_hits") * weight
    return t.where(F.col("cluster_hits") >= least).select(
        "condition", "cluster_hits", "fraud_hits", "good_hits", (F.col("cluster_hits") / F.greatest("_nc", F.lit(1))).alias("cluster_share"), (f / F.greatest("_nf", F.lit(1))).alias("fraud_share"), (F.col("good_hits") / F.greatest("_ng", F.lit(1))).alias("good_share"),
        (f / F.greatest(f + g, F.lit(1.0))).alias("hit_rate"), (((f + 0.5) / (F.col("_nf") + 1)) / ((F.col("good_hits") + 0.5) / (F.col("_ng") + 1))).alias("lift"),
    )


def categories(df: DataFrame, segment: str, columns: list[str], label: str, is_val: str, top: int = 5) -> DataFrame:
    """Per segment, column and value: frauds in training and validation, their shares, shares among all frauds and goods, enrichments.

    Values beyond the `top` of a segment are one row <OTHER> with counts and shares alone; null is <NULL>."""
    long = df.select(F.col(segment).alias("segment"), F.col(label).alias("y"), F.col(is_val).alias("v"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<NULL>")).alias("value")) for c in columns))))
    one = lambda cond: F.sum(cond.cast("long"))
    y, v = F.col("y") == 1, F.col("v") == 1
    g = long.groupBy("segment", "column", "value").agg(one(y & ~v).alias("train_mule_no"), one(y & v).alias("val_mule_no"), one(y).alias("_m"), one(~y).alias("_g"))
    sc, cv, c = Window.partitionBy("segment", "column"), Window.partitionBy("column", "value"), Window.partitionBy("column")
    share = lambda a, b: a / F.greatest(b, F.lit(1))
    g = g.withColumn("share_all_mules", share(F.sum("_m").over(cv), F.sum("_m").over(c))).withColumn("share_all_goods", share(F.sum("_g").over(cv), F.sum("_g").over(c)))
    g = g.withColumn("train_share_in_segment", share(F.col("train_mule_no"), F.sum("train_mule_no").over(sc))).withColumn("val_share_in_segment", share(F.col("val_mule_no"), F.sum("val_mule_no").over(sc)))
    g = g.where("train_mule_no > 0 OR val_mule_no > 0").withColumn("_r", F.row_number().over(sc.orderBy(F.desc("train_mule_no"), "value")))
    keep = g.where(F.col("_r") <= top).select(
        "segment", "column", "value", "train_mule_no", "train_share_in_segment", "val_mule_no", "val_share_in_segment", "share_all_mules", "share_all_goods",
        (F.col("train_share_in_segment") / F.greatest("share_all_mules", F.lit(1e-9))).alias("enrichment_vs_mules"), ((F.col("train_share_in_segment") + 1e-4) / (F.col("share_all_goods") + 1e-4)).alias("enrichment_vs_goods"),
    )
    other = g.where(F.col("_r") > top).groupBy("segment", "column").agg(*(F.sum(x).alias(x) for x in ("train_mule_no", "train_share_in_segment", "val_mule_no", "val_share_in_segment")))
    return keep.unionByName(other.withColumn("value", F.lit("<OTHER>")), allowMissingColumns=True)


#: What conditions of known behaviours may call besides columns.
ALLOWED = ("and", "or", "not", "in", "between", "is", "null", "true", "false", "like", "abs", "coalesce", "lower", "upper", "trim")


def checked(rules: dict[str, str], columns: list[str]) -> list[str]:
    """The columns that conditions name and the table lacks; a name that is no column but called like a function and not allowed is an error."""
    import re

    missing = []
    for name, text in rules.items():
        bare = re.sub(r"'[^']*'", "''", text)
        for m in re.finditer(r"[A-Za-z_]\w*", bare):
            word = m.group()
            if word in columns or word.lower() in ALLOWED:
                continue
            if bare[m.end() :].lstrip()[:1] == "(":
                raise ValueError(f"{name}: {word} is not allowed; use {', '.join(ALLOWED)} and the columns {', '.join(columns)}")
            missing.append(word)
    return list(dict.fromkeys(missing))


def behaviours(df: DataFrame, rules: dict[str, str], catch_all: tuple[str, ...] = ()) -> DataFrame:
    """As tagged, after a check of the conditions; a column that df lacks is 0."""
    missing = checked(rules, df.columns)
    return _tagged(df.withColumns({c: F.lit(0) for c in missing}), rules, catch_all).drop(*missing) if missing else _tagged(df, rules, catch_all)


def _tagged(df: DataFrame, rules: dict[str, str], catch_all: tuple[str, ...] = ()) -> DataFrame:
    """A flag mo__<name> for each SQL condition, the set of those that hold, their number, and whether one but the catch-alls does."""
    out = df.withColumns({f"mo__{k}": F.coalesce(F.expr(v), F.lit(False)).cast("int") for k, v in rules.items()})
    held = F.concat_ws("+", *(F.when(F.col(f"mo__{k}") == 1, k) for k in rules))
    number = reduce(add, (F.col(f"mo__{k}") for k in rules))
    covered = reduce(add, (F.col(f"mo__{k}") for k in rules if k not in catch_all), F.lit(0))
    return out.withColumns({"mo_set": F.when(held == "", "NONE").otherwise(held), "mo_count": number, "mo_covered": (covered > 0).cast("int")})


def cooccurrence(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """a, b, frauds, goods: rows that hold both flags."""
    rows, aggs = [], []
    for i, a in enumerate(flags):
        for b in flags[i:]:
            n = f"{a}|{b}"
            both = F.col(a) * F.col(b)
            aggs += [F.sum(both * F.col(label)).cast("long").alias(f"f{n}"), F.sum(both * (1 - F.col(label))).cast("long").alias(f"g{n}")]
            rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`f{n}`").alias("frauds"), F.col(f"`g{n}`").alias("goods")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def label_ladder(coverage: Column, significant: Column, top_name: Column, top_recall: Column, nearest: Column, cosine: Column) -> Column:
    """What a segment is against known behaviours. significant: array of the names of those that mark it."""
    names = F.array_join(significant, "+")
    return (
        F.when((coverage < 0.30) & F.coalesce(cosine >= 0.80, F.lit(False)) & nearest.isNotNull(), F.concat(F.lit("GAP:"), nearest)).when(coverage < 0.30, "NEW")
        .when((F.size(significant) > 0) & (top_recall >= 0.50), F.concat(F.lit("ALIGNED:"), names)).when(F.size(significant) > 0, F.concat(F.lit("SUBTYPE:"), names))
        .when(coverage >= 0.70, "CROSS-MO").otherwise(F.concat(F.lit("PARTIAL:"), top_name))
    )


def concentration(df: DataFrame, cluster: str, account: str) -> DataFrame:
    """cluster, n_accounts, top_share: how many accounts it has and the share of the largest; Herfindahl's index."""
    g = df.groupBy(F.col(cluster).alias("cluster"), F.col(account).alias("a")).agg(F.count("*").alias("n"))
    g = g.withColumn("s", F.col("n") / F.sum("n").over(Window.partitionBy("cluster")))
    return g.groupBy("cluster").agg(F.count("a").alias("n_accounts"), F.max("s").alias("top_share"), F.sum(F.col("s") * F.col("s")).alias("herfindahl"))


def over_represented(df: DataFrame, cluster: str, column: str, ratio: float = 1.2, least: float = 0.1) -> DataFrame:
    """cluster, value, share, ratio to all rows, where both are high enough."""
    g = df.groupBy(F.col(cluster).alias("cluster"), F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    own = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    all_ = F.sum("n").over(Window.partitionBy("value")) / F.sum("n").over(Window.partitionBy())
    return g.select("cluster", "value", own.alias("share"), (own / all_).alias("ratio")).where((F.col("share") >= least) & (F.col("ratio") >= ratio))


def relabel_by_size(df: DataFrame, cluster: str) -> DataFrame:
    """cluster numbers so that 0 is the largest; -1 is noise and stays."""
    sizes = df.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("_n"))
    names = sizes.select(cluster, (F.row_number().over(Window.orderBy(F.desc("_n"), cluster)) - 1).alias("_new"))
    return df.join(F.broadcast(names), cluster, "left").withColumn(cluster, F.coalesce("_new", F.lit(-1))).drop("_new")


def map_summary(mapped: DataFrame, cluster: str, label: str, cosine: str | None = None, weight: float = 1.0) -> DataFrame:
    """What fell into each cluster."""
    g = mapped.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n_rows"), F.sum(F.col(label).cast("long")).alias("fraud_n"), *([F.avg(cosine).alias("mean_cosine")] if cosine else []))
    n, f = F.col("n_rows"), F.col("fraud_n")
    good = n - f
    tf, tg = F.sum("fraud_n").over(Window.partitionBy()), F.sum(good).over(Window.partitionBy())
    rate = f / F.greatest(f + good * weight, F.lit(1.0))
    return g.select(
        "cluster", "n_rows", "fraud_n", good.alias("goods_n"), (100 * f / n).alias("fraud_pct_of_cluster"), (100 * f / F.greatest(tf, F.lit(1))).alias("fraud_pct_of_new_fraud"), (100 * good / F.greatest(tg, F.lit(1))).alias("good_pct_of_new_goods"),
        (good * weight).alias("est_goods_population"), (100 * rate).alias("hit_rate_pct"), (rate / F.greatest(tf / F.greatest(tf + tg * weight, F.lit(1.0)), F.lit(1e-12))).alias("lift"), *(["mean_cosine"] if cosine else []),
    )


def against_original(new: DataFrame, old: DataFrame) -> DataFrame:
    """new summary with the original's fraud share and the shift."""
    o = old.select("cluster", F.col("fraud_pct_of_cluster").alias("original_pct"))
    return new.join(o, "cluster", "left").withColumn("fraud_pct_shift", F.col("fraud_pct_of_cluster") - F.col("original_pct")).select("cluster", "fraud_pct_of_cluster", "original_pct", "fraud_pct_shift")


def binary_rates(df: DataFrame, flags: list[str], cluster: Column, label: Column, least: float = 0.1, top: int = 25) -> DataFrame:
    """feature, its rate in the cluster, among frauds and among goods, and smoothed ratios; the highest first."""
    c, y = F.coalesce(cluster, F.lit(False)), F.coalesce(label, F.lit(False))
    rate = lambda x, cond: F.coalesce(F.avg(F.when(cond, F.col(x).cast("double"))), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(x).alias("feature"), rate(x, c).alias("cluster_rate"), rate(x, y).alias("fraud_rate"), rate(x, ~y).alias("good_rate")) for x in flags))
    t = df.agg(rows.alias("r")).select(F.inline("r")).where(F.col("cluster_rate") >= least)
    t = t.withColumn("ratio_vs_fraud", (F.col("cluster_rate") + 1e-3) / (F.col("fraud_rate") + 1e-3)).withColumn("ratio_vs_good", (F.col("cluster_rate") + 1e-3) / (F.col("good_rate") + 1e-3))
    return t.orderBy(F.desc("ratio_vs_good"), "feature").limit(top)


def recency(df: DataFrame, cluster: str, day: str, quantile: float = 0.75) -> DataFrame:
    """cluster, ratio: its share of rows after the quantile of days over the overall share."""
    x = df.where(F.col(day).isNotNull()).select(F.col(cluster).alias("cluster"), F.unix_micros(F.col(day).cast("timestamp")).cast("double").alias("t"))
    cut = x.agg(F.percentile("t", F.lit(quantile)).alias("cut"))
    x = x.join(F.broadcast(cut)).withColumn("late", (F.col("t") > F.col("cut")).cast("double"))
    g = x.groupBy("cluster").agg(F.sum("late").alias("l"), F.count("*").alias("n"))
    every = Window.partitionBy()
    return g.select("cluster", ((F.col("l") / F.col("n")) / F.greatest(F.sum("l").over(every) / F.sum("n").over(every), F.lit(1e-12))).alias("ratio"))


def overlay(df: DataFrame, segment: str, flags: list[str]) -> DataFrame:
    """segment, mo, coverage (share of the segment), recall (share of the behaviour), enrichment over all rows."""
    long = df.select(F.col(segment).alias("segment"), F.inline(F.array(*(F.struct(F.lit(c).alias("mo"), F.col(c).cast("double").alias("h")) for c in flags))))
    g = long.groupBy("segment", "mo").agg(F.sum("h").alias("h"), F.count("*").alias("n"))
    w = Window.partitionBy("mo")
    cover = F.col("h") / F.col("n")
    return g.select("segment", "mo", cover.alias("coverage"), (F.col("h") / F.greatest(F.sum("h").over(w), F.lit(1.0))).alias("recall"), (cover / F.greatest(F.sum("h").over(w) / F.sum("n").over(w), F.lit(1e-12))).alias("enrichment"))


def confusion(df: DataFrame, true: str, predicted: str) -> DataFrame:
    """true, predicted, n, share of the true class, and whether they agree."""
    g = df.groupBy(F.col(true).alias("true"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true"))).withColumn("agree", F.col("true").eqNullSafe(F.col("predicted")).cast("int"))


def by_split(df: DataFrame, group: str, split: str, values: list) -> DataFrame:
    """Rows of each group in each split, a column for each."""
    return df.groupBy(F.col(group).alias("group")).agg(*(F.sum((F.col(split) == v).cast("long")).alias(f"n_{v}") for v in values))


def prevalence(df: DataFrame, label: str, n_book: int, n_fraud_book: int) -> DataFrame:
    """base rate here and in the book, and how much richer this sample is."""
    return df.agg(F.avg(F.col(label).cast("double")).alias("base_rate")).select("base_rate", F.lit(n_fraud_book / n_book).alias("book_rate"), (F.col("base_rate") / F.lit(n_fraud_book / n_book)).alias("enrichment"))


def state_descriptions(df: DataFrame, state: str, features: list[str], top: int = 3) -> DataFrame:
    """state, share, and the features whose means lie farthest from all rows', in standard deviations."""
    long = unpivot(df, [state], features).withColumnRenamed(state, "state")
    w = Window.partitionBy("column")
    g = long.groupBy("column", "state").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.sum(F.col("value") * F.col("value")).alias("q"))
    n = F.sum("n").over(w)
    mean = F.sum("s").over(w) / n
    sd = F.sqrt(F.greatest(F.sum("q").over(w) / n - mean * mean, F.lit(0.0)))
    g = g.withColumn("z", (F.col("s") / F.col("n") - mean) / F.greatest(sd, F.lit(1e-9))).withColumn("share", F.col("n") / n)
    g = g.withColumn("r", F.row_number().over(Window.partitionBy("state").orderBy(F.desc(F.round(F.abs("z"), 9)), "column"))).where(F.col("r") <= top)
    return g.groupBy("state").agg(F.max("share").alias("share"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "column", "z"))), lambda x: F.concat(F.when(x["z"] >= 0, "high ").otherwise("low "), x["column"])), ", ").alias("description"))


def verdicts(summary: DataFrame, least_lift: float = 2.0, least_recall: float = 0.5, least_stability: float = 0.6, most_account: float = 0.5) -> DataFrame:
    """Whether a segment is describable, enriched, stable and not one account's; a candidate is all of these."""
    s = summary.withColumns({
        "describable": (F.col("rule_recall") >= least_recall).cast("int"), "enriched": (F.col("lift") >= least_lift).cast("int"),
        "stable": (F.col("stability") >= least_stability).cast("int"), "spread": (F.col("top_share") <= most_account).cast("int"),
    })
    return s.withColumn("candidate", F.col("describable") * F.col("enriched") * F.col("stable") * F.col("spread"))


def novelty(df: DataFrame, value: str, is_ref: str) -> DataFrame:
    """df with novelty: the share of references whose value is strictly lower."""
    b = ranks.below(df, value, {"_r": F.col(is_ref).cast("long")})
    b = b.select(F.col(value).alias("_v"), (F.col("_r_below") / F.greatest("_r_all", F.lit(1))).alias("novelty"))
    return df.join(b, F.col(value) == F.col("_v"), "left").drop("_v")


def significant_behaviours(overlays: DataFrame, coverage: DataFrame, profile: DataFrame | None = None, least: float = 0.2, enrichment: float = 1.5) -> DataFrame:
    """segment and its label: from overlay rows (segment, mo, coverage, recall, enrichment) and segments' coverage by any behaviour.

    A behaviour marks a segment if it covers enough of it and is enriched there; the most frequent comes first.
    profile: segment, nearest, cosine of the closest known profile, if there is one."""
    o = overlays.withColumn("mo", F.regexp_replace("mo", "^mo__", ""))
    sig = (F.col("coverage") >= least) & (F.col("enrichment") >= enrichment)
    row = F.struct((-F.col("coverage")).alias("c"), "mo", "recall", sig.alias("sig"))
    g = o.groupBy("segment").agg(F.array_sort(F.collect_list(row)).alias("r")).join(coverage.select("segment", F.col("coverage").alias("_cov")), "segment")
    if profile is not None:
        g = g.join(profile.select("segment", "nearest", "cosine"), "segment", "left")
    else:
        g = g.withColumns({"nearest": F.lit(None).cast("string"), "cosine": F.lit(None).cast("double")})
    names = F.transform(F.filter("r", lambda x: x["sig"]), lambda x: x["mo"])
    return g.select("segment", label_ladder(F.col("_cov"), names, F.col("r")[0]["mo"], F.col("r")[0]["recall"], F.col("nearest"), F.col("cosine")).alias("ladder"))


def residual_pool(df: DataFrame, rules: dict[str, str], label: str, catch_all: tuple[str, ...] = ()) -> DataFrame:
    """Positives that no known behaviour covers; catch-alls do not count."""
    return behaviours(df, rules, catch_all).where((F.col(label) == 1) & (F.col("mo_covered") == 0))


def medians(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """cluster and the median of each column."""
    return df.groupBy(F.col(cluster).alias("cluster")).agg(*(F.median(F.col(c).cast("double")).alias(f"median_{c}") for c in columns))


def with_profile(metrics: DataFrame, profile: DataFrame, on: str = "cluster") -> DataFrame:
    """Metrics with what is known of the same segments beside; segments without a profile stay."""
    return metrics.join(profile, on, "left")


def segment_overlap(df: DataFrame, segment: str, cluster: str) -> DataFrame:
    """segment, n, the cluster that holds most of it, and the share it holds; rows without a cluster count in n alone."""
    g = df.groupBy(F.col(segment).alias("segment"), F.col(cluster).alias("c")).agg(F.count("*").alias("k"))
    best = F.max(F.when(F.col("c").isNotNull(), F.struct(F.col("k").alias("k"), (-F.col("c")).alias("o"), F.col("c").alias("c"))))
    t = g.groupBy("segment").agg(F.sum("k").alias("n"), best.alias("b"))
    return t.select("segment", "n", F.col("b.c").alias("best"), (F.col("b.k") / F.col("n")).alias("share"))


def behaviour_detail(df: DataFrame, rules: dict[str, str], cluster: str, label: str, least: float = 0.1) -> DataFrame:
    """mo, n, overlap (share that another behaviour holds too), herfindahl of its frauds over clusters, clusters with at least that share of them, the top one."""
    t = _tagged(df, rules).where(F.col(label) == 1)
    long = t.select(F.col(cluster).alias("c"), "mo_count", F.inline(F.array(*(F.struct(F.lit(k).alias("mo"), F.col(f"mo__{k}").alias("h")) for k in rules)))).where("h = 1")
    g = long.groupBy("mo", "c").agg(F.count("*").alias("k"), F.sum((F.col("mo_count") > 1).cast("long")).alias("o"))
    s = F.col("k") / F.sum("k").over(Window.partitionBy("mo"))
    g = g.withColumn("s", s)
    return g.groupBy("mo").agg(F.sum("k").alias("n"), (F.sum("o") / F.sum("k")).alias("overlap"), F.sum(F.col("s") * F.col("s")).alias("herfindahl"), F.sum((F.col("s") >= least).cast("long")).alias("n_clusters"), F.min_by("c", F.struct((-F.col("s")).alias("s"), "c")).alias("top_cluster"))


def signatures(found: DataFrame, top: int = 3) -> DataFrame:
    """cluster, signature: the features of the largest effect (rows of `drivers`), with their side."""
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round(F.abs("d"), 9)), "column"))
    t = found.withColumn("r", r).where(F.col("r") <= top)
    return t.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "column", "side"))), lambda x: F.concat(x["side"], F.lit(" "), x["column"])), ", ").alias("signature"))


def driver_strings(df: DataFrame, cluster: str, contributions: str, features: list[str], top: int = 6) -> DataFrame:
    """cluster, drivers: the features of the highest mean contribution, each with it, largest first."""
    long = df.select(F.col(cluster).alias("cluster"), F.posexplode(contributions).alias("p", "x")).groupBy("cluster", "p").agg(F.avg("x").alias("m"))
    long = long.withColumn("f", F.element_at(F.array(*map(F.lit, features)), F.col("p") + 1))
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("m", 9)), "f"))
    t = long.withColumn("r", r).where((F.col("r") <= top) & (F.col("m") > 0))
    return t.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "f", "m"))), lambda x: F.concat(x["f"], F.lit(" "), F.format_number(x["m"], 3))), "; ").alias("drivers"))


def top_values(table: DataFrame, top: int = 3) -> DataFrame:
    """segment, column, top: the most frequent values of `categories` as one text."""
    t = table.where(F.col("value") != "<OTHER>").withColumn("r", F.row_number().over(Window.partitionBy("segment", "column").orderBy(F.desc("train_mule_no"), "value"))).where(F.col("r") <= top)
    return t.groupBy("segment", "column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "value", "train_share_in_segment"))), lambda x: F.concat(x["value"], F.lit(" "), F.round(100 * x["train_share_in_segment"], 0).cast("int").cast("string"), F.lit("%"))), "; ").alias("top"))
