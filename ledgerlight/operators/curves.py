"""Rankings and curves: AUC, average precision, budgets, cumulative scorecards, stability of labelings.

Everything is counts in windows; a cumulative curve first adds up rows of equal score, so its windows run
over distinct scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from . import ranks
from .encode import unpivot


def auc(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """column, auc of each feature against a 0/1 label, by average ranks over non-null values."""
    long = unpivot(df, [label], features).where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    w = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("n").over(w), F.lit(0))
    wins = counts.select("column", (F.col("p") * (below + F.col("n") / 2.0)).alias("w"), "p", "n")
    g = wins.groupBy("column").agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.select("column", F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p").cast("double") * F.col("n"))).otherwise(0.5).alias("auc"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rho for each pair of columns, over rows without nulls."""
    source = ranked = df.dropna(subset=columns).select(*columns)
    for k, c in enumerate(columns):
        ranked = ranks.with_average_rank(ranked, c, f"_r{k}", source=source)
    ranked = ranked.select(*(F.col(f"_r{k}").alias(c) for k, c in enumerate(columns)))
    one = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return ranked.agg(F.array(*one).alias("x")).select(F.inline("x"))


def cumulative(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, p, n and cp, cn down to it, from the highest."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    return ranks.running(g, [-F.col("score")], {"cp": F.col("p"), "cn": F.col("n")})


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    c = cumulative(df, score, label)
    return c.agg((F.sum(F.col("p") * F.col("cp") / F.col("cn")) / F.greatest(F.sum("p"), F.lit(1))).alias("average_precision"))


def precision_at_positives(df: DataFrame, score: str, label: str, tie: str) -> DataFrame:
    """Precision among as many of the highest scores as there are positives."""
    y = df.select(F.col(label).cast("long").alias("y"), F.col(score).alias("s"), F.col(tie).alias("t"))
    r = ranks.numbered(y, [-F.col("s"), F.col("t")], "k").join(F.broadcast(y.agg(F.sum("y").alias("p"))))
    return r.where("k <= p").agg((F.sum("y") / F.greatest(F.max("p"), F.lit(1))).alias("precision"))


def budgets(df: DataFrame, score: str, label: str, tie: str, shares: list[float], n_book: int, n_fraud_book: int) -> DataFrame:
    """For each share of alerts: k, recall, alerts and catches in the book, lift, whether k is enough to rely on."""
    r = ranks.numbered(df.select(F.col(label).cast("long").alias("y"), F.col(score).alias("s"), F.col(tie).alias("t")), [-F.col("s"), F.col("t")], "r")
    total = r.agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    table = df.sparkSession.createDataFrame([(float(b),) for b in shares], "budget double")
    b = F.broadcast(table.join(total).withColumn("k", F.greatest(F.lit(1), F.round(F.col("budget") * F.col("n")).cast("long"))))
    hits = r.join(b, F.col("r") <= F.col("k")).groupBy("budget", "k", "n", "p").agg(F.sum("y").alias("hits"))
    recall = F.col("hits") / F.greatest("p", F.lit(1))
    return hits.select("budget", "k", recall.alias("recall"), F.floor(F.col("budget") * n_book).alias("book_alerts"), (recall * n_fraud_book).alias("catches"), (recall / F.col("budget")).alias("lift"), (F.col("k") >= 20).cast("int").alias("reliable"))


def false_positives(df: DataFrame, scores: list[str], label: str, tie: str, recall: float) -> DataFrame:
    """score_name, k, fp: alerts needed to reach the recall, and how many of them are false."""
    out = None
    for s in scores:
        y = df.select(F.col(label).cast("long").alias("y"), F.col(s).alias("s"), F.col(tie).alias("t"))
        r = ranks.running(y, [-F.col("s"), F.col("t")], {"k": F.lit(1).cast("long"), "cp": F.col("y")}).join(F.broadcast(y.agg(F.sum("y").alias("p"))))
        need = F.ceil(F.lit(recall) * F.col("p"))
        one = r.where(F.col("cp") >= need).agg(F.min("k").alias("k"), F.max(need).alias("need")).select(F.lit(s).alias("score_name"), F.col("k").cast("long").alias("k"), (F.col("k") - F.col("need")).alias("fp"))
        out = one if out is None else out.unionByName(one)
    return out


def cut_at_ratio(df: DataFrame, score: str, label: str, most: float) -> DataFrame:
    """The lowest score down to which goods per fraud stay within `most`."""
    c = cumulative(df, score, label)
    ok = c.where((F.col("cn") - F.col("cp")) <= F.lit(most) * F.col("cp"))
    return ok.agg(F.min("score").alias("threshold"), F.max("cp").alias("frauds"), F.max_by(F.col("cn") - F.col("cp"), F.col("cn")).alias("goods"))


def scorecard(df: DataFrame, cluster: str, label: str, n_book: int, n_fraud_book: int) -> DataFrame:
    """One row per cluster: sizes, shares, rate with Wilson's interval, lift, weight of evidence, what the book would see; then cumulative in order of lift."""
    g = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("bad"))
    every = Window.partitionBy()
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    good = n - bad
    total, tb = F.sum("n").over(every).cast("double"), F.sum("bad").over(every).cast("double")
    bp, gp = bad / F.greatest(tb, F.lit(1.0)), good / F.greatest(total - tb, F.lit(1.0))
    lo, hi = stats.wilson(bad, n)
    woe = F.ln((bp + 1e-12) / (gp + 1e-12))
    t = g.select(
        "cluster", "n", "bad", (n / total).alias("share"), bp.alias("bad_pct"), gp.alias("good_pct"), (bad / n).alias("rate"), lo.alias("wilson_lo"), hi.alias("wilson_hi"),
        ((bad / n) / F.greatest(tb / total, F.lit(1e-12))).alias("lift"), (bp / F.greatest(gp, F.lit(1e-12))).alias("capture_over_cost"), woe.alias("woe"), ((bp - gp) * woe).alias("iv_part"),
        F.floor(n / total * n_book).alias("book_alerts"), (bp * n_fraud_book).alias("catches"), (lo > tb / total).cast("int").alias("significant"),
    )
    w = Window.orderBy(F.desc("lift"), "cluster").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("cum_bad", F.sum("bad_pct").over(w)).withColumn("cum_good", F.sum("good_pct").over(w))
    return t.withColumn("ks", F.abs(F.col("cum_bad") - F.col("cum_good")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = contingency(df, a, b)
    pairs = lambda x: x * (x - 1) / 2.0
    n = F.col("n").cast("double")
    one = cells.agg(F.sum(pairs(n)).alias("c"), F.sum(n).alias("n"))
    ra = cells.groupBy("a").agg(F.sum(n).alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sa"))
    rb = cells.groupBy("b").agg(F.sum(n).alias("n")).agg(F.sum(pairs(F.col("n"))).alias("sb"))
    t = one.join(F.broadcast(ra)).join(F.broadcast(rb))
    expected = F.col("sa") * F.col("sb") / F.greatest(pairs(F.col("n")), F.lit(1.0))
    most = (F.col("sa") + F.col("sb")) / 2
    return t.select(F.when(most == expected, 1.0).otherwise((F.col("c") - expected) / (most - expected)).alias("ari"))


def best_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each group of a the group of b that it shares most with, and their Jaccard index."""
    cells = contingency(df, a, b)
    cells = cells.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b")))
    cells = cells.withColumn("jaccard", F.col("n") / (F.col("na") + F.col("nb") - F.col("n")))
    first = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("jaccard"), "b"))
    return cells.withColumn("_r", first).where("_r = 1").select("a", F.col("b").alias("best"), "jaccard")


def prediction_strength(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each group of a the share of its pairs that b keeps together; groups of one are null."""
    cells = contingency(df, a, b)
    n = F.col("n").cast("double")
    g = cells.groupBy("a").agg(F.sum(n * (n - 1)).alias("kept"), F.sum(n).alias("n"))
    return g.select("a", F.when(F.col("n") > 1, F.col("kept") / (F.col("n") * (F.col("n") - 1))).alias("strength"))


def shrunk_risk(df: DataFrame, cluster: str, label: str, fold: str | None = None, prior: float = 50.0) -> DataFrame:
    """Cluster rates shrunk to the base rate by a prior of that many rows; with a fold, each fold's from the others alone."""
    if fold is None:
        g = df.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(F.col(label).cast("double")).alias("f"), F.count("*").alias("n"))
        base = F.sum("f").over(Window.partitionBy()) / F.sum("n").over(Window.partitionBy())
        return g.select("cluster", ((F.col("f") + prior * base) / (F.col("n") + prior)).alias("risk"))
    g = df.groupBy(F.col(cluster).alias("cluster"), F.col(fold).alias("fold")).agg(F.sum(F.col(label).cast("double")).alias("f"), F.count("*").alias("n"))
    c, k, every = Window.partitionBy("cluster"), Window.partitionBy("fold"), Window.partitionBy()
    rest = lambda x, part: F.sum(x).over(part)
    f, n = rest("f", c) - F.col("f"), rest("n", c) - F.col("n")
    base = (rest("f", every) - rest("f", k)) / (rest("n", every) - rest("n", k))
    return g.select("cluster", "fold", ((f + prior * base) / (n + prior)).alias("risk"))


def pair_separation(df: DataFrame, value: str, same: str) -> DataFrame:
    """Fisher's criterion and AUC of a similarity between pairs of one class and others."""
    v = F.col(value)
    y = F.col(same)
    m = lambda k, f: f(F.when(y == k, v))
    a = df.agg((F.pow(m(1, F.avg) - m(0, F.avg), 2) / F.greatest(m(1, F.var_pop) + m(0, F.var_pop), F.lit(1e-12))).alias("fisher"), m(1, F.avg).alias("mean_same"), m(0, F.avg).alias("mean_other"))
    return a.join(F.broadcast(auc(df, [value], same).select("auc")))


def time_cutoff(df: DataFrame, day: str, quantile: float = 0.7) -> DataFrame:
    """The month of the row at that place among the sorted ones."""
    m = df.where(F.col(day).isNotNull()).select(F.date_format(day, "yyyy-MM").alias("month")).groupBy("month").agg(F.count("*").alias("c"))
    m = m.withColumn("to", F.sum("c").over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return m.where(F.col("to") > F.floor(F.lit(quantile) * (F.col("n") - 1))).agg(F.min("month").alias("month"))


def monthly_shares(df: DataFrame, day: str, group: str) -> DataFrame:
    g = df.groupBy(F.date_format(day, "yyyy-MM").alias("month"), F.col(group).alias("cluster")).agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("month")))


def emergence(shares: DataFrame, least: int = 20, ratio: float = 2.0) -> DataFrame:
    """Of each cluster the mean share in the last third of months over that in the first, and whether it emerges."""
    months = shares.select("month").distinct()
    k = F.floor(F.count("*").over(Window.partitionBy()) / 3)
    months = months.select("month", F.row_number().over(Window.orderBy("month")).alias("up"), F.row_number().over(Window.orderBy(F.desc("month"))).alias("down"), F.greatest(k, F.lit(1)).alias("k"))
    s = shares.join(F.broadcast(months), "month")
    early, late = F.col("up") <= F.col("k"), F.col("down") <= F.col("k")
    g = s.groupBy("cluster").agg(F.sum(F.when(early, F.col("share")).otherwise(0.0)).alias("e"), F.sum(F.when(late, F.col("share")).otherwise(0.0)).alias("l"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("late_n"), F.max("k").alias("k"))
    r = (F.col("l") / F.col("k")) / F.greatest(F.col("e") / F.col("k"), F.lit(1e-9))
    return g.select("cluster", r.alias("ratio"), "late_n", ((r >= ratio) & (F.col("late_n") >= least)).cast("int").alias("emerging"))
