"""Rules: conjunctions of bounds, counted over a whole population, found by beam search or token mining."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass
class Rule:
    """feature -> (low, high, null fits): low < x <= high; None is no bound."""

    bounds: dict[str, tuple[float | None, float | None, bool]] = field(default_factory=dict)
    #: feature -> texts of which it is one; feature -> whether it is null.
    levels: dict[str, list[str]] = field(default_factory=dict)
    nulls: dict[str, bool] = field(default_factory=dict)

    def column(self) -> Column:
        parts = [F.coalesce(F.col(c).cast("string").isin(*v), F.lit(False)) for c, v in self.levels.items()]
        parts += [F.col(c).isNull() if v else F.col(c).isNotNull() for c, v in self.nulls.items()]
        for c, (lo, hi, null_ok) in self.bounds.items():
            x = F.col(c)
            test = reduce(and_, [x > lo] * (lo is not None) + [x <= hi] * (hi is not None), F.lit(True))
            known = x.isNotNull() & F.coalesce(test, F.lit(False))
            parts.append((known | x.isNull()) if null_ok else known)
        return reduce(and_, parts, F.lit(True))

    def text(self, binary: tuple[str, ...] = ()) -> str:
        """binary: features of 0 and 1, whose bounds read as a value."""
        out = []
        for c, (lo, hi, null_ok) in self.bounds.items():
            if c in binary and (hi if lo is None else lo) is not None and 0 <= (hi if lo is None else lo) < 1 and (lo is None or hi is None):
                t = f"{c} = {int(lo is not None)}"
                out.append(f"({t} OR {c} IS NULL)" if null_ok else t)
                continue
            t = f"{c} > {lo:.4g}" if hi is None and lo is not None else f"{c} <= {hi:.4g}" if lo is None and hi is not None else f"{lo:.4g} < {c} <= {hi:.4g}" if lo is not None else f"{c} IS NOT NULL"
            out.append(f"({t} OR {c} IS NULL)" if null_ok else t)
        out += [f"{c} = {v[0]}" if len(v) == 1 else f"{c} in {{{', '.join(v)}}}" for c, v in self.levels.items()]
        out += [f"{c} IS NULL" if v else f"{c} IS NOT NULL" for c, v in self.nulls.items()]
        return " AND ".join(out) or "TRUE"

    def dumps(self) -> str:
        return json.dumps([self.bounds, self.levels, self.nulls], sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> "Rule":
        bounds, levels, nulls = json.loads(text)
        return cls({k: tuple(v) for k, v in bounds.items()}, levels, nulls)


def cluster_recall(df: DataFrame, rules: dict[str, Column], members: Column) -> DataFrame:
    """rule, cluster_recall: the share of the cluster's members that it holds."""
    m = F.coalesce(members, F.lit(False))
    one = [F.struct(F.lit(k).alias("rule"), (F.sum((F.coalesce(c, F.lit(False)) & m).cast("long")) / F.greatest(F.sum(m.cast("long")), F.lit(1))).alias("cluster_recall")) for k, c in rules.items()]
    return df.agg(F.array(*one).alias("x")).select(F.inline("x"))


def rule_counts(df: DataFrame, rules: dict[str, Column], label: str) -> DataFrame:
    """rule, frauds, goods, share of each, smoothed lift: all rules in one pass over df."""
    aggs = [F.sum(F.col(label).cast("long")).alias("_f"), F.count("*").alias("_n")]
    rows = []
    for k, (name, cond) in enumerate(rules.items()):
        x = F.coalesce(cond, F.lit(False)).cast("long")
        aggs += [F.sum(x * F.col(label)).cast("long").alias(f"f{k}"), F.sum(x).alias(f"n{k}")]
        rows.append(F.struct(F.lit(name).alias("rule"), F.col(f"f{k}").alias("frauds"), (F.col(f"n{k}") - F.col(f"f{k}")).alias("goods")))
    t = df.agg(*aggs).select("_f", "_n", F.inline(F.array(*rows)))
    g = F.col("_n") - F.col("_f")
    return t.select("rule", "frauds", "goods", (F.col("frauds") / F.greatest("_f", F.lit(1))).alias("fraud_share"), (F.col("goods") / F.greatest(g, F.lit(1))).alias("good_share"), (((F.col("frauds") + 0.5) / (F.col("_f") + 1.0)) / ((F.col("goods") + 0.5) / (g + 1.0))).alias("lift"))


def quantile_conditions(df: DataFrame, features: list[str], quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> dict[str, Rule]:
    """Bounds at quantiles of df, by their text."""
    q = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, quantiles))).alias(c) for c in features)).first()
    out: dict[str, Rule] = {}
    for c in features:
        for v in sorted(set(q[c] or [])):
            for r in (Rule({c: (None, float(v), False)}), Rule({c: (float(v), None, False)})):
                out.setdefault(r.text(), r)
    return out


def level_conditions(df: DataFrame, columns: list[str], label: str, least: int = 30, most: int = 30) -> dict[str, Rule]:
    """A condition for each level that enough positives have."""
    long = df.where(F.col(label) == 1).select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns)))).where("v IS NOT NULL")
    g = long.groupBy("c", "v").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    r = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "v"))
    return {x.text(): x for c, v in g.withColumn("r", r).where(F.col("r") <= most).orderBy("c", "v").select("c", "v").collect() for x in [Rule(levels={c: [v]})]}


def null_conditions(df: DataFrame, columns: list[str], label: str, least: int = 30) -> dict[str, Rule]:
    """IS NULL for each column that enough positives lack."""
    n = df.where(F.col(label) == 1).agg(*(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in columns)).first()
    return {r.text(): r for c in columns if (n[c] or 0) >= least for r in [Rule(nulls={c: True})]}


def bitmap_counts(df: DataFrame, key: str, items: dict[str, Column], combos: list[tuple[str, ...]]) -> DataFrame:
    """combo, n: rows that hold all items of a combination. Rows are numbered in the order of key; each item is a bitmap of 32 768
    rows at a time, and combinations AND these, so rows are read once however many combinations there are."""
    from . import ranks

    rows = ranks.numbered(df.select(key, *(F.coalesce(c, F.lit(False)).alias(f"i{k}") for k, c in enumerate(items.values()))), [F.col(key)], "_n")
    long = rows.select("_n", F.inline(F.array(*(F.struct(F.lit(name).alias("item"), F.col(f"i{k}").alias("h")) for k, name in enumerate(items))))).where("h")
    maps = long.groupBy("item", F.bitmap_bucket_number("_n").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_n")).alias("bits"))
    wanted = df.sparkSession.createDataFrame([("+".join(c), x, len(c)) for c in combos for x in c], "combo string, item string, size int")
    both = maps.join(F.broadcast(wanted), "item").groupBy("combo", "size", "bucket").agg(F.count("*").alias("k"), F.expr("bitmap_and_agg(bits)").alias("bits"))
    found = both.where("k = size").groupBy("combo").agg(F.sum(F.bitmap_count("bits")).alias("n"))
    return wanted.select("combo").distinct().join(found, "combo", "left").select("combo", F.coalesce("n", F.lit(0)).alias("n"))


def joined(a: Rule, b: Rule) -> Rule | None:
    """Both; None where that says nothing new or nothing fits."""
    if any(c in a.levels and a.levels[c] != v for c, v in b.levels.items()) or any(a.nulls.get(c, v) != v for c, v in b.nulls.items()):
        return None
    if any(c in b.bounds or c in b.levels for c, v in a.nulls.items() if v) or any(c in a.bounds or c in a.levels for c, v in b.nulls.items() if v):
        return None
    if b.levels or b.nulls:
        new = Rule(a.bounds | b.bounds, a.levels | b.levels, a.nulls | b.nulls)
        return None if new == a else new
    out = dict(a.bounds)
    for c, (lo, hi, null_ok) in b.bounds.items():
        if c in out:
            l2, h2, n2 = out[c]
            lo, hi = max((x for x in (lo, l2) if x is not None), default=None), min((x for x in (hi, h2) if x is not None), default=None)
            null_ok &= n2
            if lo is not None and hi is not None and lo >= hi:
                return None
        out[c] = (lo, hi, null_ok)
    return None if out == a.bounds or (a.bounds and out == b.bounds and not a.levels and not a.nulls) else Rule(out, a.levels, a.nulls)


def beam(df: DataFrame, label: str, items: dict[str, Rule], width: int = 30, depth: int = 3, exponent: float = 0.5, least: int = 30) -> list[tuple[Rule, float, int, int]]:
    """Best conjunctions by n^a (p - p0): each level is one pass that counts all candidates; only counts come to the driver."""
    base = df.agg(F.count("*"), F.sum(F.col(label).cast("long"))).first()
    n, f = base[0], base[1] or 0
    if not n:
        return []
    p0, found, front = f / n, {}, [Rule()]
    for _ in range(depth):
        wanted = {r.dumps(): r for a in front for b in items.values() if (r := joined(a, b)) is not None and r.dumps() not in found}
        names = list(wanted)
        scored = []
        for i in range(0, len(names), 400):
            part = names[i : i + 400]
            counts = df.agg(*(c for k, s in enumerate(part) for x in [wanted[s].column().cast("long")] for c in (F.sum(x).alias(f"n{k}"), F.sum(x * F.col(label)).alias(f"f{k}")))).first()
            scored += [(wanted[s], counts[f"n{k}"] or 0, int(counts[f"f{k}"] or 0)) for k, s in enumerate(part)]
        level = [(r, (c / n) ** exponent * (h / c - p0), c, h) for r, c, h in scored if h >= least and c]
        found |= {r.dumps(): (r, q, c, h) for r, q, c, h in level}
        front = [r for r, *_ in sorted(level, key=lambda x: (-x[1], x[0].text()))[:width]]
        if not front:
            break
    return sorted(found.values(), key=lambda x: (-x[1], x[0].text()))[:width]


def peel(df: DataFrame, label: str, features: list[str], rounds: int = 5, least: int = 30, levels: tuple[str, ...] = (), **parameters) -> list[tuple[Rule, float, int, int]]:
    """Sequential covering: the best rule, then the best among the frauds that it misses."""
    out, items = [], quantile_conditions(df, features) | (level_conditions(df, levels, label, least) | null_conditions(df, [*features, *levels], label, least) if levels else null_conditions(df, features, label, least))
    rest = df
    for _ in range(rounds):
        best = beam(rest, label, items, least=least, **parameters)
        if not best or best[0][1] <= 0:
            break
        out.append(best[0])
        rest = rest.where(~(best[0][0].column() & (F.col(label) == 1)))
    return out


def token_combinations(df: DataFrame, key: str, tokens: str, label: str, least: int, lift: float = 3.0, top: int = 80, top_pairs: int = 200, most: int = 3) -> DataFrame:
    """combo (sorted array), frauds, goods, lift: sets of up to `most` tokens that frauds hold often enough.

    As in Apriori a set is only counted if its parts are frequent; the tokens and pairs that are extended are the most frequent ones."""
    t = df.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"), F.explode(F.array_distinct(tokens)).alias("t"))
    counts = lambda x, *by: x.groupBy(*by).agg(F.sum("y").alias("frauds"), F.sum(1 - F.col("y")).alias("goods")).where(F.col("frauds") >= least)
    ones = counts(t, "t").orderBy(F.desc("frauds"), "t").limit(top)
    t = t.join(F.broadcast(ones.select("t")), "t")
    sets = t.select("k", "y", F.array("t").alias("c"))
    out = ones.select(F.array("t").alias("c"), "frauds", "goods")
    for _ in range(most - 1):
        wide = sets.join(t.select("k", "t"), "k").where(F.col("t") > F.element_at("c", -1)).select("k", "y", F.concat("c", F.array("t")).alias("c"))
        frequent = counts(wide, "c")
        out = out.unionByName(frequent)
        sets = wide.join(F.broadcast(frequent.orderBy(F.desc("frauds"), "c").limit(top_pairs).select("c")), "c")
    n = df.agg(F.sum(F.col(label).cast("long")).alias("nf"), F.sum(1 - F.col(label).cast("long")).alias("ng"))
    l = (F.col("frauds") / F.greatest("nf", F.lit(1))) / ((F.col("goods") + 1) / (F.col("ng") + 1))  # noqa: E741
    return out.join(F.broadcast(n)).withColumn("lift", l).where(F.col("lift") >= lift).select(F.array_join("c", "+").alias("combo"), "frauds", "goods", "lift")
