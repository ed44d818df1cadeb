"""Ranks and running sums over all rows, without a window over one partition.

Rows are dealt into ranges of the order by split points from a bounded sample of hashed rows; each range is
sorted by itself, and the totals of the ranges before (one row per range) are added. Split points decide only
how evenly rows lie, never a result. Ranks with ties count distinct values first, so one value that many rows
hold is one row of the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sampled rows for each range.
PER_RANGE = 64


def split_points(df: DataFrame, keys: list[Column], ranges: int) -> list:
    """At most ranges - 1 rows of keys that cut the order into about equal parts."""
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    rows = df.select(*named)
    names = rows.columns
    sample = rows.orderBy(F.xxhash64(*names), *names).limit(PER_RANGE * ranges).orderBy(*names).collect()
    step = max(1, len(sample) // ranges)
    return [sample[i] for i in range(step, len(sample), step)][: ranges - 1], rows.schema


def in_ranges(df: DataFrame, keys: list[Column], name: str = "_range") -> DataFrame:
    """df with the number of its range: how many split points do not come after its keys. Nulls come first."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points, schema = split_points(df, keys, ranges)
    if not points:
        return df.withColumn(name, F.lit(0))
    kinds = [f.dataType for f in schema]
    cuts = F.array(*(F.struct(*(F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(p, kinds)))) for p in points))
    own = F.struct(*(k.cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(keys, kinds))))
    return df.withColumn("_own", own).withColumn(name, F.size(F.filter(cuts, lambda p: p <= F.col("_own")))).drop("_own")


def running(df: DataFrame, keys: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum over all rows up to and with its own in the order of keys (ascending).

    Rows with equal keys come one after another in an order that is not defined."""
    t = in_ranges(df, keys)
    w = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range
    totals = t.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items())).select("_range", *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in sums))
    t = t.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return t.withColumns({n: F.col(n) + F.col(f"_t_{n}") for n in sums}).drop("_range", *(f"_t_{n}" for n in sums))


def numbered(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """df with its place in the order of keys, from 1."""
    return running(df, keys, {name: F.lit(1).cast("long")})


def below(df: DataFrame, value: str, sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """One row per distinct value: for each name its sum there, `<name>_below` over the values before, `<name>_all`."""
    g = df.where(F.col(value).isNotNull()).groupBy(value).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    key = -F.col(value) if descending else F.col(value)
    out = running(g, [key], {f"{n}_to": F.col(n) for n in sums})
    total = g.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(f"{n}_all") for n in sums))
    return out.withColumns({f"{n}_below": F.col(f"{n}_to") - F.col(n) for n in sums}).drop(*(f"{n}_to" for n in sums)).join(F.broadcast(total))


def with_average_rank(df: DataFrame, value: str, name: str, share: bool = False, source: DataFrame | None = None) -> DataFrame:
    """df with the rank of value among the rows that have one, ties averaged; as a share of their number, if wanted. Null stays null.

    source: the same rows before other columns were joined to them, so that ranks of many columns do not wait for each other."""
    b = below(df if source is None else source, value, {"_n": F.lit(1).cast("long")})
    rank = F.col("_n_below") + (F.col("_n") + 1) / 2
    return df.join(b.select(F.col(value).alias("_v"), (rank / F.col("_n_all") if share else rank).alias(name)), F.col(value) == F.col("_v"), "left").drop("_v")
