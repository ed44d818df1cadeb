"""Streams: rows on frozen centroids, and running self-excitation of accounts.

The analyses are batch ones; these are the same operators for files that keep arriving.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats


def files(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def assign(rows: DataFrame, key: str, vector: str, centres: list[tuple[int, list[float], float]]) -> DataFrame:
    """key, cluster, cosine on frozen centroids (name, centroid, bar): stateless, so batch and stream alike."""
    options = F.array(*(F.struct(stats.cosine(F.col(vector), F.array(*map(F.lit, map(float, c)))).alias("cos"), F.lit(-g).alias("g"), F.lit(float(bar)).alias("bar")) for g, c, bar in centres))
    best = rows.select(key, F.array_max(options).alias("b"))
    return best.select(key, F.when(F.col("b.cos") >= F.col("b.bar"), -F.col("b.g")).otherwise(-1).alias("cluster"), F.col("b.cos").alias("cosine"))


def excitation(events: DataFrame, account: str, ts: str, event: str, tau_seconds: float, delay: str = "1 hour") -> DataFrame:
    """account, event, r: as the batch operator, with the state of an account held between triggers.

    An account's events must arrive in order of time up to `delay`; repeated events within it count once."""
    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, r = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values(["s", "e"])
        out = []
        for s, e in zip(rows["s"], rows["e"]):
            r = 0.0 if last is None else math.exp(-max(s - last, 0.0) / tau_seconds) * (1.0 + r)
            last = s
            out.append(r)
        state.update((float(last), float(r)))
        yield pd.DataFrame({account: key[0], event: rows["e"].to_numpy(), "r": out})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark([event])
    e = e.select(account, (F.unix_micros(ts) / 1e6).alias("s"), F.col(event).alias("e"))
    return e.groupBy(account).applyInPandasWithState(step, f"{account} {kinds[account]}, {event} {kinds[event]}, r double", "last double, r double", "append", "NoTimeout")
