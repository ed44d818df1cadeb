"""Behavioural segmentation of accounts from events: fit once, freeze, apply to anything later."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Roles, Settings
from ..operators import accounts, curves, models, similarity


#: Levels of the channel that a segmentation takes; more are an error, none is left out.
MOST_CHANNELS = 200


@dataclass
class Frozen:
    """What must not depend on the batch: the channels, prior branching ratios and the features' order."""

    channels: list[str]
    prior: float
    features: list[str]
    components: int
    segments: int


def blocks(events: DataFrame, roles: Roles, frozen: Frozen | None, channels: list[str], prior: float) -> DataFrame:
    """One row per account. events: time in days."""
    out = accounts.timing(events, roles.account, roles.time, roles.tie)
    parts = [accounts.self_excitation(events, roles.account, roles.time, prior=prior)]
    if roles.channel and roles.amount:
        parts.append(accounts.composition(events, roles.account, roles.channel, roles.amount, channels))
        parts.append(accounts.transition_features(accounts.transitions(events, roles.account, roles.time, roles.tie, roles.channel, channels), roles.account, len(channels)))
    if roles.amount:
        parts.append(accounts.scale(events, roles.account, roles.amount))
    for p in parts:
        out = out.join(p, roles.account)
    return out


class Segmentation:
    def __init__(self, roles: Roles, settings: Settings = Settings()):
        self.roles, self.settings = roles, settings
        self.frozen: Frozen | None = None
        self.space: PipelineModel | None = None
        self.centres: DataFrame | None = None
        self.bars: DataFrame | None = None

    def fit(self, events: DataFrame, labels: DataFrame) -> DataFrame:
        """labels: account, label. Returns accounts with cluster, conf, entropy, risk and lift."""
        r, s = self.roles, self.settings
        channels = [x[0] for x in events.select(r.channel).distinct().orderBy(r.channel).limit(MOST_CHANNELS + 1).collect()] if r.channel else []
        if len(channels) > MOST_CHANNELS:
            raise ValueError(f"{r.channel} has more than {MOST_CHANNELS} levels: group them first, each makes columns")
        table = blocks(events, r, None, channels, 0.3)
        features = [c for c in table.columns if c != r.account]
        self.frozen = Frozen(channels, 0.3, features, min(s.components, len(features)), s.segments)
        self.space, e = models.whitened(table, features, self.frozen.components)
        out = models.gaussian_segments(e.select(r.account, "embedding"), "embedding", s.segments, engine=s.engine)
        self.centres = similarity.centroids(out, "cluster", "embedding")
        self.bars = similarity.member_bars(out, "cluster", "embedding", self.centres)
        known = out.join(labels.groupBy(r.account).agg(F.max(r.label).alias(r.label)), r.account, "left").withColumn(r.label, F.coalesce(r.label, F.lit(0)))
        risk = curves.shrunk_risk(known, "cluster", r.label, prior=s.prior)
        base = known.agg(F.avg(F.col(r.label).cast("double")).alias("_base"))
        return known.join(F.broadcast(risk), "cluster").join(F.broadcast(base)).withColumn("lift", F.col("risk") / F.greatest("_base", F.lit(1e-12))).drop("_base")

    def embed(self, events: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        f = self.frozen
        table = blocks(events, self.roles, f, f.channels, f.prior).withColumns({c: F.col(c).cast("double") for c in f.features})
        scale = F.array(*(F.lit(1.0 / x) for x in models.axis_spread(self.space)))
        return self.space.transform(table).select(self.roles.account, F.zip_with(vector_to_array("_p"), scale, lambda a, b: a * b).alias("embedding"))

    def assign(self, events: DataFrame) -> DataFrame:
        """Accounts on the frozen segments: nearest centroid; under its bar, -1."""
        return similarity.nearest(self.embed(events), self.roles.account, "embedding", self.centres, self.bars)

    def save(self, path: str) -> None:
        spark = self.centres.sparkSession
        self.space.write().overwrite().save(f"{path}/space")
        self.centres.write.mode("overwrite").parquet(f"{path}/centres")
        self.bars.write.mode("overwrite").parquet(f"{path}/bars")
        text = json.dumps({"frozen": asdict(self.frozen), "roles": asdict(self.roles), "settings": asdict(self.settings)})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Segmentation":
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        out = cls(Roles(**spec["roles"]), Settings(**spec["settings"]))
        out.frozen = Frozen(**spec["frozen"])
        out.space = PipelineModel.load(f"{path}/space")
        out.centres, out.bars = spark.read.parquet(f"{path}/centres"), spark.read.parquet(f"{path}/bars")
        return out
