"""From labelled extracts to segments of missed fraud, described as rules and priced on the whole population."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Roles, Settings
from ..operators import curves, encode, models, rules, segments
from ..sources import extracts


@dataclass
class Discovery:
    scored: DataFrame
    segments: DataFrame
    summary: DataFrame
    rules: dict[str, rules.Rule]
    dropped: dict[str, str]
    recipe: encode.Recipe | None = None

    def save(self, path: str) -> None:
        """Tables as Parquet; rules, what was dropped and the recipe as JSON."""
        spark = self.segments.sparkSession
        self.segments.write.mode("overwrite").parquet(f"{path}/segments")
        if self.summary is not None:
            self.summary.write.mode("overwrite").parquet(f"{path}/summary")
        text = json.dumps({"rules": {k: r.dumps() for k, r in self.rules.items()}, "dropped": self.dropped, "recipe": self.recipe.dumps() if self.recipe else None})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def rebuilt(spark: SparkSession, path: str, raw: DataFrame, keep: list[str]) -> tuple[DataFrame, dict[str, rules.Rule]]:
    """(the features of a saved discovery made of new raw rows, with a flag for each rule; the rules)."""
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    found = {k: rules.Rule.loads(t) for k, t in spec["rules"].items()}
    x = encode.Recipe.loads(spec["recipe"]).apply(raw, keep) if spec["recipe"] else raw
    return x.withColumns({f"rule__{k}": r.column().cast("int") for k, r in found.items()}), found


def screen(df: DataFrame, features: list[str], roles: Roles, settings: Settings) -> tuple[list[str], dict[str, str]]:
    """Features that stay, and why others went: leaks, constants, and what correlates with a better one."""
    nulls = encode.null_verdicts(encode.null_rates(df, features, roles.label), settings.null_leak).collect()
    dropped = {r.column: r.verdict for r in nulls if r.verdict != "keep"}
    rest = [c for c in features if c not in dropped]
    stats = encode.screened(curves.auc(df, rest, roles.label).join(encode.top_shares(df, rest), "column"), settings.auc_leak, settings.constant_share).collect()
    dropped |= {r.column: r.verdict for r in stats if r.verdict != "keep"}
    order = [r.column for r in sorted(stats, key=lambda r: (-abs(r.auc - 0.5), r.column)) if r.verdict == "keep"]
    kept = encode.correlation_filter([tuple(r) for r in curves.spearman(df, order).collect()], order, settings.most_correlation) if len(order) > 1 else order
    return kept, dropped | {c: "correlated" for c in order if c not in kept}


def missed(scored: DataFrame, label: str, rate: float, score: str = "score") -> DataFrame:
    """Frauds whose score, a model's or one that the extracts bring, stays under the alert threshold, the quantile of goods' scores."""
    cut = scored.where(F.col(label) == 0).agg(F.percentile(score, F.lit(1 - rate)).alias("_cut"))
    return scored.join(F.broadcast(cut)).where((F.col(label) == 1) & (F.col(score) < F.col("_cut"))).drop("_cut")


def discover(goods: DataFrame, fraud: DataFrame, roles: Roles, key: str, settings: Settings = Settings(), hook=None) -> Discovery:
    """goods and fraud hold key, the account and the raw features. Only recipes, rules and small summaries reach the driver."""
    both = extracts.labelled(goods, fraud, roles.account, roles.label)
    extracts.require(both, [roles.account, key, *roles.features])
    if roles.rename:
        both = both.withColumnsRenamed(roles.rename)
    recipe = encode.fit_recipe(both, [c for c in roles.features if c not in roles.exclude], roles.label, roles.anchor, tuple(roles.dates))
    x = recipe.apply(both, [key, roles.account, roles.label])
    names = recipe.names(both)
    if hook is not None:
        x, more = encode.custom_features(x, hook, [key, roles.account, roles.label], (key, roles.account, roles.label))
        names = [c for c in [*names, *more] if c in x.columns]
    features, dropped = screen(x, names, roles, settings)
    forced = [c for c in roles.force_keep if c in names and c not in features]
    features, dropped = features + forced, {c: w for c, w in dropped.items() if c not in forced}
    if settings.missed == "existing_score":
        scored = x.join(both.select(key, F.col(roles.score).cast("double").alias("score")), key)
        pool = missed(scored, roles.label, settings.alert_rate)
    elif settings.missed == "temporal":
        scored = x.join(both.select(key, roles.anchor), key) if roles.anchor not in x.columns else x
        pool = models.temporal_missed(scored, features, roles.label, roles.anchor, settings.alert_rate, trees=settings.trees, depth=settings.depth)
    else:
        scored = models.out_of_fold(x, features, roles.label, roles.account, k=settings.folds, trees=settings.trees, depth=settings.depth)
        pool = missed(scored, roles.label, settings.alert_rate)
    _, space = models.whitened(pool, features, min(settings.components, len(features)))
    parts = models.gaussian_segments(space.select(key, "embedding"), "embedding", settings.segments, engine=settings.engine).select(key, "cluster", "conf")
    found = {}
    for c in [r[0] for r in parts.select("cluster").distinct().orderBy("cluster").collect()]:
        own = parts.where(F.col("cluster") == c).select(key, F.lit(1).alias("_in"))
        against = x.join(own, key, "left").where((F.col("_in") == 1) | (F.col(roles.label) == 0)).withColumn("_in", F.coalesce("_in", F.lit(0)))
        leaves = models.tree_rules(against, features, "_in", least=settings.least_rows)
        if leaves and leaves[0][1] > 0:
            found[f"S{c:02d}"] = leaves[0][0]
    summary = rules.rule_counts(x, {k: r.column() for k, r in found.items()}, roles.label) if found else None
    return Discovery(scored, parts, summary, found, dropped, recipe)


def known_report(df: DataFrame, conditions: dict[str, str], label: str, weight: float) -> DataFrame:
    """Hit metrics of each known behaviour."""
    tagged = segments.behaviours(df, conditions)
    rows = tagged.select(label, F.explode(F.array(*(F.struct(F.lit(k).alias("mo"), F.col(f"mo__{k}").alias("hit")) for k in conditions))).alias("x")).where("x.hit = 1")
    return segments.hit_metrics(rows.select(label, F.col("x.mo").alias("mo")), "mo", label, weight)
