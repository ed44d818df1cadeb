"""Models on Spark ML: folds, boosted trees out of fold, path contributions, trees as rules, embeddings, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from ..operators.curves import adjusted_rand
from .rules import Rule

#: What stands for a missing value in trees: under every real one.
MISSING = -1e9


def account_folds(df: DataFrame, account: str, label: str, k: int = 5) -> DataFrame:
    """fold per account: accounts with and without positives are dealt in turn, so each fold has its share."""
    g = df.groupBy(account).agg(F.max(F.col(label).cast("int")).alias("_p"))
    return g.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("_p").orderBy(account)) - 1, F.lit(k))).drop("_p")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float, rare: int = 2) -> DataFrame:
    """is_val per row: the first share of each stratum in order of key; rare strata are one."""
    n = F.count("*").over(Window.partitionBy(stratum))
    s = df.withColumn("_s", F.when(n < rare, "<RARE>").otherwise(F.col(stratum).cast("string")))
    r = F.row_number().over(Window.partitionBy("_s").orderBy(key))
    return s.withColumn("is_val", (r <= F.floor(F.lit(share) * F.count("*").over(Window.partitionBy("_s")))).cast("int")).drop("_s")


def filled(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in features})


def boosted(features: list[str], label: str, depth: int = 4, trees: int = 20, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, stepSize=0.2)])


def out_of_fold(df: DataFrame, features: list[str], label: str, account: str, k: int = 3, **parameters) -> DataFrame:
    """df with score: each row's from a model that has not seen its account."""
    # each fold reads it several times
    data = filled(df.join(account_folds(df, account, label, k), account), features).withColumn(label, F.col(label).cast("double")).persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for fold in range(k):
        model = boosted(features, label, **parameters).fit(data.where(F.col("fold") != fold))
        part = model.transform(data.where(F.col("fold") == fold)).withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def tree_tables(model) -> list[tuple[float, dict[int, tuple]]]:
    """(weight, node -> (feature, threshold, left, right, value)) of each regression tree; value is a node's mean."""
    spark_nodes = model._java_obj.trees()
    out = []

    def walk(node, table: dict, values: dict) -> int:
        i = len(table)
        table[i] = None
        stats = node.impurityStats()
        raw = [float(x) for x in stats.stats()]
        mean = raw[1] / raw[0] if raw[0] else 0.0
        if "Internal" in node.getClass().getSimpleName():
            split = node.split()
            left, right = walk(node.leftChild(), table, values), walk(node.rightChild(), table, values)
            table[i] = (int(split.featureIndex()), float(split.threshold()), left, right, mean)
        else:
            table[i] = (-1, 0.0, -1, -1, float(node.prediction()))
        return i

    weights = list(model._java_obj.treeWeights())
    for k in range(len(weights)):
        table: dict = {}
        walk(spark_nodes[k].rootNode(), table, {})
        out.append((float(weights[k]), table))
    return out


def contributions(model: PipelineModel, df: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, contrib (array, one per feature), bias, margin: along each path the change of the node's mean goes to the split's feature.

    The log-odds are twice the sum of trees, so contributions are doubled; they and the bias add up to the margin."""
    trees = df.sparkSession.sparkContext.broadcast(tree_tables(model.stages[-1]))
    bias = 2 * sum(w * t[0][4] for w, t in trees.value)

    def run(batches):
        for rows in batches:
            x = rows[features].to_numpy(float)
            total = np.zeros(x.shape)
            for w, t in trees.value:
                at = np.zeros(len(x), int)
                alive = np.arange(len(x))
                table = np.array([t[i] for i in range(len(t))])
                while len(alive):
                    node = table[at[alive]]
                    inner = node[:, 0] >= 0
                    alive, node = alive[inner], node[inner]
                    f = node[:, 0].astype(int)
                    to = np.where(x[alive, f] <= node[:, 1], node[:, 2], node[:, 3]).astype(int)
                    np.add.at(total, (alive, f), 2 * w * (table[to, 4] - node[:, 4]))
                    at[alive] = to
            yield pd.DataFrame({key: rows[key], "contrib": list(total), "bias": bias})

    kind = df.schema[key].dataType.simpleString()
    data = filled(df, features)
    found = data.select(key, *features).mapInPandas(run, f"{key} {kind}, contrib array<double>, bias double")
    margin = model.transform(data).select(key, (2 * vector_to_array("rawPrediction")[1]).alias("margin"))
    return found.join(margin, key)


def importance(found: DataFrame, features: list[str], cover: float = 0.95, least: int = 10, most: int = 50) -> DataFrame:
    """feature, importance (mean size of its contribution), until the share covered reaches `cover`."""
    g = found.select(F.posexplode("contrib").alias("p", "x")).groupBy("p").agg(F.avg(F.abs("x")).alias("importance"))
    g = g.withColumn("feature", F.element_at(F.array(*map(F.lit, features)), F.col("p") + 1))
    w = Window.orderBy(F.desc("importance"), "feature")
    g = g.withColumn("_c", F.sum("importance").over(w.rowsBetween(Window.unboundedPreceding, -1)) / F.sum("importance").over(Window.partitionBy())).withColumn("_r", F.row_number().over(w))
    return g.where((F.col("_r") <= least) | ((F.coalesce("_c", F.lit(0.0)) < cover) & (F.col("_r") <= most))).select("feature", "importance")


def tree_rules(df: DataFrame, features: list[str], label: str, depth: int = 3, least: int = 30) -> list[tuple[Rule, float, int]]:
    """Leaves of a shallow tree as rules with their share of positives and size."""
    data = filled(df, features).withColumn(label, F.col(label).cast("double"))
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, minInstancesPerNode=least, seed=7)
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), tree]).fit(data).stages[-1]
    out: list[tuple[Rule, float, int]] = []

    def walk(node, bounds: dict) -> None:
        if "Internal" in node.getClass().getSimpleName():
            s = node.split()
            c, t = features[int(s.featureIndex())], float(s.threshold())
            lo, hi, n = bounds.get(c, (None, None, True))
            walk(node.leftChild(), bounds | {c: (lo, t if hi is None else min(t, hi), n)})
            walk(node.rightChild(), bounds | {c: (t if lo is None else max(t, lo), hi, n and t < MISSING)})
            return
        raw = [float(x) for x in node.impurityStats().stats()]
        n = sum(raw)
        out.append((Rule({c: (None if lo is not None and lo <= MISSING else lo, hi, null_ok) for c, (lo, hi, null_ok) in bounds.items()}), (raw[1] if len(raw) > 1 else 0.0) / max(n, 1.0), int(n)))

    walk(model._java_obj.rootNode(), {})
    return sorted(out, key=lambda x: (-x[1], -x[2]))


def whitened(df: DataFrame, features: list[str], k: int, output: str = "embedding", weight: float = 1.0) -> tuple[PipelineModel, DataFrame]:
    """Standardised, rotated to k principal axes, each of variance weight^2; nulls are means."""
    from pyspark.ml.feature import Imputer

    data = df.withColumns({c: F.col(c).cast("double") for c in features})
    filled_ = [f"_f_{c}" for c in features]
    known = data.agg(*(F.count(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in features)).first()
    # a feature without any value has no mean: it is 0 throughout
    data = data.withColumns({c: F.lit(0.0) for c in features if not known[c]})
    stages = [Imputer(inputCols=features, outputCols=filled_), VectorAssembler(inputCols=filled_, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), PCA(k=k, inputCol="_z", outputCol="_p")]
    model = Pipeline(stages=stages).fit(data)
    scale = F.array(*(F.lit(weight / s) for s in axis_spread(model)))
    out = model.transform(data).withColumn(output, F.zip_with(vector_to_array("_p"), scale, lambda a, b: a * b)).drop("_x", "_z", "_p", *filled_)
    return model, out


def axis_spread(model: PipelineModel) -> list[float]:
    """Standard deviation along each principal axis. Scaled columns have variance 1, but for constant ones, which have none."""
    varying = int((model.stages[-2].std.toArray() > 0).sum())
    return [float(x) for x in np.sqrt(np.maximum(model.stages[-1].explainedVariance.toArray() * varying, 1e-9))]


def gaussian_segments(df: DataFrame, vector: str, k: int, seed: int = 7, engine: str = "gmm") -> DataFrame:
    """df with cluster, conf, entropy: a mixture of Gaussians, or k-means with a softmax of distances; 0 is the largest."""
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("_x", array_to_vector(vector))
    if engine == "gmm":
        out = GaussianMixture(featuresCol="_x", k=k, seed=seed, maxIter=50).fit(data).transform(data).withColumn("_post", vector_to_array("probability"))
    else:
        model = KMeans(featuresCol="_x", k=k, seed=seed).fit(data)
        centres = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))
        d = F.transform(centres, lambda c: -F.aggregate(F.zip_with(c, F.col(vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        out = model.transform(data).withColumn("_d", d).withColumn("_e", F.transform("_d", lambda x: F.exp(x - F.array_max("_d"))))
        out = out.withColumn("_post", F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda s, y: s + y))).drop("_d", "_e")
    out = out.withColumn("conf", F.array_max("_post")).withColumn("entropy", -F.aggregate(F.transform("_post", lambda p: p * F.ln(p + 1e-12)), F.lit(0.0), lambda s, x: s + x))
    from .segments import relabel_by_size

    return relabel_by_size(out.withColumn("cluster", F.col("prediction").cast("int")).drop("_x", "_post", "prediction", "probability"), "cluster")


def choose_k(df: DataFrame, key: str, vector: str, ks: range, rounds: int = 2, engine: str = "kmeans") -> DataFrame:
    """k, ari, least_share: mean agreement of fits on hashed halves with the fit on all."""
    rows = []
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    for k in ks:
        full = gaussian_segments(df, vector, k, engine=engine).select(key, F.col("cluster").alias("a"))
        aris = []
        for r in range(rounds):
            part = df.where(F.pmod(F.xxhash64(key, F.lit(r)), F.lit(10)) < 7)
            half = gaussian_segments(part, vector, k, seed=r + 1, engine=engine).select(key, F.col("cluster").alias("b"))
            aris.append(adjusted_rand(full.join(half, key), "a", "b").first()[0])
        sizes = full.groupBy("a").count().agg(F.min("count"), F.sum("count")).first()
        rows.append((k, float(np.mean(aris)), float(sizes[0] / max(sizes[1], 1))))
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, ari double, least_share double")


def quantile_grid(df: DataFrame, features: list[str], points: int = 101) -> dict[str, list[float]]:
    """Quantiles of each feature, for rank_gauss; a few numbers per feature."""
    share = [k / (points - 1) for k in range(points)]
    r = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, share))).alias(c) for c in features)).first()
    return {c: [float(x) for x in (r[c] or [0.0, 0.0])] for c in features}


def rank_gauss(df: DataFrame, grid: dict[str, list[float]], clip: float = 5.0) -> DataFrame:
    """Each feature as the normal score of its place on the frozen grid of quantiles; nulls stay."""
    from .accounts import normal_score

    def place(c: str):
        knots = np.array(grid[c])

        def run(x: pd.Series) -> pd.Series:
            lo, hi = np.interp(x, knots, np.linspace(0, 1, len(knots))), 1 - np.interp(-x, -knots[::-1], np.linspace(0, 1, len(knots)))
            return pd.Series((lo + hi) / 2).where(x.notna())

        return F.pandas_udf(run, "double")(F.col(c).cast("double"))

    return df.withColumns({c: place(c) for c in grid}).withColumns({c: normal_score(c, clip, 1e-7) for c in grid})


def supervised_axis(df: DataFrame, features: list[str], label: str, key: str, k: int = 3, weight: float = 0.25) -> DataFrame:
    """key, axis: the log-odds of a balanced logistic fit out of fold, standardised, times the weight."""
    from pyspark.ml.classification import LogisticRegression

    data = df.fillna(0.0, subset=features).withColumn("_y", F.col(label).cast("double")).withColumn("_fold", F.pmod(F.xxhash64(key), F.lit(k)))
    rate = data.agg(F.avg("_y")).first()[0] or 0.5
    data = data.withColumn("_w", F.when(F.col("_y") == 1, 0.5 / max(rate, 1e-9)).otherwise(0.5 / max(1 - rate, 1e-9)))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_y", weightCol="_w", regParam=1e-2)])
    out = None
    for fold in range(k):
        part = pipe.fit(data.where(F.col("_fold") != fold)).transform(data.where(F.col("_fold") == fold)).select(key, vector_to_array("rawPrediction")[1].alias("m"))
        out = part if out is None else out.unionByName(part)
    stats_ = out.agg(F.avg("m").alias("a"), F.greatest(F.coalesce(F.stddev_pop("m"), F.lit(0.0)), F.lit(1e-9)).alias("s"))
    return out.join(F.broadcast(stats_)).select(key, ((F.col("m") - F.col("a")) / F.col("s") * weight).alias("axis"))


def diagonal_mixture(df: DataFrame, vector: str, k: int, rounds: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, variances) of Gaussians with diagonal covariance by EM: each round is one aggregation of sufficient
    statistics over all rows; only k x (2 d + 1) numbers come to the driver."""
    from pyspark.ml.functions import array_to_vector

    start = KMeans(featuresCol="_x", k=k, seed=seed, maxIter=5).fit(df.select(array_to_vector(vector).alias("_x")))
    means = np.array(start.clusterCenters(), dtype=float)
    k, d = means.shape
    spread = df.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.var_pop("x").alias("v")).orderBy("p").collect()
    variances = np.tile(np.maximum([r.v or 0.0 for r in spread], 1e-6), (k, 1))
    weights = np.full(k, 1 / k)
    for _ in range(rounds):
        w, m, v = weights, means, variances

        def run(batches, w=w, m=m, v=v):
            total = np.zeros((k, 2 * d + 1))
            for rows in batches:
                x = np.stack(rows[vector].to_numpy()).astype(float) if len(rows) else np.zeros((0, d))
                p = posterior(x, w, m, v)[0]
                total[:, 0] += p.sum(axis=0)
                total[:, 1 : d + 1] += p.T @ x
                total[:, d + 1 :] += p.T @ (x * x)
            yield pd.DataFrame({"k": np.arange(k), "s": list(total)})

        parts = df.select(vector).mapInPandas(run, "k int, s array<double>").select("k", F.posexplode("s").alias("p", "x")).groupBy("k", "p").agg(F.sum("x").alias("x")).collect()
        total = np.zeros((k, 2 * d + 1))
        for r in parts:
            total[r.k, r.p] = r.x
        n = np.maximum(total[:, :1], 1e-9)
        new = total[:, 1 : d + 1] / n
        variances = np.maximum(total[:, d + 1 :] / n - new * new, 1e-6)
        weights = (total[:, 0] + 1e-9) / (total[:, 0] + 1e-9).sum()
        moved, means = np.abs(new - means).max(), new
        if moved < 1e-6:
            break
    return weights, means, variances


def posterior(x: np.ndarray, weights: np.ndarray, means: np.ndarray, variances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior shares of the components and the log density of each row."""
    log = np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(axis=1) + (((x[:, None, :] - means) ** 2) / variances).sum(axis=2))
    top = log.max(axis=1, keepdims=True) if len(x) else np.zeros((0, 1))
    e = np.exp(log - top)
    return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300), (top[:, 0] + np.log(np.maximum(e.sum(axis=1), 1e-300)))


def mixture_assign(df: DataFrame, key: str, vector: str, mixture: tuple, least_conf: float = 0.70, least_density: float | None = None) -> DataFrame:
    """key, cluster, conf, density, distance (Mahalanobis in its own cluster); -1 where the posterior or the density is too low."""
    w, m, v = mixture

    def run(batches):
        for rows in batches:
            x = np.stack(rows[vector].to_numpy()).astype(float) if len(rows) else np.zeros((0, m.shape[1]))
            p, density = posterior(x, w, m, v)
            c = p.argmax(axis=1) if len(x) else np.zeros(0, int)
            conf = p[np.arange(len(x)), c]
            far = np.sqrt((((x - m[c]) ** 2) / v[c]).sum(axis=1))
            ok = (conf >= least_conf) & (density >= (-np.inf if least_density is None else least_density))
            yield pd.DataFrame({key: rows[key], "cluster": np.where(ok, c, -1), "conf": conf, "density": density, "distance": far})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, vector).mapInPandas(run, f"{key} {kind}, cluster int, conf double, density double, distance double")


def residualised(df: DataFrame, features: list[str], flags: list[str]) -> DataFrame:
    """Features less their least-squares fit on the flags: the sums of products come from one pass, the small system is solved on the driver."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in flags)]
    ys = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]
    n = len(cols)
    r = df.agg(*(F.sum(a * b).alias(f"g{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)), *(F.sum(a * y).alias(f"y{i}_{j}") for i, a in enumerate(cols) for j, y in enumerate(ys))).first()
    g = np.array([[r[f"g{i}_{j}"] or 0.0 for j in range(n)] for i in range(n)])
    b = np.array([[r[f"y{i}_{j}"] or 0.0 for j in range(len(ys))] for i in range(n)])
    beta = np.linalg.lstsq(g, b, rcond=None)[0]
    return df.withColumns({c: ys[j] - sum((cols[i] * float(beta[i, j]) for i in range(1, n)), F.lit(float(beta[0, j]))) for j, c in enumerate(features)})


def ablation(df: DataFrame, rungs: dict[str, list[str]], label: str, account: str, k: int = 2, **parameters) -> DataFrame:
    """rung, auc, average_precision out of fold for growing sets of features."""
    from .curves import auc, average_precision

    rows = []
    for name, features in rungs.items():
        scored = out_of_fold(df, features, label, account, k, **parameters).select("score", F.col(label).cast("int").alias(label))
        rows.append((name, float(auc(scored, ["score"], label).first()["auc"]), float(average_precision(scored, "score", label).first()[0])))
    return df.sparkSession.createDataFrame(rows, "rung string, auc double, average_precision double")


def elasticity(model, df: DataFrame, key: str, features: list[str], assign, steps: tuple[float, ...] = (-1.0, -0.5, 0.5, 1.0)) -> DataFrame:
    """feature, step, moved: the share of rows whose cluster changes when a feature moves by so many standard deviations.

    assign: DataFrame (key, features) -> (key, cluster)."""
    spread = df.agg(*(F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias(c) for c in features)).first()
    base = assign(df).select(key, F.col("cluster").alias("_was"))
    out = None
    for c in features:
        for s in steps:
            t = assign(df.withColumn(c, F.col(c) + s * float(spread[c]))).join(base, key)
            one = t.agg(F.lit(c).alias("feature"), F.lit(float(s)).alias("step"), F.avg((F.col("cluster") != F.col("_was")).cast("double")).alias("moved"))
            out = one if out is None else out.unionByName(one)
    return out


def train_val_split(df: DataFrame, key: str, share: float, mode: str = "stratified", stratum: str | None = None, account: str | None = None, day: str | None = None, rare: int = 10) -> DataFrame:
    """df with is_val.

    stratified: a share of each stratum, strata of fewer than `rare` rows together. account: whole accounts, stratified by
    the largest stratum value of each. time: the rows after the (1 - share) quantile of days; rows without a day train."""
    if mode == "stratified":
        return stratified_split(df, key, stratum, share, rare)
    if mode == "account":
        per = df.groupBy(account).agg(F.max(F.col(stratum).cast("string")).alias("_stratum"))
        return df.join(stratified_split(per, account, "_stratum", share, rare).select(account, "is_val"), account)
    if mode != "time":
        raise ValueError(f"no such split: {mode}")
    t = F.unix_micros(F.col(day).cast("timestamp")).cast("double")
    cut = df.agg(F.percentile(t, F.lit(1 - share)).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("is_val", F.coalesce((t > F.col("_cut")).cast("int"), F.lit(0))).drop("_cut")


def early_stopped(df: DataFrame, features: list[str], label: str, account: str, depth: int = 4, trees: int = 100, share: float = 0.15, tolerance: float = 0.01, seed: int = 7) -> PipelineModel:
    """Boosted trees that stop once the loss on a hashed share of accounts no longer falls."""
    data = filled(df, features).withColumn(label, F.col(label).cast("double")).withColumn("_val", F.pmod(F.xxhash64(account, F.lit(seed)), F.lit(1000)) < int(1000 * share))
    booster = GBTClassifier(featuresCol="_x", labelCol=label, maxDepth=depth, maxIter=trees, seed=seed, stepSize=0.2, validationIndicatorCol="_val", validationTol=tolerance)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), booster]).fit(data)


def split_gain(model: PipelineModel, features: list[str]) -> dict[str, float]:
    """Gain of all splits of each feature, weighted by their rows."""
    out = dict.fromkeys(features, 0.0)
    trees = model.stages[-1]._java_obj.trees()
    weights = list(model.stages[-1]._java_obj.treeWeights())

    def walk(node) -> None:
        if "Internal" in node.getClass().getSimpleName():
            out[features[int(node.split().featureIndex())]] += float(node.gain()) * float(node.impurityStats().count())
            walk(node.leftChild())
            walk(node.rightChild())

    for k in range(len(weights)):
        walk(trees[k].rootNode())
    return out


def gain_ranking(df: DataFrame, features: list[str], label: str, most: int = 400, forced: tuple[str, ...] = (), **parameters) -> list[str]:
    """Features that a quick fit splits on, by gain, at most `most`; forced ones stay anyway."""
    data = filled(df, features).withColumn(label, F.col(label).cast("double"))
    gain = split_gain(boosted(features, label, **parameters).fit(data), features)
    ranked = [c for c in sorted(features, key=lambda c: (-gain[c], c)) if gain[c] > 0][:most]
    return ranked + [c for c in forced if c not in ranked and c in features]


def refit(df: DataFrame, features: list[str], label: str, key: str, cover: float = 0.95, least: int = 10, most: int = 50, **parameters) -> tuple[PipelineModel, list[str]]:
    """A fit on all features, its most important ones, and the fit on these alone."""
    data = filled(df, features).withColumn(label, F.col(label).cast("double"))
    found = contributions(boosted(features, label, **parameters).fit(data), data, features, key)
    kept = [r.feature for r in importance(found, features, cover, least, most).orderBy(F.desc("importance"), "feature").collect()]
    return boosted(kept, label, **parameters).fit(data), kept


def scored_by(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(filled(df, features)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("_x", "rawPrediction", "probability", "prediction")


def temporal_missed(df: DataFrame, features: list[str], label: str, day: str, rate: float = 0.01, quantile: float = 0.7, **parameters) -> DataFrame:
    """Frauds after the cut-off month that a model of the months up to it scores under the alert threshold of goods."""
    from ..plans.discovery import missed
    from .curves import time_cutoff

    cut = time_cutoff(df, day, quantile).first()[0]
    month = F.date_format(day, "yyyy-MM")
    data = df.withColumn(label, F.col(label).cast("double"))
    model = boosted(features, label, **parameters).fit(filled(data.where(month <= cut), features))
    return missed(scored_by(model, data.where(month > cut), features), label, rate)


def choose_k_by_bic(df: DataFrame, vector: str, ks: range, train: str, least_ari: float = 0.8, least_share: float = 0.02, rounds: int = 20) -> DataFrame:
    """k, bic (fit on training rows), ari of a fit on the other rows, least share of a cluster, chosen: the lowest BIC among
    stable fits without tiny clusters, else among all. train: a 0/1 column."""
    d = len(df.select(vector).first()[0])
    data = df.withColumn("_k", F.xxhash64(vector)).select("_k", vector, train).persist(StorageLevel.MEMORY_AND_DISK)
    part = data.where(F.col(train) == 1)
    n, rows = part.count(), []
    for k in ks:
        one, other = diagonal_mixture(part, vector, k, rounds), diagonal_mixture(data.where(F.col(train) != 1), vector, k, rounds)
        a = mixture_assign(data, "_k", vector, one, 0.0).select("_k", F.col("cluster").alias("a"), "density")
        b = mixture_assign(data.where(F.col(train) != 1).dropDuplicates(["_k"]), "_k", vector, other, 0.0).select("_k", F.col("cluster").alias("b"))
        a = a.persist(StorageLevel.MEMORY_AND_DISK)
        loglik = a.join(part.select("_k").distinct(), "_k", "left_semi").agg(F.sum("density")).first()[0] or 0.0
        ari = adjusted_rand(a.dropDuplicates(["_k"]).join(b, "_k"), "a", "b").first()[0]
        sizes = [r[1] for r in a.groupBy("a").count().collect()]
        rows.append((k, float((k * (2 * d + 1) - 1) * np.log(max(n, 1)) - 2 * loglik), float(ari), float(min(sizes) / sum(sizes)) if len(sizes) == k else 0.0))
        a.unpersist()
    data.unpersist()
    fine = [r for r in rows if r[2] >= least_ari and r[3] >= least_share] or rows
    best = min(fine, key=lambda r: (r[1], r[0]))[0]
    return df.sparkSession.createDataFrame([(*r, int(r[0] == best)) for r in rows], "k int, bic double, ari double, least_share double, chosen int")


def bootstrap_stability(df: DataFrame, key: str, vector: str, k: int, rounds: int = 3, engine: str = "kmeans") -> DataFrame:
    """cluster, stability: over fits on hashed halves the mean of its best Jaccard index, among the half's rows."""
    from .curves import best_jaccard

    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    full = gaussian_segments(df, vector, k, engine=engine).select(key, F.col("cluster").alias("a")).persist(StorageLevel.MEMORY_AND_DISK)
    out = None
    for r in range(rounds):
        part = df.where(F.pmod(F.xxhash64(key, F.lit(r)), F.lit(10)) < 7)
        one = best_jaccard(full.join(gaussian_segments(part, vector, k, seed=r + 1, engine=engine).select(key, F.col("cluster").alias("b")), key), "a", "b")
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.col("a").alias("cluster")).agg(F.avg("jaccard").alias("stability"))


def separability(df: DataFrame, features: list[str], cluster: str, depth: int = 4, least: int = 30) -> DataFrame:
    """cluster, recall, precision of a shallow tree that tells all clusters apart."""
    data = filled(df, features).withColumn("_y", F.col(cluster).cast("double")).where("_y >= 0")
    tree = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=depth, minInstancesPerNode=least, seed=7)
    out = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), tree]).fit(data).transform(data)
    g = out.groupBy(F.col("_y").cast("int").alias("y"), F.col("prediction").cast("int").alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0))
    recall = g.groupBy(F.col("y").alias("cluster")).agg((hit / F.sum("n")).alias("recall"))
    return recall.join(g.groupBy(F.col("p").alias("cluster")).agg((hit / F.sum("n")).alias("precision")), "cluster", "left")


def boundary(moved: DataFrame, share: float = 0.5) -> DataFrame:
    """feature, step: the smallest move (rows of `elasticity`) that changes the cluster of at least the share of rows; null, if none does."""
    hit = F.when(F.col("moved") >= share, F.struct(F.abs("step").alias("a"), F.col("step").alias("s")))
    return moved.groupBy("feature").agg(F.min(hit).alias("m"), F.max("moved").alias("most")).select("feature", F.col("m.s").alias("step"), "most")


def plane(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, x, y: the first two principal coordinates, for a scatter plot."""
    from pyspark.ml.functions import array_to_vector

    data = df.select(key, array_to_vector(F.transform(vector, lambda v: v.cast("double"))).alias("_v"))
    model = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=False), PCA(k=2, inputCol="_z", outputCol="_p")]).fit(data)
    p = vector_to_array("_p")
    return model.transform(data).select(key, p[0].alias("x"), p[1].alias("y"))


def sub_segments(df: DataFrame, vector: str, cluster: str, k: int = 2, least: int = 200, engine: str = "kmeans") -> DataFrame:
    """df with sub: clusters of at least `least` rows are segmented once more by themselves; smaller ones are one."""
    out = None
    for r in df.groupBy(cluster).count().orderBy(cluster).collect():
        own = df.where(F.col(cluster).eqNullSafe(F.lit(r[0])))
        one = gaussian_segments(own.withColumnRenamed(cluster, "_was"), vector, k, engine=engine).withColumnsRenamed({"cluster": "sub", "_was": cluster}).select(*df.columns, "sub") if r[1] >= least else own.withColumn("sub", F.lit(0))
        out = one if out is None else out.unionByName(one)
    return df.withColumn("sub", F.lit(0)) if out is None else out
