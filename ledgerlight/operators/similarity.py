"""Similarity between accounts and of rows to centroids.

Pairs are formed against a stated set of references or of pairs; references are counted before they are
sent to all tasks, and beyond the bound they go in blocks that meet the rows by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import stats
from . import kernels, ranks

#: References that every task may hold; more are split into that many rows a block.
MAX_REFERENCES = 20_000


def against(rows: DataFrame, references: DataFrame, limit: int = MAX_REFERENCES) -> DataFrame:
    """Each row with each reference. The references' number is checked; blocks keep tasks small beyond it."""
    n = references.count()
    blocks = max(1, -(-n // limit))
    if blocks == 1:
        return rows.join(F.broadcast(references))
    refs = references.withColumn("_b", F.pmod(F.xxhash64(*references.columns), F.lit(blocks)))
    return rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(refs, "_b").drop("_b")


def shared_tokens(edges: DataFrame, account: str, token: str, most: int | None = None, places: int | None = None) -> DataFrame:
    """a < b, common, jaccard of accounts that share a token. Tokens with more than `most` accounts, if given, do not start a pair but count in sizes and overlaps."""
    e = edges.select(F.col(account).alias("a"), F.col(token).alias("t")).where("a IS NOT NULL AND t IS NOT NULL")
    return kernels.pairs(e, most, places)


def gower(pairs: DataFrame, rows: DataFrame, key: str, numbers: list[str], kinds: list[str]) -> DataFrame:
    """pairs (a, b) with the mean difference of percentile ranks and of kinds."""
    source = r = rows.select(key, *numbers, *kinds)
    for c in numbers:
        r = ranks.with_average_rank(r, c, f"_r_{c}", share=True, source=source)
    r = r.select(key, *(F.col(f"_r_{c}").alias(c) for c in numbers), *kinds)
    left = r.select(*(F.col(c).alias("a" if c == key else f"a_{c}") for c in r.columns))
    right = r.select(*(F.col(c).alias("b" if c == key else f"b_{c}") for c in r.columns))
    t = pairs.join(left, "a").join(right, "b")
    parts = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in numbers] + [(F.col(f"a_{c}") != F.col(f"b_{c}")).cast("double") for c in kinds]
    return t.select("a", "b", (sum(parts[1:], parts[0]) / len(parts)).alias("gower"))


def mix_distances(pairs: DataFrame, mixes: DataFrame, key: str) -> DataFrame:
    """pairs (a, b) with Hellinger's and Jensen-Shannon's distance of their mixes."""
    t = pairs.join(mixes.select(F.col(key).alias("a"), F.col("mix").alias("p")), "a").join(mixes.select(F.col(key).alias("b"), F.col("mix").alias("q")), "b")
    soft = lambda c: F.transform(c, lambda x: (x + 1e-6) / (1 + F.size(c) * 1e-6))
    return t.select("a", "b", stats.hellinger(F.col("p"), F.col("q")).alias("hellinger"), stats.jensen_shannon(soft(F.col("p")), soft(F.col("q"))).alias("js"))


def combine(weights: dict[str, float]) -> Column:
    """Mean of distance blocks by their positive weights."""
    used = {k: w for k, w in weights.items() if w > 0}
    parts = [F.col(k) * w for k, w in used.items()]
    return sum(parts[1:], parts[0]) / sum(used.values())


def kernel_scores(rows: DataFrame, references: DataFrame, key: str, vector: str, label: str, kind: str, k: int = 7, best: int = 3) -> DataFrame:
    """key, score, predicted, exemplar: log ratio of the kernel mass of fraud and genuine references.

    The kernel adapts to both sides: sigma is the distance of the k-th nearest reference, a reference itself
    excluded. Per row only k distances and a few sums are kept."""
    refs = references.select(F.col(key).alias("_rk"), F.col(vector).alias("_rv"), F.col(label).alias("_ry"), F.col(kind).alias("_rt"))

    n, m = rows.count(), references.count()

    def sigma(a: DataFrame, name: str, size: int) -> DataFrame:
        near = kernels.nearest(a.select(F.col(key).alias("_k"), F.col(vector).alias("_v")), refs.select("_rk", "_rv"), k, (size, m))
        return near.select("_k", F.array_max("near").alias(name))

    widths = sigma(references, "sb", m).withColumnRenamed("_k", "_rk")
    own = rows.select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    if m <= kernels.REFERENCES:
        # every task sees all references, so it finds its rows' widths itself
        mass = kernels.kernel_mass(own, refs.join(widths, "_rk", "left"), best, size=(n, m), near=k)
    else:
        mass = kernels.kernel_mass(own.join(sigma(rows, "sa", n), "_k"), refs.join(widths, "_rk"), best, size=(n, m))
    ordered = F.array_sort(F.transform("top", lambda x: F.struct((-x["s"]).alias("o"), x["r"].alias("r"), x["t"].alias("t"))))
    own_kind = lambda t: F.slice(F.filter(ordered, lambda x: x["t"].eqNullSafe(t)), 1, best)
    mean = lambda t: F.aggregate(own_kind(t), F.lit(0.0), lambda s, x: s - x["o"]) / F.size(own_kind(t))
    kinds = F.transform(F.array_distinct(F.transform("top", lambda x: x["t"])), lambda t: F.struct(F.round(mean(t), 13).alias("m"), t.alias("t")))
    score = F.ln((F.col("f") + 1e-12) / (F.col("g") + 1e-12))
    return mass.select(F.col("_k").alias(key), score.alias("score"), F.array_max(kinds)["t"].alias("predicted"), F.get(ordered, F.lit(0))["r"].alias("exemplar"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid (array): the mean of each place."""
    g = rows.select(F.col(group).alias("group"), F.posexplode(vector).alias("p", "x")).groupBy("group", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return g.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest(rows: DataFrame, key: str, vector: str, centres: DataFrame, bars: DataFrame | None = None, euclid: bool = False) -> DataFrame:
    """key, cluster, cosine (or distance): the nearest centroid, ties to the smaller; under its bar, -1."""
    value = stats.distance(F.col(vector), F.col("centroid")) if euclid else stats.cosine(F.col(vector), F.col("centroid"))
    # one row per pair, but only the best is kept for each row
    t = against(rows.select(key, vector), centres).select(key, F.col("group"), value.alias("v"))
    order = F.struct(F.round("v", 12).alias("r"), F.col("group")) if euclid else F.struct(F.round(-F.col("v"), 12).alias("r"), F.col("group"))
    best = t.groupBy(key).agg(F.min(F.struct(order.alias("o"), F.col("v"))).alias("b")).select(key, F.col("b.o.group").alias("cluster"), F.col("b.v").alias("distance" if euclid else "cosine"))
    if bars is None:
        return best
    ok = best.join(F.broadcast(bars.select(F.col("group").alias("cluster"), "bar")), "cluster", "left")
    return ok.select(key, F.when(F.col("cosine") >= F.coalesce("bar", F.lit(-1.0)), F.col("cluster")).otherwise(-1).alias("cluster"), "cosine")


def member_bars(rows: DataFrame, group: str, vector: str, centres: DataFrame, quantile: float = 0.05) -> DataFrame:
    """group, bar: the low quantile of members' cosine with their own centroid."""
    t = rows.select(F.col(group).alias("group"), vector).join(F.broadcast(centres), "group")
    return t.groupBy("group").agg(F.percentile(stats.cosine(F.col(vector), F.col("centroid")), F.lit(quantile)).alias("bar"))


def distinctness(centres: DataFrame) -> DataFrame:
    """The least 1 - cosine between centroids. Centroids are few: one for each group."""
    b = centres.select(F.col("group").alias("g2"), F.col("centroid").alias("c2"))
    return against(centres, b).where("group < g2").agg(F.min(1 - stats.cosine(F.col("centroid"), F.col("c2"))).alias("distinctness"))


def merge_groups(vectors: dict[int, list[float]], cut: float = 0.2) -> dict[int, int]:
    """Average linkage of centroids by cosine distance up to the cut; for the few centroids of a model, on the driver."""
    import numpy as np

    names = sorted(vectors)
    x = np.array([vectors[n] for n in names], dtype=float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - x @ x.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > 1:
        best = min(((float(np.mean(d[np.ix_(a, b)])), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return {names[i]: k for k, g in enumerate(sorted(groups, key=min)) for i in g}


def nearest_profiles(rows: DataFrame, group: str, vector: str, profiles: DataFrame) -> DataFrame:
    """For each group the profile (group, centroid) with the highest cosine of centred means."""
    g = centroids(rows, group, vector)
    mean = rows.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("mean"))
    less = lambda c: F.zip_with(c, F.col("mean"), lambda a, b: a - b)
    t = against(g.join(F.broadcast(mean)), profiles.select(F.col("group").alias("profile"), F.col("centroid").alias("pc")))
    t = t.select("group", "profile", stats.cosine(less(F.col("centroid")), less(F.col("pc"))).alias("cosine"))
    r = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(F.round("cosine", 12)), "profile"))
    return t.withColumn("_r", r).where("_r = 1").drop("_r")


def knn_mean_distance(rows: DataFrame, references: DataFrame, key: str, vector: str, k: int = 7) -> DataFrame:
    """key, distance: the mean Euclidean distance to the k nearest references, itself excluded."""
    near = kernels.nearest(rows.select(F.col(key).alias("_k"), F.col(vector).alias("_v")), references.select(F.col(key).alias("_rk"), F.col(vector).alias("_rv")), k)
    return near.select(F.col("_k").alias(key), (stats.total(F.col("near")) / F.size("near")).alias("distance"))


def learned_weights(pairs: DataFrame, blocks: list[str], same: str) -> dict[str, float]:
    """Weights of distance blocks from a balanced logistic fit on pairs; negative ones are 0, and if all are, equal."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n = pairs.agg(F.avg(F.col(same).cast("double"))).first()[0] or 0.5
    data = pairs.select(*((-F.col(b)).alias(b) for b in blocks), F.col(same).cast("double").alias("label"))
    data = data.withColumn("w", F.when(F.col("label") == 1, 0.5 / max(n, 1e-9)).otherwise(0.5 / max(1 - n, 1e-9)))
    fit = Pipeline(stages=[VectorAssembler(inputCols=blocks, outputCol="x"), LogisticRegression(featuresCol="x", weightCol="w", regParam=1e-3)]).fit(data)
    w = [max(0.0, float(x)) for x in fit.stages[-1].coefficients]
    return dict(zip(blocks, w if any(w) else [1.0] * len(blocks)))


def attention(df: DataFrame, features: list[str], label: str) -> dict[str, float]:
    """Fisher's criterion of each feature, relative to the mean; one pass."""
    y = F.col(label)
    aggs = [a for c in features for k in (0, 1) for a in (F.avg(F.when(y == k, F.col(c))), F.var_pop(F.when(y == k, F.col(c))))]
    r = df.agg(*(a.alias(f"a{i}") for i, a in enumerate(aggs))).first()
    raw = {}
    for i, c in enumerate(features):
        m0, v0, m1, v1 = (r[4 * i + j] or 0.0 for j in range(4))
        raw[c] = (m1 - m0) ** 2 / max(v0 + v1, 1e-12)
    mean = sum(raw.values()) / max(len(raw), 1)
    return {c: x / mean if mean > 0 else 1.0 for c, x in raw.items()}


def sampled_pairs(df: DataFrame, key: str, group: str, per_row: int = 3, seed: int = 0) -> DataFrame:
    """a, b: for each row the next few rows of its group in hashed order. A sampling operator."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(key, F.lit(seed)), key)
    r = df.select(key, group, F.row_number().over(order).alias("_r"), F.count("*").over(Window.partitionBy(group)).alias("_n"))
    steps = r.withColumn("_s", F.explode(F.array(*(F.lit(k) for k in range(1, per_row + 1))))).withColumn("_t", F.pmod(F.col("_r") - 1 + F.col("_s"), F.col("_n")) + 1)
    other = r.select(F.col(key).alias("b"), F.col(group).alias("_g"), F.col("_r").alias("_t2"))
    return steps.join(other, (F.col(group) == F.col("_g")) & (F.col("_t") == F.col("_t2"))).where(F.col(key) != F.col("b")).select(F.col(key).alias("a"), "b").distinct()


def raw_gower_knn(rows: DataFrame, references: DataFrame, key: str, numbers: list[str], kinds: list[str], k: int = 7) -> DataFrame:
    """key, distance: the mean of the k least Gower distances to references, itself excluded; numbers are divided by their range in
    the references, kinds are equal or not."""
    span = references.agg(*(F.greatest(F.max(F.col(c).cast("double")) - F.min(F.col(c).cast("double")), F.lit(1e-9)).alias(f"_s_{c}") for c in numbers))
    refs = references.join(F.broadcast(span)).select(F.col(key).alias("_rk"), *(F.col(c).alias(f"_r_{c}") for c in [*numbers, *kinds]), *(f"_s_{c}" for c in numbers))
    near = kernels.gower_nearest(rows.select(F.col(key).alias("_k"), *numbers, *kinds), refs, numbers, kinds, k)
    return near.select(F.col("_k").alias(key), (stats.total(F.col("near")) / F.nullif(F.size("near"), F.lit(0))).alias("distance"))


def fixed_kernel_scores(rows: DataFrame, references: DataFrame, key: str, vector: str, label: str, gamma: float) -> DataFrame:
    """key, score: log ratio of the mass exp(-d^2 / gamma) of fraud and genuine references, one bandwidth for all."""
    refs = references.select(F.col(key).alias("_rk"), F.col(vector).alias("_rv"), F.col(label).alias("_ry"))
    mass = kernels.kernel_mass(rows.select(F.col(key).alias("_k"), F.col(vector).alias("_v")), refs, gamma=gamma)
    return mass.select(F.col("_k").alias(key), F.ln((F.col("f") + 1e-12) / (F.col("g") + 1e-12)).alias("score"))


def median_bandwidth(rows: DataFrame, key: str, vector: str, pairs: int = 4000, seed: int = 0) -> float:
    """The median squared distance of hashed pairs of rows: a bandwidth from a bounded sample."""
    s = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(2 * pairs)
    n = s.withColumn("r", F.row_number().over(Window.orderBy(F.xxhash64("k", F.lit(seed + 1)), "k")))
    a, b = n.where("r % 2 = 1").select((F.col("r") + 1).alias("r"), "v"), n.where("r % 2 = 0").select("r", F.col("v").alias("w"))
    d = stats.distance(F.col("v"), F.col("w"))
    return float(a.join(b, "r").agg(F.median(d * d)).first()[0] or 1.0)


def within_class_whitening(df: DataFrame, vector: str, label: str, attention_weights: list[float] | None = None, shrink: float = 0.1) -> list[list[float]]:
    """The matrix that whitens the pooled within-class covariance, shrunk to its diagonal, columns weighted by attention: sums of
    products come from one pass, the small system is solved on the driver."""
    import numpy as np

    d = len(df.select(vector).first()[0])
    x = lambda i: F.col(vector)[i].cast("double")
    g = df.groupBy(label).agg(F.count("*").alias("n"), *(F.sum(x(i)).alias(f"s{i}") for i in range(d)), *(F.sum(x(i) * x(j)).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d))).collect()
    total, cov = 0, np.zeros((d, d))
    for r in g:
        s = np.array([r[f"s{i}"] for i in range(d)])
        q = np.array([[r[f"q{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        cov += q - np.outer(s, s) / r["n"]
        total += r["n"]
    cov /= max(total, 1)
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + 1e-9 * np.eye(d)
    values, axes = np.linalg.eigh(cov)
    return ((axes / np.sqrt(values)) @ axes.T * np.array(attention_weights or [1.0] * d)[:, None]).tolist()


def block_distance(pairs: DataFrame, rows: DataFrame, key: str, vector: str, matrix: list[list[float]], scale: float) -> DataFrame:
    """pairs (a, b) with d^2 / (d^2 + scale) of the vectors times the matrix, between 0 and 1."""
    m = [F.array(*map(F.lit, col)) for col in zip(*matrix)]
    seen = rows.select(F.col(key).alias("k"), F.array(*(stats.dot(F.col(vector), c) for c in m)).alias("z"))
    t = pairs.join(seen.select(F.col("k").alias("a"), F.col("z").alias("_x")), "a").join(seen.select(F.col("k").alias("b"), F.col("z").alias("_y")), "b")
    d = stats.distance(F.col("_x"), F.col("_y"))
    return t.select("a", "b", (d * d / (d * d + scale)).alias("block"))


def group_mix_distances(df: DataFrame, group: str, mix: str) -> DataFrame:
    """a, b, js: Jensen-Shannon distance of groups' mean mixes, divided by the largest. Groups are counted before they meet."""
    g = centroids(df.where(F.col(mix).isNotNull()), group, mix)
    soft = lambda c: F.transform(c, lambda v: (v + 1e-6) / (1 + F.size(c) * 1e-6))
    other = g.select(F.col("group").alias("b"), F.col("centroid").alias("q"))
    t = against(g.select(F.col("group").alias("a"), F.col("centroid").alias("p")), other).where("a < b").select("a", "b", stats.jensen_shannon(soft(F.col("p")), soft(F.col("q"))).alias("js"))
    return t.join(F.broadcast(t.agg(F.greatest(F.max("js"), F.lit(1e-12)).alias("m")))).select("a", "b", (F.col("js") / F.col("m")).alias("js"))


def ablations(weights: dict[str, float]) -> dict[str, dict[str, float]]:
    """Named weights of distance blocks: all, and each block off in turn."""
    return {"full": dict(weights)} | {f"no_{b}": {k: (0.0 if k == b else w) for k, w in weights.items()} for b in weights}


def ablation_distances(blocks: DataFrame, weights: dict[str, float]) -> DataFrame:
    """a, b, variant, distance: the combined distance under each ablation, in one pass."""
    variants = {n: w for n, w in ablations(weights).items() if any(x > 0 for x in w.values())}
    return blocks.select("a", "b", F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), combine(w).alias("distance")) for n, w in variants.items()))))


def driver_names(df: DataFrame, key: str, vector: str, names: list[str], attention_weights: list[float], top: int = 3) -> DataFrame:
    """key, drivers: the features whose |z| times attention is largest."""
    parts = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("f"), F.col(vector).alias("z"), F.array(*map(F.lit, map(float, attention_weights))).alias("w")), lambda x: F.struct((-F.round(F.abs(x["z"] * x["w"]), 9)).alias("s"), x["f"].alias("f")))
    return df.select(key, F.array_join(F.transform(F.slice(F.array_sort(parts), 1, top), lambda x: x["f"]), ", ").alias("drivers"))


def hard_negatives(df: DataFrame, key: str, peer: str, label: str, per_row: int = 3, seed: int = 0) -> DataFrame:
    """a, b: for each positive the next few negatives of its peer group in hashed order, around the end. A sampling operator."""
    neg = df.where(F.col(label) == 0).select(F.col(key).alias("b"), F.col(peer).alias("_g"))
    neg = neg.withColumn("_t", F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("b", F.lit(seed)), "b")))
    size = neg.groupBy("_g").agg(F.max("_t").alias("_n"))
    pos = df.where(F.col(label) == 1).select(F.col(key).alias("a"), F.col(peer).alias("_g")).join(size, "_g")
    steps = pos.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1)))).withColumn("_t", F.pmod(F.xxhash64("a", F.lit(seed)) + F.col("_s"), F.col("_n")) + 1)
    return steps.join(neg, ["_g", "_t"]).select("a", "b").distinct()
