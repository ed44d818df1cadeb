"""Scoring of accounts by similarity of small signals: peer-normal features, distance blocks, adaptive kernel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accounts, curves, similarity


def peer_normal(df: DataFrame, key: str, features: list[str], levels: list[list[str]], is_ref: str, least: int = 150) -> DataFrame:
    """key, vector: each feature as the normal score of its rank among the peers of reference."""
    parts = [accounts.peer_ranks(df, key, c, levels, is_ref, least).withColumnRenamed("u", c) for c in features]
    wide = reduce(lambda a, b: a.join(b, key), parts)
    return wide.select(key, F.array(*(accounts.normal_score(c) for c in features)).alias("vector"))


def score(features: DataFrame, key: str, names: list[str], levels: list[list[str]], label: str, kind: str, is_ref: str) -> DataFrame:
    """Scores of the rows that are not references, with the most similar known fraud."""
    v = peer_normal(features, key, names, levels, is_ref).join(features.select(key, label, kind, is_ref), key)
    return similarity.kernel_scores(v.where(F.col(is_ref) == 0), v.where(F.col(is_ref) == 1), key, "vector", label, kind)


def report(scores: DataFrame, truth: DataFrame, key: str, label: str) -> DataFrame:
    """AUC, average precision and precision among as many as there are positives."""
    t = scores.join(truth.select(key, label), key)
    a = curves.auc(t, ["score"], label).select("auc")
    return a.join(curves.average_precision(t, "score", label)).join(curves.precision_at_positives(t, "score", label, key))
