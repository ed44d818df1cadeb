"""New rows on frozen segments: assignment, what fell where, and the shift against the original."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import segments, similarity
from ..sources import extracts


def map_new(new: DataFrame, key: str, vector: str, label: str, centres: DataFrame, bars: DataFrame, original: DataFrame | None = None, weight: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows with cluster and cosine, summary with the shift if the original summary is given). Never assigns at random: under the bar is -1."""
    extracts.require(new, [key, vector, label])
    rows = similarity.nearest(new, key, vector, centres, bars).join(new.select(key, label), key)
    summary = segments.map_summary(rows, "cluster", label, "cosine", weight)
    if original is not None:
        shift = segments.against_original(summary, original).select("cluster", "original_pct", "fraud_pct_shift")
        summary = summary.join(shift, "cluster", "left")
    return rows, summary
