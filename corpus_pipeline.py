"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, passages that
occurred before are cut, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and all but the last return the columns of
docs. Rows without doc_id cannot be compared: they pass the first three stages (a toxic text goes) and are
not packed. Null texts count as empty. Rows with equal doc_id are one document and stay or go together.
Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm import harmonic, jaccard, phrases, toxicity
from ledgerlight.llm.common import saved, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; learned from the labels of those that are not held out."""
    score = toxicity.probability(toxicity.trained(docs, table(spark, sf_dir, "labels")), spark)
    return docs.where(score("text") < 0.5)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that links on five-word shingles at 0.75 connect."""
    out = jaccard.similar(docs).where("doc_id <> component_id").select("doc_id")
    return docs.join(out.hint("merge"), "doc_id", "left_anti").select(docs.columns)


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words that a window of 20 words covers which started earlier; n_chars counts what stays."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = phrases.remove(docs, with_text=True, carried=tuple(rest))
    cut = cut.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(docs.columns).union(docs.where("doc_id IS NULL"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return harmonic.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_jaccard", near_duplicates_out),
    ("substring_dedup", passages_out),
    ("packing", packed),
]

#: A classifier and a tokenizer's ids cannot be had in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
