"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 12_000


def training_ids(labels: DataFrame, label: str, skip: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and y of at most ``rows`` labelled documents that ``skip`` does not exclude.

    Rows without id or label are left out; several labels of one document count as their largest.  The
    rows with the smallest hashed ids are taken, so the choice depends on nothing but the ids.
    """
    one = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~skip)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_rows(documents: DataFrame, ids: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, y, text of the sampled documents.  ``ids`` has a bounded number of rows, so it is broadcast."""
    return documents.select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
