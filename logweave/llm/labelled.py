"""A bounded sample of labelled documents for fitting classifiers. Everything else covers all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """(text, y) of at most ``limit`` labelled documents that ``allowed`` admits: those whose id hashes lowest.

    The ids that are broadcast number ``limit`` at most. A null label or id is no label.
    """
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "y")
