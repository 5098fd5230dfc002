"""Labelled rows for fitting a classifier: a bounded sample, the same at every size of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def training_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> list[tuple[str, int]]:
    """At most ``most`` (text, label) rows of each class among the labelled rows that ``learn`` allows, in the order of a
    hash of the id. Null labels and texts are left out; of repeated labels of an id, the largest counts."""
    known = labels.filter(F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [r for value in (0, 1) for r in known.filter(F.col("label") == value).orderBy(*order).limit(most).collect()]
    if not chosen:
        return []
    # Bounded by ``most`` ids of each class, so the chosen ids may be broadcast.
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in chosen], "doc_id long, label int")
    rows = docs.select("doc_id", "text").dropna().join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return [(r.text, r.label) for r in rows.orderBy("doc_id").collect()]
