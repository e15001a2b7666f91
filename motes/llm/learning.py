"""What both classifiers share: which rows may be learnt from, and joins with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows up to which they are broadcast to the documents; beyond, both are shuffled by id.
BROADCAST_LABELS = 2_000_000


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text modulo ``parts``; a null id has -1, so it is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def usable_labels(labels: DataFrame, target: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, y): labels that may be learnt from. Null ids and labels go; of an id's several labels the largest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropna()
    known = known.where(F.col("y").isin(0, 1)).where(remainder(F.col("doc_id"), parts) != held_out)
    return known.groupBy("doc_id").agg(F.max("y").alias("y"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of the documents that ``labels`` (doc_id, y) covers."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    small = labels.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return own.join(F.broadcast(labels) if small else labels, "doc_id").select("doc_id", "text", "y")
