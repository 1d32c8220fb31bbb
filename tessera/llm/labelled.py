"""A bounded sample of labelled texts for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_part(of: int = 5):
    """Rows that labels may be learned from: crc32 of doc_id as text, mod ``of``, is not 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, columns: list[str], rows: int = 8_000, most_bytes: int = 60_000, of: int = 5) -> DataFrame:
    """At most ``rows`` labelled documents, those with the smallest hashes of doc_id, with ``y`` 0 or 1.

    Only training learns from the sample, so its bound holds at any input size; texts longer than ``most_bytes`` are
    scored but not learned from. A document with several labels counts as 1 if any is; null labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(training_part(of))
    some = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "__id")
    picked = docs.join(F.broadcast(some), F.col("doc_id") == F.col("__id"))  # at most ``rows`` small rows
    return picked.where(F.octet_length("text") <= most_bytes).select(*columns, "y", F.xxhash64("__id").alias("h"))
