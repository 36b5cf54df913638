"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the rows kept for testing: crc32 of the id as text leaves 1 when divided by 3. False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled rows that aren't held out, the first by hash of the id.

    Only these ids, a table of at most `most` rows, are broadcast. Rows without id or label take no part; of several
    labels of an id the largest counts.
    """
    own = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null")
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    some = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
