"""Bounded samples of labelled rows, to fit models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int, longest: int) -> DataFrame:
    """doc_id, text, label of at most `most` rows for each label, in the order of a hash of doc_id.

    keep: which doc_ids may be learned from.  longest: texts of more bytes aren't learned from.
    Of a doc_id that is labelled twice, the larger label counts.  `most` bounds the broadcast.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & keep)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    ids = own.where("label = 0").orderBy(order).limit(most).unionByName(own.where("label = 1").orderBy(order).limit(most))
    return docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(ids), "doc_id")
