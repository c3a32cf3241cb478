"""Bounded samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import columns


def fold(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def labelled(documents: DataFrame, labels: DataFrame, label: str, most: int, held_out: int | None) -> DataFrame:
    """Columns of documents, with ``label`` and ``fold``, for at most ``most`` labelled rows chosen by a hash of the id.

    The ids are chosen from the labels alone, so that no text is shuffled: ``most`` ids at most are broadcast to the
    scan of the documents. Of ids labelled more than once the largest label counts; null ids and labels are left out,
    and so is the fold ``held_out``. Of rows that repeat an id the smallest by their other columns in order counts, found
    by a grouping that is combined before the shuffle, so that no id brings more rows than that.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__label"))
    ids = ids.withColumn("__fold", fold(F.col("doc_id")))
    if held_out is not None:
        ids = ids.where(F.col("__fold") != held_out)
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rest = [c for c in documents.columns if c != "doc_id"]
    found = documents.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__label", "__fold").agg(F.min(F.struct(*columns(rest))).alias("__row"))
    return found.select("doc_id", *[F.col("__row").getField(c).alias(c) for c in rest], "__label", "__fold")
