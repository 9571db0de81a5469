"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPAN = 1_000_000


def fold(id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo the folds; null for a null identifier."""
    return F.pmod(F.crc32(F.encode(id.cast("string"), "UTF-8")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, rows: int, text_bytes: int, text: str = "text", id: str = "doc_id") -> pa.Table:
    """``(text, label)`` of at most ``rows`` rows of ``labels(id, label)`` and about ``text_bytes`` bytes of text in all.

    Rows are chosen by a hash of their identifiers, whatever their length, and keep their whole texts: where texts are long,
    fewer of all lengths are chosen. Of several labels of one identifier the greatest counts, of several texts the least, so
    that the sample doesn't depend on how the tables are partitioned. It is bounded before it is joined, so it may be
    broadcast, and is the only thing that reaches the driver.
    """
    known = labels.where(F.col("label").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    mean = docs.agg(F.avg(F.octet_length(F.col(text).cast("string")))).first()[0] or 1.0
    most = max(1, min(rows, int(text_bytes / max(mean, 1.0))))
    order = F.xxhash64("id", F.lit(7))
    chosen = known.orderBy(order, "id").limit(most)
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull())
    one = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return one.orderBy("id").select("text", "label").toArrow()
