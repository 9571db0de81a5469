"""One retrieval document for each symbol, file and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X

#: The fields that a document's hash covers (fixed values).
HASHED = ("node_kind", "node_ref", "language", "symbol_type", "file_path", "name", "name_tokens", "signature", "summary_short", "summary_full")
#: Columns that are searched.
SEARCHED = ("name", "name_tokens", "signature", "file_path", "summary_short", "summary_full")


def _plain(text: Column) -> Column:
    return F.translate(text, "/_", "  ")


def documents(files: DataFrame, symbols: DataFrame, clusters: DataFrame, current: DataFrame) -> DataFrame:
    """``(node_kind, node_ref, language, symbol_type, file_path, name, name_tokens, signature, summary_short, summary_full,
    source_version, content_hash)`` over ``files(path, language)``, ``symbols(file, name, type, args)``,
    ``clusters(name, label)`` and the ``current(kind, ref, version, short, full)`` summaries.

    Symbols of unknown files have no document. The hash is that of the fields' JSON, so it only changes with them; the version
    of a summary is not among them."""
    none = F.lit(None).cast("string")
    of = symbols.select("file", "name", "type", "args").join(files.select(F.col("path").alias("file"), "language"), "file")
    one = of.select(F.lit("symbol").alias("node_kind"), F.concat("file", F.lit("::"), "name").alias("node_ref"), "language", F.col("type").alias("symbol_type"), F.col("file").alias("file_path"), "name", X.tokenize_symbol(F.col("name")).alias("name_tokens"), F.col("args").alias("signature"))
    two = files.select(F.lit("file").alias("node_kind"), F.col("path").alias("node_ref"), "language", none.alias("symbol_type"), F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("name"), _plain(F.col("path")).alias("name_tokens"), none.alias("signature"))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.col("name"))
    three = clusters.select(F.lit("cluster").alias("node_kind"), F.col("name").alias("node_ref"), none.alias("language"), none.alias("symbol_type"), none.alias("file_path"), label.alias("label"), _plain(F.col("name")).alias("name_tokens"), none.alias("signature")).withColumnRenamed("label", "name")
    facts = one.unionByName(two).unionByName(three)
    now = current.select(F.col("kind").alias("node_kind"), F.col("ref").alias("node_ref"), F.col("version").alias("source_version"), F.col("short").alias("summary_short"), F.col("full").alias("summary_full"))
    both = facts.join(now, ["node_kind", "node_ref"], "left")
    return both.withColumn("content_hash", X.content_hash(**{c: F.col(c) for c in HASHED}))


def changed(new: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents to write, as they are new or differ, and the keys of those to delete."""
    key = ["node_kind", "node_ref"]
    write = new.join(stored.select(*key, "content_hash"), [*key, "content_hash"], "left_anti").select(*new.columns)
    return write, stored.select(*key).join(new.select(*key), key, "left_anti")


def check(found: DataFrame, files: DataFrame, symbols: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(kind, expected, found, duplicates, sound)``: whether each node has one document, and no other has any."""
    want = symbols.select(F.lit("symbol").alias("kind")).unionByName(files.select(F.lit("file").alias("kind"))).unionByName(clusters.select(F.lit("cluster").alias("kind"))).groupBy("kind").agg(F.count("*").alias("expected"))
    have = found.groupBy(F.col("node_kind").alias("kind"), "node_ref").agg(F.count("*").alias("n")).groupBy("kind").agg(F.sum("n").alias("found"), F.count_if(F.col("n") > 1).alias("duplicates"))
    both = want.join(have, "kind", "full_outer").na.fill(0)
    return both.withColumn("sound", (F.col("expected") == F.col("found")) & (F.col("duplicates") == 0))
