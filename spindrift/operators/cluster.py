"""Grouping files by folders, with density gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_SIZE, DENSITY, ENTRIES, MIN_SYMBOLS, COHESION = 15, 0.5, 3, 5, 0.25


def by_folder(files: DataFrame, max_size: int = MAX_SIZE) -> DataFrame:
    """``(file, cluster)`` by first path segment; groups over the size are split by the first two, where a path has more than
    two; clusters of one file are dropped. Sizes are counted and joined back, so no folder has to fit a task."""
    parts = F.split("file", "/")
    top = F.when(F.size(parts) > 1, parts[0]).otherwise("_root")
    every = files.select("file").distinct().withColumn("top", top)
    sized = every.join(every.groupBy("top").agg(F.count("*").alias("n")), "top")
    named = sized.select("file", F.when((F.col("n") > max_size) & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(F.col("top")).alias("cluster"))
    kept = named.groupBy("cluster").agg(F.count("*").alias("size")).where("size >= 2").select("cluster")
    return named.join(kept, "cluster", "left_semi").select("file", "cluster")


def detect(files: DataFrame, edges: DataFrame, calls: DataFrame, max_size: int = MAX_SIZE, least: float = DENSITY, most: int = ENTRIES) -> DataFrame:
    """``(cluster, files, density, entries)``: folders that pass the density gate, with their entry symbols."""
    members = by_folder(files, max_size)
    passed = dense(members, edges, least).select("cluster", "files", "density")
    return passed.join(entries(members, calls, most), "cluster")


def dense(members: DataFrame, edges: DataFrame, least: float = DENSITY) -> DataFrame:
    """``(cluster, files, internal, density)`` of clusters with enough edges ``(source, target)`` inside for each file."""
    one = members.select(F.col("file").alias("source"), F.col("cluster").alias("c1"))
    two = members.select(F.col("file").alias("target"), F.col("cluster").alias("c2"))
    inside = edges.join(one, "source").join(two, "target").where("c1 = c2").groupBy(F.col("c1").alias("cluster")).agg(F.count("*").alias("internal"))
    sized = members.groupBy("cluster").agg(F.count("*").alias("files")).join(inside, "cluster", "left").select("cluster", "files", F.coalesce("internal", F.lit(0)).alias("internal"))
    return sized.withColumn("density", F.col("internal") / F.col("files")).where(F.col("density") >= least)


def entries(members: DataFrame, calls: DataFrame, most: int = ENTRIES) -> DataFrame:
    """``(cluster, entries)``: the symbols of each cluster that most calls ``(callee, callee_file)`` reach, from anywhere;
    ``first_file::*`` where none does."""
    counts = calls.join(members.withColumnRenamed("file", "callee_file"), "callee_file").groupBy("cluster", "callee").agg(F.count("*").alias("n"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "callee"))).where(F.col("r") <= most)
    listed = top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "callee"))), lambda x: x["callee"]), ",").alias("entries"))
    return members.groupBy("cluster").agg(F.min("file").alias("first")).join(listed, "cluster", "left").select("cluster", F.coalesce("entries", F.concat("first", F.lit("::*"))).alias("entries"))


def file_kind(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``(file, symbols, intra, kind)``: few symbols are trivial, few edges inside for each symbol are low cohesion."""
    s = symbols.groupBy("file").agg(F.count("*").alias("symbols"))
    e = edges.where("source = target").groupBy(F.col("source").alias("file")).agg(F.count("*").alias("intra"))
    both = s.join(e, "file", "left").select("file", "symbols", F.coalesce("intra", F.lit(0)).alias("intra"))
    return both.withColumn("kind", F.when(F.col("symbols") < MIN_SYMBOLS, "trivial").when(F.col("intra") / F.col("symbols") < COHESION, "low_cohesion").otherwise("cohesive"))
