"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line is boilerplate on a host when the pages that contain it, divided by all pages of the host,
exceed a ratio; such lines are dropped from the host's pages. All work is done by DataFrame functions. Lines travel as
128-bit digests. What is boilerplate on a host is bounded: at most (mean distinct lines of a page) / ratio lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.staging import stage

RATIO = 0.05
MIN_PAGES = 5
#: Up to so many (host, line) entries are broadcast; more are joined by shuffling on host and salt.
BROADCAST_LINES = 200_000
SALTS = 64


def _key(line: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.trim(line), "UTF-8")))


def boilerplate(docs: DataFrame, text: str, host: str, ratio: float, min_pages: int) -> DataFrame:
    """``(host, line)``: digests of the lines that exceed the ratio on a host."""
    lines = F.split(F.col(text).cast("string"), "\n")
    keys = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), _key)
    pages = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(keys)).alias("line"))
    counts = pages.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = docs.groupBy(F.col(host).alias("on")).agg(F.count("*").alias("total"))
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("on"))).where(F.col("pages") > F.lit(ratio) * F.col("total"))
    return over.select("host", "line")


def _slots(found: DataFrame) -> DataFrame:
    """``(__host, __slots)``: the digests of a host, dealt by their hash into as many short lists as there are digests, so that
    one is found without going through the others."""
    sizes = found.groupBy(F.col("host").alias("__host")).agg(F.count("*").cast("int").alias("n"))
    dealt = found.join(sizes, F.col("host").eqNullSafe(F.col("__host"))).select("__host", F.pmod(F.xxhash64("line"), F.col("n")).cast("int").alias("slot"), "line")
    every = sizes.select("__host", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"), F.lit(None).cast("binary").alias("line"))
    short = dealt.unionByName(every).groupBy("__host", "slot").agg(F.collect_list("line").alias("lines"))
    return short.groupBy("__host").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "lines"))), lambda x: x["lines"]).alias("__slots"))


def drop_boilerplate(docs: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with its boilerplate lines dropped from ``text``, and the columns ``n_lines`` and ``n_dropped``.

    Lines are what ``\\n`` separates; two are the same if equal after trimming spaces. A line goes if more than ``ratio``
    of its host's pages, and ``min_pages`` at least, contain it; how often one page repeats it doesn't matter. Blank lines
    stay. Null texts stay null, with 0 lines, and count as pages; a null host is a host of its own; repeated rows count as
    pages each; a text that loses all lines becomes empty; a share of just ``ratio`` doesn't exceed it; texts and lines of any
    length are taken whole; an empty table gives an empty result. Other columns pass through;
    ``n_lines`` and ``n_dropped`` replace columns of those names.
    """
    found = stage(boilerplate(docs, text, host, ratio, min_pages))
    per_host = _slots(found)
    if found.count() <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(per_host), F.col(host).eqNullSafe(F.col("__host")), "left")
    else:
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        spread = per_host.withColumn("__at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, F.col(host).eqNullSafe(F.col("__host")) & (F.col("__salt") == F.col("__at")), "left").drop("__salt", "__at")
    lines = F.split(F.col(text).cast("string"), "\n")

    keyed = F.transform(lines, lambda x: F.struct(x.alias("line"), _key(x).alias("key")))
    held = lambda key: F.array_contains(F.element_at("__slots", F.pmod(F.xxhash64(key), F.size("__slots")).cast("int") + 1), key)
    kept = F.transform(F.filter(keyed, lambda x: (F.trim(x["line"]) == "") | ~held(x["key"])), lambda x: x["line"])
    joined = joined.withColumn("__kept", F.when(F.col("__slots").isNotNull(), kept))
    n = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    n = F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(n)
    out = joined.withColumn("n_lines", n)
    out = out.withColumn("n_dropped", F.when(F.col("__kept").isNotNull() & F.col(text).isNotNull(), F.col("n_lines") - F.size("__kept")).otherwise(F.lit(0).cast("long")).cast("long"))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(F.col(text)))
    return out.drop("__host", "__slots", "__kept")
