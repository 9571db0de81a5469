"""Exact deduplication by a log-structured merge index of digests.

Memtables are the partial aggregates of the map tasks. They flush into runs: sorted tables of (digest, identifier to keep,
count), each with a filter of its digests. Compaction merges runs two by two, level by level: each run's digests probe the
other's filter, and only what passes meets in a shuffle, where one identifier is kept for each digest; all else moves on as it
is. Digests with more than one row are hits. Rows whose digest passes the filter of the hits bring their texts, which are
compared byte by byte; digests that stand for several texts are told apart by the texts themselves. All other rows are
single and meet nothing. All work is done by DataFrame functions.

A filter is an array of words, read as a scalar subquery. It has ``PER_KEY`` bits for each digest and ``MOST`` at most; where
that would be too few there is none, everything passes, and the shuffle alone does the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.staging import discard, stage

RUNS = 4
PER_KEY, LEAST, MOST = 16, 1 << 12, 1 << 24


def _identified(docs: DataFrame, text: str, id: str, digest_bytes: int) -> DataFrame:
    full = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    full = full.withColumn("sha", F.unhex(F.sha2("text", 256)))
    return full.withColumn("digest", F.substring("sha", 1, digest_bytes) if digest_bytes < 32 else F.col("sha"))


def _chosen(keep: str):
    return F.max if keep == "largest" else F.min


def _flush(docs: DataFrame, runs: int, keep: str) -> DataFrame:
    """Level 0: the sorted runs."""
    run = F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int")
    tables = docs.select(run.alias("run"), "digest", "id").groupBy("run", "digest").agg(_chosen(keep)("id").alias("keep_id"), F.count("*").alias("size"))
    return tables.sortWithinPartitions("run", "digest")


def _place(digest: Column, bits: int) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(bits - 1))


def _filters(level: DataFrame, runs: int, most: int) -> tuple[DataFrame, int] | None:
    """``(run, words)`` and the number of bits, or None where the largest run has too many digests for ``most`` bits."""
    largest = level.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    bits = LEAST
    while bits < PER_KEY * largest and bits < most:
        bits *= 2
    if 3 * largest > bits:
        return None
    spark, at = level.sparkSession, _place(F.col("digest"), bits)
    held = level.select("run", at.alias("at")).select("run", F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63L as int))").alias("b"))
    every = spark.range(runs * (bits // 64)).select(F.expr(f"cast(id div {bits // 64} as int)").alias("run"), F.expr(f"id % {bits // 64}").alias("w"), F.lit(0).cast("long").alias("b"))
    words = held.unionByName(every).groupBy("run", "w").agg(F.bit_or("b").alias("b"))
    line = words.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
    return stage(line), bits


def _passes(filters: tuple[DataFrame, int] | None, run: int) -> Column:
    """Whether a row's digest may be among those of a run."""
    if filters is None:
        return F.lit(True)
    table, bits = filters
    at = _place(F.col("digest"), bits)
    word = F.element_at(table.where(F.col("run") == run).select("words").scalar(), (F.shiftright(at, 6) + 1).cast("int"))
    return F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _compact(level: DataFrame, runs: int, keep: str, most: int) -> DataFrame:
    """The next level: each two runs as one, with one entry for each digest. Only digests that pass the other run's filter are
    shuffled."""
    filters = _filters(level, runs, most)
    near = F.lit(False)
    for run in range(runs):
        near = F.when(F.col("run") == run, _passes(filters, run ^ 1)).otherwise(near)
    marked = level.withColumn("near", near).withColumn("run", F.shiftright("run", 1))
    met = marked.where("near").groupBy("run", "digest").agg(_chosen(keep)("keep_id").alias("keep_id"), F.sum("size").alias("size"))
    return stage(marked.where("not near").drop("near").unionByName(met).sortWithinPartitions("run", "digest"))


def deduplicate(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest", runs: int = RUNS, digest_bytes: int = 32, most: int = MOST) -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``.

    Texts are equal when identical without any change; null counts as empty, and texts of any length are compared whole. Of
    equal texts the row with the largest id stays (``keep="smallest"``: the smallest). A null id never wins over others.
    Rows repeated under one id are kept or dropped together, and each counts in ``group_size``. An empty table gives an empty
    result; columns other than ``id`` and ``text`` are not read, whatever their names. ``runs`` is a power of two;
    ``digest_bytes`` shortens the index's digests, and ``most`` limits its filters; results don't depend on these.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep must be 'largest' or 'smallest'")
    if runs < 1 or runs & (runs - 1):
        raise ValueError("runs must be a power of two")
    named, choose = _identified(docs, text, id, digest_bytes), _chosen(keep)
    level = stage(_flush(named, runs, keep))
    while runs > 1:
        below, level = level, _compact(level, runs, keep, most)
        discard(below)
        runs //= 2

    hits = stage(level.where("size > 1"))
    maybe = _passes(_filters(hits.select("digest", F.lit(0).alias("run")), 1, most), 0)
    texts = named.where(maybe).join(hits.select("digest"), "digest", "left_semi").groupBy("digest", "text").agg(choose("id").alias("keep_id"), F.count("*").alias("size"))
    mixed = stage(texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"))
    single = lambda rows: rows.select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"))
    near = named.where(maybe)
    if mixed.isEmpty():
        met = near.select("id", "sha", "digest").join(hits.select("digest", F.col("keep_id").alias("best"), F.col("size").alias("rows")), "digest", "left")
        met = met.select("id", "sha", F.when(F.col("rows").isNull(), F.col("id")).otherwise(F.col("best")).alias("keep_id"), F.coalesce("rows", F.lit(1)).alias("size"))
    else:
        # digests that several texts share: all texts of hits are told apart by themselves
        whole = near.join(hits.select("digest"), "digest", "left_semi")
        classes = whole.groupBy("digest", "text").agg(choose("id").alias("keep_id"), F.count("*").alias("size"))
        met = whole.join(classes, ["digest", "text"]).select("id", "sha", "keep_id", "size").unionByName(single(near.join(hits.select("digest"), "digest", "left_anti")))
    out = single(named.where(~maybe)).unionByName(met)
    return out.select(
        F.col("id").alias(id), "keep_id", F.col("size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
