"""Sources of files and sinks of facts: what changed, upserts, replacement of a file's facts, and cascading deletes."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import excluded, file_hash


def discover(spark: SparkSession, root: str, extensions: dict[str, str], exclude: list[str] | None = None) -> DataFrame:
    """``(path, language, source, struct_hash)`` of all files below ``root`` whose longest known extension names a language,
    less what is excluded. Paths are relative. Files are listed by name first, and only those that stay are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(extensions)).load(root).select("path")
    return _read(spark, listed, root, extensions, exclude)


def targeted(spark: SparkSession, root: str, paths: list[str], stored: DataFrame, extensions: dict[str, str], exclude: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The named files as ``discover`` gives them, and ``(path)`` of those that are stored but gone or excluded now."""
    wanted = spark.createDataFrame([(p,) for p in dict.fromkeys(p.replace("\\", "/") for p in paths)], "path string")
    base = root.rstrip("/")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [f"{base}/{p}" for p in paths if system.exists(hadoop(f"{base}/{p}"))]
    empty = spark.createDataFrame([], "path string, language string, source string, struct_hash string")
    found = _read(spark, spark.createDataFrame([(p,) for p in there], "path string"), root, extensions, exclude) if there else empty
    gone = wanted.join(stored.select("path").distinct(), "path", "left_semi").join(found.select("path"), "path", "left_anti")
    return found, gone


def _glob(extensions: dict[str, str]) -> str:
    return "*{" + ",".join(sorted(e for x in extensions for e in {x.lower(), x, x.upper()})) + "}"


def _read(spark: SparkSession, listed: DataFrame, root: str, extensions: dict[str, str], exclude: list[str] | None) -> DataFrame:
    for ext in extensions:
        if sum(e.lower() == ext.lower() for e in extensions) > 1:
            raise ValueError(f"extension {ext} is registered twice")
    base = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.rstrip("/").removeprefix("file:")) + "/", "")
    language = None
    for ext in sorted(extensions, key=lambda e: (-len(e), e)):
        language = (F if language is None else language).when(F.endswith(F.lower(base), F.lit(ext.lower())), extensions[ext])
    named = listed.select("path", base.alias("relative"), language.alias("language")).where("language is not null")
    named = named.where(~excluded(F.col("relative"), exclude)) if exclude else named
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _glob(extensions)).load(root).select(F.col("path").alias("p"), "content")
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    out = named.join(files, plain(F.col("path")) == plain(F.col("p"))).select(F.col("relative").alias("path"), "language", F.col("content").cast("string").alias("source"))
    return out.withColumn("struct_hash", file_hash(F.col("source")))


def invalid(stored: DataFrame, candidates: DataFrame, identity: list[str]) -> DataFrame:
    """Stored rows whose identity is none of the current ones; nulls are values."""
    c = candidates.select(*(F.col(x).alias(f"c_{x}") for x in identity)).distinct()
    same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(f"c_{x}")) for x in identity))
    return stored.join(c, same, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose parent is missing."""
    return children.join(parents.select(*key).distinct(), key, "left_anti")


def timeline(rows: DataFrame, date: str, order: str, mode: str = "all", value: str = "", today: str | None = None) -> DataFrame:
    """Rows of a timeline: ``all``, the first ``last_n`` by ``order``, those ``since_date``, or those ``within_days`` of
    ``today``. A date that can't be read passes; a mode or value that can't be read is ``all``."""
    when = F.try_to_timestamp(F.col(date), F.lit("yyyy-MM-dd")).cast("date")
    number = int(value) if value.strip().lstrip("+-").isdigit() else None
    if mode == "last_n" and number is not None and number > 0:
        return rows.orderBy(order).limit(number)
    if mode == "since_date" and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip()):
        return rows.where(when.isNull() | (when >= F.lit(value.strip()).cast("date")))
    if mode == "within_days" and number is not None and number >= 0:
        now = F.lit(today).cast("date") if today else F.current_date()
        return rows.where(when.isNull() | (when >= F.date_sub(now, number)))
    return rows


def changed(found: DataFrame, stored: DataFrame, key: list[str], identity: list[str]) -> DataFrame:
    """Rows that are new or whose identity - hash and parser, say - differs from what is stored; nulls are values."""
    s = stored.select(*(F.col(c).alias(f"s_{c}") for c in [*key, *identity]))
    same = None
    for c in [*key, *identity]:
        one = F.col(c).eqNullSafe(F.col(f"s_{c}"))
        same = one if same is None else same & one
    return found.join(s, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """Old and new rows, one for each key: the new one to replace, the old one to ignore."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    order = F.desc("__new") if replace else F.asc("__new")
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__new", "__r")


def replace_facts(stored: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """All facts of the files in ``new`` replaced by those."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str = "file") -> dict[str, DataFrame]:
    """Each table, with the column that names its file, without the files of ``gone``."""
    return {name: df.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (df, column) in tables.items()}


def markdown_table(spark: SparkSession, path: str) -> DataFrame:
    """``(line, cells)``: rows of a Markdown table after its separator line."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    separator = rows.where(F.col("value").rlike(r"^\s*\|?[\s:|-]*-{3,}[\s:|-]*$")).agg(F.min("line").alias("at"))
    data = rows.join(F.broadcast(separator), F.col("line") > F.col("at")).where(F.startswith(F.trim("value"), F.lit("|")))
    return data.select("line", F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)).alias("cells"))


def json_spec(spark: SparkSession, path: str, schema: str, key: str | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A JSON specification with an explicit schema; input that doesn't fit fails, as do rows without what is ``required`` and
    keys that repeat."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    for name in required:
        rows = rows.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is missing"))).otherwise(F.col(name)))
    if key is not None and not (twice := rows.groupBy(key).count().where("count > 1")).isEmpty():
        raise ValueError(f"{key} repeats: {twice.first()[0]}")
    return rows


def write_json(df: DataFrame, path: str, promote: bool = False) -> str:
    """Write a result as JSON lines beside ``path``, and put it there only on demand: readers see the old result or the new
    one, never a part. The folder that was written is returned."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.mode("errorifexists").json(fresh)
    if not promote:
        return fresh
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, new, old = hadoop(path), hadoop(fresh), hadoop(f"{fresh}.old")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target):
        system.rename(target, old)
    system.rename(new, target)
    system.delete(old, True)
    return path


def sampled_freshness(stored: DataFrame, found: DataFrame, turn: int = 0, most: int = 10, commit: tuple[str, str] | None = None, dirty: tuple[int, int] | None = None) -> DataFrame:
    """``(sampled, mismatched, verdict)`` over ``(path, struct_hash)``: a tenth of the files, ten at most, starting at another
    place each turn; over half is stale, over a fifth is doubtful. ``commit`` holds the stored and the present commit, which make
    the index stale if they differ; ``dirty`` how many files of how many are changed, doubtful over a fifth.

    The sample is taken from the first files in order after the turn's place, so only those are sorted."""
    total = stored.count()
    size = min(most, -(-total // 10))
    skip = turn * size % max(1, total)
    head = stored.orderBy("path").limit(skip + size)
    ranked = head.withColumn("k", F.row_number().over(Window.orderBy("path")) - 1)
    picked = ranked.where(F.col("k") >= skip)
    if skip + size > total:
        picked = picked.unionByName(ranked.where(F.col("k") < skip + size - total))
    both = picked.join(found.select("path", F.col("struct_hash").alias("now")), "path", "left")
    n = both.agg(F.count("*").alias("sampled"), F.count_if(~F.col("now").eqNullSafe(F.col("struct_hash"))).alias("mismatched"))
    share = F.try_divide("mismatched", "sampled")
    moved = commit is not None and commit[0] != commit[1]
    many = dirty is not None and dirty[1] > 0 and dirty[0] / dirty[1] > 0.2
    return n.withColumn("verdict", F.when(F.lit(moved) | (share > 0.5), "stale").when(F.lit(many) | (share > 0.2), "doubtful").otherwise("fresh"))
