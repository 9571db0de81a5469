"""Views that give the driver's tables the shapes the operators work on, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.operators import projection, search
from spindrift.plans.runtime import keeper, table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dealt by order, over so many tasks to each split of the table that what one of them sorts has a bound."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.repartition(8 * rows.rdd.getNumPartitions(), "l_orderkey")


def part_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cyclic graph: a part calls the next one of its order, as sure as the return flag says."""
    rows = _lines(spark, sf_dir)
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*(c.strip() for c in _ORDER.split(","))))
    sure = F.when(F.col("l_returnflag") == "A", "definite").when(F.col("l_returnflag") == "N", "probable").otherwise("inferred")
    calls = rows.select(F.col("l_partkey").alias("caller"), following.alias("callee"), sure.alias("provenance"), F.col("l_linenumber").alias("line"))
    return calls.where("callee is not null and caller <> callee")


PART_CALLS = f"""part_calls AS (
  SELECT caller, callee, provenance, line FROM (
    SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS callee,
           CASE l_returnflag WHEN 'A' THEN 'definite' WHEN 'N' THEN 'probable' ELSE 'inferred' END AS provenance, l_linenumber AS line
    FROM lineitem) WHERE callee IS NOT NULL AND caller <> callee)"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols of the files that their brands are."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("file"))


PART_FILES = "part_files AS (SELECT p_partkey AS node, p_brand AS file FROM part)"


def supply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layered graph, its edges as often as they occur: customers call parts, parts their suppliers."""
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    one = both.select(F.concat(F.lit("cust:"), "o_custkey").alias("caller"), F.concat(F.lit("part:"), "l_partkey").alias("callee"))
    two = both.select(F.concat(F.lit("part:"), "l_partkey").alias("caller"), F.concat(F.lit("supp:"), "l_suppkey").alias("callee"))
    return one.unionByName(two).withColumn("provenance", F.lit("definite"))


def supply_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge of it once."""
    return supply_rows(spark, sf_dir).distinct()


SUPPLY_CALLS = """supply_calls AS (
  SELECT DISTINCT 'cust:' || o_custkey AS caller, 'part:' || l_partkey AS callee FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION SELECT DISTINCT 'part:' || l_partkey, 'supp:' || l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def user_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as version histories of their users."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "purchase", "oversized_warn").when(F.col("event_type") == "error", "corrupt").otherwise("stale")
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.lit("user").alias("kind"), F.col("user_id").alias("ref"), version.alias("version"), status.alias("status"), F.col("props").alias("summary"), F.col("ts").alias("created_at"))


USER_VERSIONS = """user_versions AS (
  SELECT 'user' AS kind, user_id AS ref, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version,
         CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'ok' WHEN 'purchase' THEN 'oversized_warn' WHEN 'error' THEN 'corrupt' ELSE 'stale' END AS status,
         props AS summary, ts AS created_at FROM events)"""

CURRENT = """barriers AS (SELECT ref, coalesce(max(version) FILTER (status = 'stale'), 0) AS b FROM user_versions GROUP BY ref),
current_versions AS (
  SELECT kind, v.ref, max(version) FILTER (status IN ('ok', 'oversized_warn') AND version > b AND json_extract_string(summary, '$.k') IS NOT NULL) AS version,
         arg_max(status, version) AS latest_status
  FROM user_versions v JOIN barriers USING (ref) GROUP BY kind, v.ref)"""


def usable_props():
    return F.get_json_object("summary", "$.k").isNotNull()


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands within types of parts as files ``(path, language, type)``."""
    p = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    number = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    language = F.when(number % 3 == 0, "python").when(number % 3 == 1, "ts").otherwise("rust")
    return p.select(_path().alias("path"), language.alias("language"), F.col("p_type").alias("type"))


def _path():
    return F.concat(F.lower("p_type"), F.lit("/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit(".py"))


def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols ``(ref, file, name, short_name, type, args, line, language, key)`` of those files."""
    p = table(spark, sf_dir, "part")
    short = F.replace("p_name", F.lit(" "), F.lit("_"))
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "struct"))), F.col("p_size") % 3 + 1)
    rows = p.select(_path().alias("file"), F.concat(short, F.lit("_"), F.col("p_partkey").cast("string")).alias("name"), short.alias("short_name"), kind.alias("type"), F.concat(F.lit("("), "p_name", F.lit(", x)")).alias("args"), F.col("p_size").alias("line"), F.col("p_partkey").alias("key"))
    files = code_files(spark, sf_dir).select(F.col("path").alias("file"), "language")
    return rows.join(files, "file").withColumn("ref", F.concat("file", F.lit("::"), "name"))


def code_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_type").distinct()
    return p.select(F.lower("p_type").alias("name"), F.concat(F.lit("type "), "p_type").alias("label"))


def code_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries: a part's name, and the document of its number in full; a file's type."""
    p, d = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("full"))
    short = p.select(F.col("p_partkey").alias("key"), F.concat("p_name", F.lit(" of "), "p_brand").alias("short"))
    one = code_symbols(spark, sf_dir).select("ref", "key").join(short, "key").join(d, "key", "left").select(F.lit("symbol").alias("kind"), "ref", F.lit(1).alias("version"), "short", "full")
    two = code_files(spark, sf_dir).select(F.lit("file").alias("kind"), F.col("path").alias("ref"), F.lit(2).alias("version"), F.concat(F.lit("file of "), "type").alias("short"), F.lit(None).cast("string").alias("full"))
    return one.unionByName(two)


def code_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.documents(code_files(spark, sf_dir), code_symbols(spark, sf_dir), code_clusters(spark, sf_dir), code_current(spark, sf_dir))


def code_index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The stored index of those documents, made once in a session."""
    return search.build(code_documents(spark, sf_dir), projection.SEARCHED, keeper(spark, sf_dir))


CODE = r"""code_files AS (
  SELECT DISTINCT lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.py' AS path, p_type AS type,
         (['python', 'ts', 'rust'])[split_part(p_brand, '#', 2)::INT % 3 + 1] AS language FROM part),
code_symbols AS (
  SELECT *, file || '::' || name AS ref FROM (
    SELECT lower(p_type) || '/' || lower(replace(p_brand, '#', '_')) || '.py' AS file, replace(p_name, ' ', '_') || '_' || p_partkey AS name, replace(p_name, ' ', '_') AS short_name,
           (['function', 'class', 'struct'])[p_size % 3 + 1] AS type, '(' || p_name || ', x)' AS args, p_size AS line, p_partkey AS key FROM part) JOIN (SELECT path AS file, language FROM code_files) USING (file)),
code_docs AS (
  SELECT 'symbol' AS node_kind, ref AS node_ref, language, type AS symbol_type, file AS file_path, name, replace(name, '_', ' ') AS name_tokens, args AS signature,
         p_name || ' of ' || p_brand AS summary_short, text AS summary_full, 1 AS source_version
  FROM code_symbols JOIN part ON key = p_partkey LEFT JOIN documents ON doc_id = key
  UNION ALL SELECT 'file', path, language, NULL, path, split_part(path, '/', 2), translate(path, '/_', '  '), NULL, 'file of ' || type, NULL, 2 FROM code_files
  UNION ALL SELECT DISTINCT 'cluster', lower(p_type), NULL, NULL, NULL, 'type ' || p_type, lower(p_type), NULL, NULL, NULL, NULL FROM part)"""


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files in the folders of their region and nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    both = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.concat_ws("/", "r_name", "n_name", F.concat(F.lit("s"), "s_suppkey")).alias("file"), F.col("s_suppkey").alias("suppkey"))


FOLDERS = """folders AS (SELECT r_name || '/' || n_name || '/s' || s_suppkey AS file, s_suppkey AS suppkey
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def co_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between suppliers of the same part on neighbouring lines of an order, as files."""
    rows = _lines(spark, sf_dir)
    following = F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*(c.strip() for c in _ORDER.split(","))))
    pairs = rows.select(F.col("l_suppkey").alias("a"), following.alias("b"), F.col("l_partkey").alias("part")).where("b is not null")
    f = folders(spark, sf_dir)
    return pairs.join(f.select(F.col("suppkey").alias("a"), F.col("file").alias("source")), "a").join(f.select(F.col("suppkey").alias("b"), F.col("file").alias("target")), "b").select("source", "target", "part")


CO_SUPPLY = f"""co_supply AS (
  SELECT fa.file AS source, fb.file AS target, part FROM (
    SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS b, l_partkey AS part FROM lineitem)
  JOIN folders fa ON a = fa.suppkey JOIN folders fb ON b = fb.suppkey WHERE b IS NOT NULL)"""
