"""The read tools, audits and answer parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import answers as A
from spindrift.operators import cluster as C
from spindrift.operators import evaluate as E
from spindrift.operators import versions as V
from spindrift.plans import bindings as B
from spindrift.plans.catalog import register
from spindrift.plans.fact_queries import _CLUSTERS
from spindrift.plans.runtime import table

_NOW = f"{B.USER_VERSIONS}, {B.CURRENT}"


def _symbols(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("short_name"), F.col("p_type").alias("file"), F.col("p_size").alias("line"))


def _now(spark, sf):
    return V.current(B.user_versions(spark, sf), B.usable_props())


@register("q1_symbol", f"WITH {_NOW}, s AS (SELECT p_partkey AS ref, p_name AS name, p_type AS file FROM part WHERE (p_name = 'blue bolt' OR p_brand = 'blue bolt') AND p_type = 'SMALL' ORDER BY file, name, ref LIMIT 50) SELECT s.ref, name, version FROM s LEFT JOIN current_versions c ON s.ref = c.ref")
def q1(spark, sf):
    return A.symbol(_symbols(spark, sf), _now(spark, sf), "blue bolt", "SMALL").select("ref", "name", "version")


@register("q2_symbol_summary", f"WITH {_NOW}, s AS (SELECT p_partkey AS ref FROM part WHERE p_name = 'red widget' OR p_brand = 'red widget' ORDER BY p_type, p_name, ref LIMIT 50) SELECT s.ref, c.version, v.summary FROM s LEFT JOIN current_versions c ON s.ref = c.ref LEFT JOIN user_versions v ON v.ref = c.ref AND v.version = c.version")
def q2(spark, sf):
    return A.symbol(_symbols(spark, sf), _now(spark, sf), "red widget").select("ref", "version", "summary")


@register("q3_file_summary", f"WITH {_NOW}, s AS (SELECT p_partkey AS ref, p_size AS line FROM part WHERE p_type = 'ECONOMY' ORDER BY p_size, p_name, ref LIMIT 50) SELECT s.ref, line, version FROM s LEFT JOIN current_versions c ON s.ref = c.ref")
def q3(spark, sf):
    return A.file_summary(_symbols(spark, sf), _now(spark, sf), "ECONOMY").select("ref", "line", "version")


@register("q7_patterns", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' AND user_id = 8")
def q7(spark, sf):
    return A.patterns(table(spark, sf, "events"), event_type="signup", user_id=8, value=None).select("event_id", "user_id")


@register("q10_cluster_summary", f"WITH {_CLUSTERS} SELECT cluster, count(*) AS files, 'region ' || string_split(cluster, '/')[1] AS label FROM members GROUP BY cluster")
def q10(spark, sf):
    m = C.by_folder(B.folders(spark, sf))
    labels = m.select("cluster").distinct().select("cluster", F.concat(F.lit("region "), F.split("cluster", "/")[0]).alias("label"))
    return A.clusters(m, labels)


@register("q11_cluster_files", f"WITH {_CLUSTERS}, f AS (SELECT min(cluster) AS c FROM members) SELECT m.file, suppkey FROM members m JOIN folders USING (file) WHERE cluster = (SELECT c FROM f)")
def q11(spark, sf):
    f = B.folders(spark, sf)
    m = C.by_folder(f)
    first = m.agg(F.min("cluster").alias("cluster"))
    return m.join(F.broadcast(first), "cluster", "left_semi").join(f, "file").select("file", "suppkey")


@register("q16_audit", f"WITH {B.USER_VERSIONS} SELECT version, status FROM user_versions WHERE ref = 46")
def q16(spark, sf):
    return A.history(B.user_versions(spark, sf), 46).select("version", "status")


@register("r9_navigate_order", "SELECT kind, ref FROM (SELECT 'cluster' AS kind, 2 AS o, n_name AS ref, n_nationkey AS rank FROM nation UNION ALL SELECT 'file', 1, s_name, s_suppkey FROM supplier UNION ALL SELECT 'symbol', 0, p_name || p_partkey, p_partkey FROM part) ORDER BY o, rank, ref LIMIT (SELECT count(*) + 50 FROM part)")
def r9(spark, sf):
    n, s, p = (table(spark, sf, t) for t in ("nation", "supplier", "part"))
    rows = n.select(F.lit("cluster").alias("kind"), F.col("n_name").alias("ref"), F.col("n_nationkey").cast("long").alias("rank"))
    rows = rows.unionByName(s.select(F.lit("file").alias("kind"), F.col("s_name").alias("ref"), F.col("s_suppkey").alias("rank")))
    rows = rows.unionByName(p.select(F.lit("symbol").alias("kind"), F.concat("p_name", "p_partkey").alias("ref"), F.col("p_partkey").alias("rank")))
    return A.navigate(rows, p.count() + 50).select("kind", "ref")


@register("x7_strip_docstrings", "SELECT item_id, 'def f(x):' || chr(10) || '    ' || chr(10) || '    return x  ' AS code FROM benchmark")
def x7(spark, sf):
    """Docstrings made of benchmark texts, with a comment behind the code."""
    quote = "'''"
    source = F.concat(F.lit(f"def f(x):\n    {quote}"), F.translate("text", "'\\", ""), F.lit(f"{quote}\n    return x  # note"))
    return table(spark, sf, "benchmark").select("item_id", A.strip_docstrings(source).alias("code"))


@register("x9_cache_key", r"""SELECT item_id, 'navigate:' || sha256('{"candidates":[["file","f' || item_id || '","h"],["symbol",' || to_json(substr(text, 1, 9))::VARCHAR || ',""]],"intent":' || to_json(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))::VARCHAR || ',"template":"1","top_k":5}') AS key FROM benchmark""")
def x9(spark, sf):
    candidate = lambda kind, ref, hash_: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), F.lit(hash_).cast("string").alias("hash"))
    given = F.array(candidate("file", F.concat(F.lit("f"), F.col("item_id").cast("string")), "h"), candidate("symbol", F.substring("text", 1, 9), None))
    return table(spark, sf, "benchmark").select("item_id", A.cache_key(F.col("text"), 5, given).alias("key"))


@register("x19_normal_path", r"SELECT page_id, regexp_replace(lower('Src/' || split_part(url, '://', 2) || ':12'), '^src/', '') AS path, split_part(split_part(url, '://', 2), '.', -1) AS name FROM pages")
def x19(spark, sf):
    """Paths in capitals behind dots and slashes, with a line number, which stays; names behind what qualifies them."""
    bare = F.split_part("url", F.lit("://"), F.lit(2))
    return table(spark, sf, "pages").select("page_id", A.normal_path(F.concat(F.lit(" ././/Src\\"), bare, F.lit(":12 ")), "src/").alias("path"), A.normal_name(F.concat(F.lit("`*"), bare, F.lit("(x, y)` "))).alias("name"))


@register("x20_answer_items", "SELECT p_partkey, replace(p_name, ' ', '_') AS name, 'src/' || lower(p_type) || '.py:12' AS path, 'block' AS kind FROM part UNION ALL SELECT p_partkey, p_name, '', 'block' FROM part UNION ALL SELECT p_partkey, replace(p_name, ' ', '_'), 'a/b.py,', 'prose' FROM part UNION ALL SELECT p_partkey, 'run', 'c.py', 'prose' FROM part")
def x20(spark, sf):
    """Items of a fenced block - a path, a name alone, one twice - and of prose."""
    word = F.replace("p_name", F.lit(" "), F.lit("_"))
    line = F.concat(F.lit("`ns::A."), word, F.lit("|./src/"), "p_type", F.lit(".py:12`"))
    block = F.concat(F.lit("see x|y\n```answer\n"), line, F.lit("\n\nanswer x\n"), "p_name", F.lit("\n"), line, F.lit("\n```\n"))
    prose = F.concat(F.lit("it is in "), word, F.lit(" | A/b.py, I think\nthen `run` and `x y` of ./c.py\nboth a.py and b.py have `z`\n"))
    rows = table(spark, sf, "part").select("p_partkey", F.explode(F.array(F.struct(F.lit("block").alias("kind"), block.alias("text")), F.struct(F.lit("prose").alias("kind"), prose.alias("text")))).alias("x"))
    return rows.select("p_partkey", "x.kind", F.explode(A.answer_items(F.col("x.text"))).alias("item")).select("p_partkey", "item.name", "item.path", "kind")


@register("x21_clamped_scores", "SELECT event_id, greatest(0, least(1, value / 50)) AS score FROM events WHERE event_id % 3 > 0")
def x21(spark, sf):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit("oops")).otherwise(F.concat(F.lit('[{"ref":"a","score":'), (F.col("value") / 50).cast("string"), F.lit("}]")))
    return table(spark, sf, "events").select("event_id", F.explode(A.clamped_scores(raw)).alias("x")).select("event_id", "x.score")


_DIMENSIONS = ("signature", "error_contract", "side_effects", "concurrency", "resource_lifecycle", "complexity_tier", "security", "data_contract", "internal_refactor", "rename", "extract_inline", "comment_only", "test_only", "log_only", "ambiguous")


@register(
    "x24_verdicts",
    f"""WITH d AS (SELECT *, ([{", ".join(repr(d) for d in (*_DIMENSIONS, "other"))}])[event_id % 16 + 1] AS dim FROM events), g AS (SELECT *, event_type IN ('click', 'view') AND dim <> 'other' AND event_id % 7 > 1 AS good FROM d)
SELECT event_id, CASE WHEN good THEN event_id % 2 = 0 ELSE true END AS propagate, CASE WHEN good THEN dim ELSE 'ambiguous' END AS matched_dimension, CASE WHEN good THEN 'medium' ELSE 'low' END AS confidence, good AS given FROM g""",
)
def x24(spark, sf):
    """Verdicts of all dimensions, an unknown one, other levels of confidence, a rationale that is a number, and broken JSON."""
    dimension = F.element_at(F.array(*map(F.lit, (*_DIMENSIONS, "other"))), (F.col("event_id") % 16 + 1).cast("int"))
    confidence = F.when(F.col("event_type").isin("click", "view"), "medium").otherwise("sure")
    rationale = F.when(F.col("event_id") % 7 == 1, F.lit("5")).otherwise(F.lit('"r"'))
    raw = F.concat(F.lit('{"propagate":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"matched_dimension":"'), dimension, F.lit('","confidence":"'), confidence, F.lit('","rationale":'), rationale, F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("}")))
    v = table(spark, sf, "events").select("event_id", A.verdict(raw).alias("v"))
    return v.select("event_id", "v.propagate", "v.matched_dimension", "v.confidence", (F.col("v.rationale") == "r").alias("given"))


@register("x23_indicators", "SELECT split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS project, string_agg(DISTINCT l, ',' ORDER BY l) AS layers FROM (SELECT url, unnest([CASE WHEN regexp_matches(url, '/en/') THEN 'english' END, CASE WHEN regexp_matches(url, 'html$') THEN 'static' END]) AS l FROM pages) WHERE l IS NOT NULL GROUP BY 1")
def x23(spark, sf):
    p = table(spark, sf, "pages").select(F.split_part(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit(1)).alias("project"), F.col("url").alias("path"))
    return A.indicators(p, {"english": "/en/", "static": "html$"})


#: Views over natural keys, and what their columns are worth in a comparison: all but those of ``ALLOWED`` must be equal.
VIEWS = {
    "files": (["path"], "path", ["type"], ["language"]),
    "symbols": (["file", "name"], "ref", ["short_name", "type", "args", "line"], []),
    "clusters": (["name"], "name", ["label"], []),
    "retrieval_documents": (["node_kind", "node_ref"], "node_ref", ["language", "symbol_type", "file_path", "name", "name_tokens", "signature"], ["summary_short", "summary_full", "content_hash"]),
}


@register("e1_view_projection", "SELECT caller, callee, provenance, count(*) AS n FROM (SELECT l_partkey AS caller, l_suppkey AS callee, l_returnflag AS provenance FROM lineitem) GROUP BY ALL")
def e1(spark, sf):
    """A view by natural keys only, with how often each row occurs."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.col("l_returnflag").alias("provenance")).groupBy("caller", "callee", "provenance").agg(F.count("*").alias("n"))


@register(
    "e2_classified_diff",
    f"""WITH {B.PART_CALLS}, a AS (SELECT caller, callee, provenance FROM part_calls), b AS (SELECT caller, callee, provenance FROM part_calls WHERE line <> 3)
SELECT CASE WHEN provenance = 'inferred' THEN 'inferred_edge' WHEN side = 'left' THEN 'missing_row' ELSE 'extra_row' END AS category, side, true AS blocking, count(*) AS n FROM (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""",
)
def e2(spark, sf):
    calls = B.part_calls(spark, sf)
    found = E.classified_surplus(calls.select("caller", "callee", "provenance"), calls.where("line <> 3").select("caller", "callee", "provenance"))
    return found.groupBy("category", "side", "blocking").agg(F.sum("n").alias("n"))


@register(
    "e2_keyed_diff",
    f"""WITH {B.CODE}, a AS (SELECT * FROM code_docs WHERE node_ref NOT LIKE '%9'), b AS (SELECT * REPLACE (CASE WHEN symbol_type = 'class' THEN 'x' ELSE name END AS name, CASE WHEN node_kind = 'file' THEN 'new' ELSE summary_short END AS summary_short) FROM code_docs WHERE node_ref NOT LIKE '%8'),
f AS (SELECT coalesce(a.node_ref, b.node_ref) AS node_ref, a.node_ref AS x, b.node_ref AS y, a.name AS n1, b.name AS n2, a.summary_short AS s1, b.summary_short AS s2 FROM a FULL JOIN b ON a.node_kind = b.node_kind AND a.node_ref = b.node_ref)
SELECT node_ref, 'missing_row' AS category, true AS blocking FROM f WHERE y IS NULL UNION ALL SELECT node_ref, 'extra_row', true FROM f WHERE x IS NULL
UNION ALL SELECT node_ref, 'field_modified', true FROM f WHERE x IS NOT NULL AND y IS NOT NULL AND n1 IS DISTINCT FROM n2 UNION ALL SELECT node_ref, 'allowed_diff', false FROM f WHERE x IS NOT NULL AND y IS NOT NULL AND s1 IS DISTINCT FROM s2""",
)
def e2_keyed(spark, sf):
    docs = B.code_documents(spark, sf)
    new = docs.withColumn("name", F.when(F.col("symbol_type") == "class", "x").otherwise(F.col("name"))).withColumn("summary_short", F.when(F.col("node_kind") == "file", "new").otherwise(F.col("summary_short")))
    key, _, exact, allowed = VIEWS["retrieval_documents"]
    found = E.classified_diff(docs.where(~F.endswith("node_ref", F.lit("9"))), new.where(~F.endswith("node_ref", F.lit("8"))), key, exact, allowed[:2])
    return found.select("node_ref", "category", "blocking")
