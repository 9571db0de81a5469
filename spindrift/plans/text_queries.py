"""Text functions, retrieval and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import projection as P
from spindrift.operators import search as S
from spindrift.plans import bindings as B
from spindrift.plans.catalog import register
from spindrift.plans.runtime import table



def _tokens(column: str) -> str:
    return rf"regexp_extract_all(translate(lower(coalesce({column}, '')), '{S._MARKED}', '{S._PLAIN}'), '[\p{{L}}\p{{N}}]+')"


_POSTINGS = " UNION ALL ".join(f"SELECT node_kind AS kind, node_ref AS ref, '{c}' AS col, {_tokens(c)} AS ts FROM code_docs" for c in P.SEARCHED)
_INDEX = f"""{B.CODE}, post AS (SELECT kind, ref, col, unnest(ts) AS token, generate_subscripts(ts, 1) AS pos FROM ({_POSTINGS})),
len AS (SELECT node_kind AS kind, node_ref AS ref, coalesce(length, 0) AS length FROM code_docs LEFT JOIN (SELECT kind, ref, count(*) AS length FROM post GROUP BY ALL) ON kind = node_kind AND ref = node_ref),
tot AS (SELECT sum(length) AS a, count(*) AS d FROM len)"""


def _weigh(weights: dict[str, float]) -> str:
    return "CASE col " + " ".join(f"WHEN '{c}' THEN {w}::DOUBLE" for c, w in weights.items()) + " END"


def _score(hits: str, name: str, group: str = "") -> str:
    """CTEs ``name`` of scores over hits ``(kind, ref, q, f)``; with ``group`` each term is a query of its own."""
    idf = "CASE WHEN ln((d - nq + 0.5) / (nq + 0.5)) <= 0 THEN 1e-6 ELSE ln((d - nq + 0.5) / (nq + 0.5)) END"
    return f"""{name}_n AS (SELECT q, count(*) AS nq FROM {hits} GROUP BY q),
{name} AS (SELECT kind, ref{group}, -sum({idf} * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * length / (a / d)))) AS score, count(*) AS matched FROM {hits} JOIN {name}_n USING (q) JOIN len USING (kind, ref), tot GROUP BY kind, ref{group})"""


def _hits(terms: list[str], weights: dict[str, float], name: str) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    return f"""{name}_q(q, term) AS (VALUES {values}),
{name} AS (SELECT kind, ref, q, sum({_weigh(weights)}) AS f FROM post JOIN {name}_q ON starts_with(token, term) WHERE col IN ({", ".join(repr(c) for c in weights)}) GROUP BY ALL)"""


def _index(spark, sf):
    return B.code_index(spark, sf)


@register("x13_bm25_all", f"WITH {_INDEX}, {_hits(['stup', 'pathet'], S.SYMBOL_WEIGHTS, 'h')}, {_score('h', 's')} SELECT kind, ref, round(score, 6) AS score, matched FROM s WHERE matched = 2")
def x13(spark, sf):
    return S.bm25(_index(spark, sf), ["stup", "pathet"], S.SYMBOL_WEIGHTS, "all").select("kind", "ref", F.round("score", 6).alias("score"), "matched")


@register("r3_bm25_or", f"WITH {_INDEX}, {_hits(['idio', 'brand', 'thing'], S.SYMBOL_WEIGHTS, 'h')}, {_score('h', 's')} SELECT kind, ref, round(score, 6) AS score, matched FROM s ORDER BY s.score, kind, ref LIMIT 50")
def r3(spark, sf):
    return S.bm25(_index(spark, sf), ["idio", "brand", "thing"], S.SYMBOL_WEIGHTS).orderBy("score", "kind", "ref").limit(50).select("kind", "ref", F.round("score", 6).alias("score"), "matched")


@register(
    "r3_bm25_phrase",
    f"""WITH {_INDEX}, at_ AS (SELECT a.kind, a.ref, a.col FROM post a JOIN post b USING (kind, ref, col) WHERE a.token = 'blue' AND b.token = 'bolt' AND b.pos = a.pos + 1 AND col IN ('summary_short', 'summary_full')),
h AS (SELECT kind, ref, 0 AS q, sum({_weigh(S.SYMBOL_WEIGHTS)}) AS f FROM at_ GROUP BY kind, ref), {_score('h', 's')} SELECT kind, ref, round(score, 6) AS score FROM s""",
)
def r3_phrase(spark, sf):
    return S.bm25(_index(spark, sf), ["blue", "bolt"], S.SYMBOL_WEIGHTS, "phrase").select("kind", "ref", F.round("score", 6).alias("score"))


_ANY = f"""{_INDEX}, {_hits(['idiot', 'moron', 'blue'], S.SYMBOL_WEIGHTS, 'h')}, {_score('h', 't', ', q')},
k AS (SELECT ref, q, score, row_number() OVER (PARTITION BY q ORDER BY score, lower(name), name, file, coalesce(line, 0)) AS r FROM t JOIN code_symbols USING (ref) WHERE kind = 'symbol')"""


@register("r4_bm25_any", f"WITH {_ANY} SELECT ref, count(*) AS coverage, round(sum(score), 6) AS score FROM k WHERE r <= 50 GROUP BY ref")
def r4(spark, sf):
    """Word by word, each cut at five times the limit of ten."""
    found = S.by_text(B.code_symbols(spark, sf), _index(spark, sf), S.make_query("idiot moron blue", match="any"))
    return found.select("ref", "coverage", F.round("score", 6).alias("score"))


@register("t2_truncation", f"WITH {_ANY}, n AS (SELECT q, count(*) AS c FROM k GROUP BY q) SELECT term, least(coalesce(c, 0), 50) AS candidates, coalesce(c, 0) > 50 AS truncated FROM h_q LEFT JOIN n USING (q)")
def t2(spark, sf):
    return S.truncation(B.code_symbols(spark, sf), _index(spark, sf), S.make_query("idiot moron blue", match="any"))


@register("r10_postings", f'WITH {_INDEX} SELECT col AS "column", token, count(*) AS n, count(DISTINCT kind || ref) AS docs FROM post GROUP BY ALL')
def r10_postings(spark, sf):
    return S.vocabulary(_index(spark, sf))


@register(
    "r10_projection",
    f"""WITH {B.CODE} SELECT node_kind, node_ref, name, name_tokens, source_version, sha256(to_json({{'file_path': file_path, 'language': language, 'name': name, 'name_tokens': name_tokens, 'node_kind': node_kind, 'node_ref': node_ref, 'signature': signature, 'summary_full': summary_full, 'summary_short': summary_short, 'symbol_type': symbol_type}})::VARCHAR) AS content_hash FROM code_docs""",
)
def r10_projection(spark, sf):
    return B.code_documents(spark, sf).select("node_kind", "node_ref", "name", "name_tokens", "source_version", "content_hash")


@register("r11_projection_check", f"WITH {B.CODE} SELECT node_kind AS kind, count(*) AS expected, count(*) AS found, 0::BIGINT AS duplicates, true AS sound FROM code_docs GROUP BY 1")
def r11(spark, sf):
    return P.check(B.code_documents(spark, sf), B.code_files(spark, sf), B.code_symbols(spark, sf), B.code_clusters(spark, sf))


@register("r1_exact", f"WITH {B.CODE} SELECT ref, name FROM code_symbols WHERE lower(name) = 'red_widget' OR lower(short_name) = 'red_widget'")
def r1(spark, sf):
    return S.exact(B.code_symbols(spark, sf), S.make_query(" Red_Widget ")).select("ref", "name")


@register("f5_search_filters", f"WITH {B.CODE} SELECT ref FROM code_symbols WHERE lower(language) IN ('tsparser', 'typescript', 'ts', 'tsx') AND lower(type) = 'class' AND contains(lower(replace(trim(file), '\\', '/')), 'economy/')")
def f5(spark, sf):
    return S.fitting(B.code_symbols(spark, sf), S.make_query("x", language="TypeScript", symbol_type="class", path_hint="ECONOMY\\")).select("ref")


_WORDS = r"regexp_extract_all(lower(replace(name, '_', ' ')), '[\p{L}\p{N}]+')"


@register(
    "r2_prefix",
    f"""WITH {B.CODE}, w AS (SELECT ref, name, {_WORDS} AS ws FROM code_symbols),
n AS (SELECT *, len(list_filter(ws, lambda x: starts_with(x, 'bl'))) > 0 AS a1, len(list_filter(ws, lambda x: starts_with(x, 'bol'))) > 0 AS a2, array_to_string(ws, ' ') AS sp FROM w)
SELECT 'all' AS mode, ref, 4 AS category FROM n WHERE a1 AND a2 UNION ALL SELECT 'any', ref, 4 FROM n WHERE a1 OR a2
UNION ALL SELECT 'phrase', ref, CASE WHEN starts_with(sp, 'bolt') THEN 3 ELSE 4 END FROM n WHERE contains(' ' || sp || ' ', ' bolt ')""",
)
def r2(spark, sf):
    symbols = B.code_symbols(spark, sf)
    modes = (("all", "bl_bol"), ("any", "bl_bol"), ("phrase", "bolt"))
    parts = [S.prefix(symbols, S.make_query(text, match=mode)).select(F.lit(mode).alias("mode"), "ref", "category") for mode, text in modes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("r5_fuzzy")
def r5(spark, sf):
    return S.fuzzy(B.code_symbols(spark, sf), S.make_query("blubolt_77")).select("ref", "name", F.round("ratio", 6).alias("ratio"))


def _details(spark, sf):
    return B.code_documents(spark, sf).where("node_kind = 'symbol'").select(F.col("node_ref").alias("ref"), "signature", F.col("summary_short").alias("summary"))


_ORDER = "lower(name), name, file, coalesce(line, 0)"


@register(
    "r7_search",
    f"""WITH {_INDEX}, {_hits(['blue', 'bolt'], S.SYMBOL_WEIGHTS, 'h')}, {_score('h', 's')}, w AS (SELECT *, {_WORDS} AS ws FROM code_symbols),
p AS (SELECT ref, name, file, line, 1 AS priority, row_number() OVER (ORDER BY {_ORDER}) AS rank FROM w WHERE len(list_filter(ws, lambda x: starts_with(x, 'blue'))) > 0 AND len(list_filter(ws, lambda x: starts_with(x, 'bolt'))) > 0),
b AS (SELECT ref, name, file, line, 2 AS priority, row_number() OVER (ORDER BY score, {_ORDER}) AS rank FROM s JOIN code_symbols USING (ref) WHERE kind = 'symbol' AND matched = 2),
c AS (SELECT * FROM p WHERE rank <= 20 UNION ALL SELECT * FROM b WHERE rank <= 20),
m AS (SELECT ref, name, file, line, min(priority) AS priority, arg_min(rank, priority) AS rank, string_agg(CASE priority WHEN 1 THEN 'prefix#' ELSE 'bm25#' END || rank, ', ' ORDER BY priority) AS sources FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY priority, rank, {_ORDER}) AS position FROM m)
SELECT position::INT AS position, ref, CASE priority WHEN 1 THEN 'prefix' ELSE 'bm25' END AS channel, rank::INT AS rank, sources, signature, summary_short AS summary
FROM n JOIN code_docs ON node_ref = ref AND node_kind = 'symbol' WHERE position <= 20""",
)
def r7(spark, sf):
    found = S.search(B.code_symbols(spark, sf), _index(spark, sf), _details(spark, sf), "blue bolt", limit=20)
    return found.select("position", "ref", "channel", "rank", "sources", "signature", "summary")


@register("q8_search_fuzzy")
def q8(spark, sf):
    found = S.search(B.code_symbols(spark, sf), _index(spark, sf), _details(spark, sf), "blxe_bxlt_7", limit=20, match="phrase")
    return found.select("position", "ref", "channel", "rank", "sources")


@register("r8_nodes", f"WITH {_INDEX}, {_hits(['economy', 'brand'], S.NODE_WEIGHTS, 'h')}, {_score('h', 's')} SELECT kind, ref, rank::INT AS rank FROM (SELECT kind, ref, row_number() OVER (ORDER BY score, ref) AS rank FROM s WHERE kind = 'file') WHERE rank <= 10")
def r8_nodes(spark, sf):
    return S.nodes(_index(spark, sf), S.make_query("economy brand", match="any"), "file", 10)


@register("r8_navigate")
def r8(spark, sf):
    return S.navigate(B.code_symbols(spark, sf), _index(spark, sf), "economy blue", top=25)


@register(
    "r6_merge",
    """WITH c AS (SELECT p_partkey AS ref, p_name AS name, p_brand AS file, p_size AS line, 0 AS priority, row_number() OVER (ORDER BY p_partkey) AS rank FROM part WHERE p_type = 'SMALL'
UNION ALL SELECT p_partkey, p_name, p_brand, p_size, 2, row_number() OVER (ORDER BY p_partkey DESC) FROM part),
b AS (SELECT ref, name, file, line, min(priority) AS priority, string_agg(CASE priority WHEN 0 THEN 'exact#' ELSE 'bm25#' END || rank, ', ' ORDER BY priority) AS sources, arg_min(rank, priority) AS rank FROM c GROUP BY ALL)
SELECT row_number() OVER (ORDER BY priority, rank, lower(name), name, file, line)::INT AS position, ref, CASE priority WHEN 0 THEN 'exact' ELSE 'bm25' END AS channel, rank::INT AS rank, sources FROM b ORDER BY position LIMIT 400""",
)
def r6(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_size").alias("line"), F.col("p_type").alias("type"))
    every = part.count()
    one, two = S._ranked(part.where("type = 'SMALL'"), "exact", every, F.col("ref")), S._ranked(part, "bm25", every, F.desc("ref"))
    return S.merge(one.unionByName(two), 400).select("position", "ref", "channel", "rank", "sources")


@register(
    "x1_tokenize_symbol",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_type || '_' || p_brand || 'HTTPServer' || p_size, '_|::', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' +', ' ', 'g')) AS tokens FROM part""",
)
def x1(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.tokenize_symbol(F.concat("p_type", F.lit("_"), "p_brand", F.lit("HTTPServer"), F.col("p_size").cast("string"))).alias("tokens"))


@register("x2_search_words", r"SELECT conv_id, turn, role, len(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(text, '_|::', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[\p{L}\p{N}][\p{L}\p{N}\p{M}]*')) AS words FROM conversations")
def x2(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", F.size(X.search_words(F.col("text"))).cast("long").alias("words"))


@register("x4_normalize_path", r"SELECT page_id, lower(replace(trim(url), '\', '/')) AS path FROM pages")
def x4(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.normalize_path(F.col("url")).alias("path"))


@register("x5_symbol_hash", r"SELECT item_id, md5(regexp_replace(text, '\s+', '', 'g')) AS hash FROM benchmark")
def x5(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.symbol_hash(F.col("text")).alias("hash"))


@register("x6_file_hash", "SELECT doc_id, md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM documents")
def x6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.file_hash(F.col("text")).alias("hash"))


@register("x8_content_hash", """SELECT p_partkey, sha256('{"brand":"' || p_brand || '","name":"' || p_name || '","size":' || p_size || '}') AS hash FROM part""")
def x8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.content_hash(name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")).alias("hash"))


@register("x10_json", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def x10(spark, sf):
    return table(spark, sf, "events").select("event_id", X.json_or_empty(F.col("props"), "$.k").alias("k"), X.json_or_empty(F.col("props"), "$.missing").alias("missing"))


@register("x17_signature", "SELECT item_id, CASE WHEN length(text) <= 80 THEN text ELSE substring(text, 1, 80) || '... (' || len(string_split(text, ',')) || ' args)' END AS signature FROM benchmark")
def x17(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.format_signature(F.col("text")).alias("signature"))


@register("x18_normalize_signature", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS signature FROM benchmark")
def x18(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.normalize_signature(F.col("text")).alias("signature"))


@register("f3_layer", f"WITH {B.FOLDERS} SELECT file, CASE WHEN list_has_any(string_split(lower(file), '/'), ['nation_1', 'nation_1s']) THEN 'Util' WHEN list_has_any(string_split(lower(file), '/'), ['asia', 'asias']) THEN 'Far' ELSE 'Core' END AS layer FROM folders")
def f3(spark, sf):
    return B.folders(spark, sf).select("file", X.layer_of(F.col("file"), {"Util": ["nation_1"], "Far": ["asia"]}).alias("layer"))


@register("f2_exclusion", f"WITH {B.FOLDERS} SELECT file FROM folders WHERE NOT (file LIKE '%/s1%' OR file LIKE 'ASIA/%')")
def f2(spark, sf):
    return B.folders(spark, sf).where(~X.excluded(F.col("file"), ["s1*", "ASIA/"])).select("file")


_RULES = (("email", r"[a-z0-9._]+@[a-z0-9.]+"), ("ip", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("phone", r"\+[0-9]+ \([0-9]+\)"), ("key", r"(?i)(api|secret)[_-]?key"))


@register(
    "f13_rule_scan",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, rule, count(*) AS lines FROM l JOIN (VALUES "
    + ", ".join(f"('{n}', '{r}')" for n, r in _RULES if n != "key")
    + ") r(rule, pattern) ON regexp_matches(line, pattern) GROUP BY ALL",
)
def f13(spark, sf):
    """Rules over lines; a rule whose category is excluded does not report."""
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    excluded = {"key"}
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(r), F.lit(n)) for n, r in _RULES if n not in excluded)))
    return lines.select("doc_id", F.explode(hits).alias("rule")).groupBy("doc_id", "rule").agg(F.count("*").alias("lines"))


@register("s15_grep", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n::INT AS line_no, line FROM l WHERE regexp_matches(line, '(idiot|moron)') ORDER BY doc_id, n LIMIT 50")
def s15(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.where(F.col("line").rlike("(idiot|moron)")).select("doc_id", (F.col("n") + 1).alias("line_no"), "line").orderBy("doc_id", "line_no").limit(50)


@register(
    "w8_budget",
    "SELECT conv_id, turn, role, used FROM (SELECT conv_id, turn, role, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) = 1)) WHERE used <= 1000",
)
def w8(spark, sf):
    from pyspark.sql import Window

    from spindrift.operators.evaluate import budget_prefix

    once = table(spark, sf, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).where("k = 1")
    return budget_prefix(once, "conv_id", "turn", "text", 1000).select("conv_id", "turn", "role", "used")
