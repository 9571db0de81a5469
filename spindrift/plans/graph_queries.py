"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import graph as G
from spindrift.plans import bindings as B
from spindrift.plans.catalog import register
from spindrift.plans.runtime import cut, table


def bfs_sql(edges: str, seeds: str, depth: int, reverse: bool, ctes: str) -> str:
    at, to = ("callee", "caller") if reverse else ("caller", "callee")
    return f"""WITH RECURSIVE {ctes}, g AS (SELECT DISTINCT caller, callee FROM ({edges})), seeds AS ({seeds}),
r(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT g.{to}, r.depth + 1 FROM r JOIN g ON g.{at} = r.node WHERE r.depth < {depth})
SELECT min(depth)::INT AS depth, node FROM r GROUP BY node HAVING min(depth) > 0"""


def _one(spark, node):
    return spark.range(1).select(F.lit(node).cast("long").alias("node"))


@register("g1_reverse_bfs", bfs_sql("SELECT * FROM part_calls", "SELECT 1::BIGINT AS node", 2, True, B.PART_CALLS))
def g1(spark, sf):
    return G.levels(cut(G.followed(B.part_calls(spark, sf))), _one(spark, 1), 2, True)


@register("g1_static_only", bfs_sql("SELECT * FROM part_calls WHERE provenance IN ('definite', 'probable')", "SELECT 1::BIGINT AS node", 3, True, B.PART_CALLS))
def g1_static(spark, sf):
    return G.levels(cut(G.followed(B.part_calls(spark, sf), static_only=True)), _one(spark, 1), 3, True)


@register("g2_forward_bfs", bfs_sql("SELECT * FROM supply_calls", "SELECT 'cust:1' AS node UNION SELECT 'cust:2'", 3, False, B.SUPPLY_CALLS))
def g2(spark, sf):
    seeds = spark.range(1, 3).select(F.concat(F.lit("cust:"), "id").alias("node"))
    return G.levels(cut(B.supply_rows(spark, sf).where("callee is not null").select("caller", "callee")), seeds, 3)


_CANDIDATES = "candidates AS (SELECT DISTINCT s.l_partkey AS caller, p.p_partkey AS callee FROM lineitem s JOIN part p ON p.p_partkey = s.l_suppkey WHERE s.l_partkey <> p.p_partkey)"


def _candidates(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee")).distinct().join(table(spark, sf, "part").select(F.col("p_partkey").alias("callee")), "callee").where("caller <> callee").select("caller", "callee")


@register("g3_ambiguous_callers", bfs_sql("SELECT caller, callee FROM part_calls UNION SELECT caller, callee FROM candidates", "SELECT 1::BIGINT AS node", 2, True, f"{B.PART_CALLS}, {_CANDIDATES}"))
def g3(spark, sf):
    return G.levels(cut(G.followed(B.part_calls(spark, sf), candidates=_candidates(spark, sf))), _one(spark, 1), 2, True)


@register("g4_ambiguous_callees", bfs_sql("SELECT caller, callee FROM part_calls UNION SELECT caller, callee FROM candidates", "SELECT 2::BIGINT AS node", 2, False, f"{B.PART_CALLS}, {_CANDIDATES}"))
def g4(spark, sf):
    return G.levels(cut(G.followed(B.part_calls(spark, sf), candidates=_candidates(spark, sf))), _one(spark, 2), 2)


def _impact_sql(direction: str, at: str, to: str) -> str:
    return f"""{direction}(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT g.{to}, depth + 1 FROM {direction} JOIN g ON g.{at} = {direction}.node WHERE depth < 2)"""


@register(
    "g5_impact",
    f"""WITH RECURSIVE {B.PART_CALLS}, {B.PART_FILES}, g AS (SELECT DISTINCT caller, callee FROM part_calls),
seeds AS (SELECT node FROM part_files WHERE file = 'Brand#11'), {_impact_sql("up", "callee", "caller")}, {_impact_sql("down", "caller", "callee")},
l AS (SELECT 'up' AS direction, node, min(depth) AS depth FROM up GROUP BY node UNION ALL SELECT 'down', node, min(depth) FROM down GROUP BY node),
a AS (SELECT direction, depth, count(DISTINCT node) AS symbols, count(DISTINCT file) AS files, list_sort(list(DISTINCT file)) AS names FROM l LEFT JOIN part_files USING (node) WHERE depth > 0 GROUP BY ALL)
SELECT direction, depth::INT AS depth, symbols, files, array_to_string(names[1:5], ',') AS labels, greatest(0, len(names) - 5)::INT AS more FROM a""",
)
def g5(spark, sf):
    files = spark.range(1).select(F.lit("Brand#11").alias("file"))
    return G.impact(G.followed(B.part_calls(spark, sf)), B.part_files(spark, sf), files, 2, 2)


@register(
    "g6_adjacency",
    f"""WITH {B.PART_CALLS}, known AS (SELECT p_partkey AS node FROM part WHERE p_size <= 25)
SELECT count(*) FILTER (a.node IS NULL OR b.node IS NULL) AS skipped, count(*) AS edges FROM part_calls e LEFT JOIN known a ON e.caller = a.node LEFT JOIN known b ON e.callee = b.node""",
)
def g6(spark, sf):
    known = table(spark, sf, "part").where("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return G.adjacency(B.part_calls(spark, sf), known)[1]


def _hops(segment: int, source: int, target: int) -> str:
    name = f"r{segment}"
    return f"{name}(node, depth) AS (SELECT {source}::BIGINT, 0 UNION SELECT callee, depth + 1 FROM {name} JOIN g ON g.caller = {name}.node WHERE depth < 5)", f"SELECT {segment}::INT AS segment, {source}::BIGINT AS source, {target}::BIGINT AS target, (SELECT min(depth) FROM {name} WHERE node = {target})::INT AS hops"


_STOPS = (1, 40, 90, 77, 1)
_SEGMENTS = [_hops(k, a, b) for k, (a, b) in enumerate(zip(_STOPS, _STOPS[1:]), 1)]


@register("g7_path_hops", f"WITH RECURSIVE {B.PART_CALLS}, g AS (SELECT DISTINCT caller, callee FROM part_calls), {', '.join(c for c, _ in _SEGMENTS)} {' UNION ALL '.join(q for _, q in _SEGMENTS)}")
def g7(spark, sf):
    """Lengths of the paths between stops."""
    path = G.flow(G.followed(B.part_calls(spark, sf)), list(_STOPS), budget=1_000_000)
    ends = path.groupBy("segment").agg(F.min_by("node", "step").alias("source"), F.max_by("node", "step").alias("target"), F.max("hops").alias("hops"))
    return ends


@register("g9_flow")
def g9(spark, sf):
    """Their nodes, with what each step is called."""
    calls = B.part_calls(spark, sf)
    labelled = calls.withColumn("via", F.when(F.col("provenance") == "inferred", F.lit("observer")))
    return G.flow(G.followed(calls), [*_STOPS, None], budget=1_000_000, labelled=labelled)


@register(
    "g9_steps_are_edges",
    f"""WITH RECURSIVE {B.PART_CALLS}, g AS (SELECT DISTINCT caller, callee FROM part_calls), {', '.join(c for c, _ in _SEGMENTS)}, h AS ({' UNION ALL '.join(q for _, q in _SEGMENTS)}) SELECT sum(hops)::BIGINT AS steps, sum(hops)::BIGINT AS edges FROM h""",
)
def g9_steps(spark, sf):
    """All steps of the paths are edges, and there are as many as shortest paths have."""
    path = G.flow(G.followed(B.part_calls(spark, sf)), list(_STOPS), budget=1_000_000).where("found")
    step = path.alias("x").join(path.alias("y"), F.expr("x.segment = y.segment and y.step = x.step + 1")).select(F.col("x.node").alias("caller"), F.col("y.node").alias("callee"))
    edges = G.followed(B.part_calls(spark, sf)).withColumn("known", F.lit(1))
    return step.join(edges, ["caller", "callee"], "left").agg(F.count("*").alias("steps"), F.count("known").alias("edges"))


@register(
    "g8_named_symbols",
    f"""WITH {B.CODE}, s AS (SELECT * FROM code_symbols) SELECT 'blue_bolt' AS name, ref AS node FROM s WHERE short_name = 'blue_bolt' UNION ALL SELECT 'economy/brand_1:red_widget', ref FROM s WHERE short_name = 'red_widget' AND contains(file, 'economy/brand_1') UNION ALL SELECT 'SMALL.hot_ring', ref FROM s WHERE short_name = 'hot_ring' AND contains(lower(file || '::' || name), 'small')""",
)
def g8_names(spark, sf):
    symbols = B.code_symbols(spark, sf).select(F.col("ref").alias("node"), "file", F.col("name").alias("symbol"), "short_name")
    return G.named_symbols(symbols, ["blue_bolt", "economy/brand_1:red_widget", "SMALL.hot_ring"]).select("name", "node")


@register(
    "g8_choose_symbol",
    f"""WITH RECURSIVE {B.PART_CALLS}, e AS (SELECT DISTINCT caller, callee FROM part_calls), g AS (SELECT caller, callee FROM e UNION SELECT callee, caller FROM e),
r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT callee, depth + 1 FROM r JOIN g ON g.caller = r.node WHERE depth < 2),
near AS (SELECT node FROM r GROUP BY node HAVING min(depth) > 0), d AS (SELECT node, count(*) AS degree FROM (SELECT caller AS node FROM e UNION ALL SELECT callee FROM e) GROUP BY node),
c AS (SELECT p_brand AS name, p_partkey AS node FROM part), o AS (SELECT c.*, near.node IS NOT NULL AS n, coalesce(degree, 0) AS degree, count(*) OVER (PARTITION BY name) AS candidates,
  row_number() OVER (PARTITION BY name ORDER BY (near.node IS NOT NULL) DESC, coalesce(degree, 0) DESC, length(c.node::VARCHAR), c.node::VARCHAR) AS k FROM c LEFT JOIN near USING (node) LEFT JOIN d USING (node))
SELECT name, node, candidates FROM o WHERE k = 1""",
)
def g8(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("node"))
    return G.choose_symbol(names, G.followed(B.part_calls(spark, sf)), _one(spark, 1))


_IMPORTS = """imports AS (SELECT r_name AS file, n_name AS imported FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 's' || s_suppkey, r_name FROM supplier, region WHERE s_suppkey % 9 = r_regionkey),
indexed AS (SELECT r_name AS file FROM region UNION SELECT n_name FROM nation UNION SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 > 0), seeds AS (SELECT file AS node FROM indexed WHERE file IN ('ASIA', 'NATION_3', 'nowhere')),
up(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT file, depth + 1 FROM up JOIN imports ON imported = node WHERE depth < 2), down(node, depth) AS (SELECT node, 0 FROM seeds UNION SELECT imported, depth + 1 FROM down JOIN imports ON file = node WHERE depth < 2),
l AS (SELECT 'up' AS direction, node, min(depth) AS depth FROM up GROUP BY node UNION ALL SELECT 'down', node, min(depth) FROM down GROUP BY node)"""


@register("g10_dependencies", f"WITH RECURSIVE {_IMPORTS} SELECT direction, depth::INT AS depth, node AS file, CASE WHEN node IN (SELECT file FROM indexed) THEN node ELSE node || ' (not indexed)' END AS label FROM l WHERE depth > 0")
def g10(spark, sf):
    """Both directions from two files and one that is unknown; some of what is reached is not indexed."""
    n, r, s = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    key = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    one = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("file"), F.col("n_name").alias("imported"))
    two = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("file"), key.alias("imported"))
    three = s.join(F.broadcast(r), F.col("s_suppkey") % 9 == F.col("r_regionkey")).select(key.alias("file"), F.col("r_name").alias("imported"))
    indexed = r.select(F.col("r_name").alias("file")).unionByName(n.select(F.col("n_name").alias("file"))).unionByName(s.where("s_suppkey % 4 > 0").select(key.alias("file")))
    files = spark.range(1).select(F.explode(F.array(*map(F.lit, ("ASIA", "NATION_3", "nowhere")))).alias("file"))
    return G.dependencies(one.unionByName(two).unionByName(three), indexed, files, "both", 2)


@register(
    "g11_degree",
    f"""WITH {B.PART_CALLS}, e AS (SELECT DISTINCT caller, callee FROM part_calls)
SELECT node, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out, count(*) AS degree FROM (SELECT caller AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT callee, 1, 0 FROM e) GROUP BY node""",
)
def g11(spark, sf):
    return G.degrees(G.followed(B.part_calls(spark, sf)))


_CHANGE = f"""{B.PART_CALLS}, e AS (SELECT row_number() OVER (ORDER BY caller, c.callee, provenance, line) AS edge, 'm' || (caller % 40) AS file, 'n' || (c.callee % 90) AS callee, CASE WHEN c.callee % 3 > 0 THEN 'm' || (c.callee % 40) END AS callee_file, provenance FROM part_calls c),
hosts AS (SELECT DISTINCT file FROM (SELECT 'm' || n AS file, CASE n % 4 WHEN 0 THEN 'os' WHEN 1 THEN 'a.b' WHEN 2 THEN 'b' ELSE 'c' END AS module FROM range(8) t(n)) WHERE module IN ('a.b', 'b')),
hit AS (SELECT * FROM e WHERE provenance <> 'inferred' AND (file IN ('m20', 'm21') OR file IN (SELECT file FROM hosts) OR callee IN ('n5', 'n50')))"""


def _change(spark, sf):
    from pyspark.sql import Window

    calls = B.part_calls(spark, sf)
    edge = F.row_number().over(Window.orderBy("caller", "callee", "provenance", "line"))
    name = lambda c, n: F.concat(F.lit(n), c.cast("string"))
    edges = calls.select(edge.alias("edge"), name(F.col("caller") % 40, "m").alias("file"), name(F.col("callee") % 90, "n").alias("callee"), F.when(F.col("callee") % 3 > 0, name(F.col("callee") % 40, "m")).alias("callee_file"), "provenance")
    k = F.col("id") % 4
    bindings = spark.range(8).select(name(F.col("id"), "m").alias("file"), F.when(k == 0, "os").when(k == 1, "a.b").when(k == 2, "b").otherwise("c").alias("module"))
    one = lambda c, *values: spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(c))
    hosts = G.import_hosts(bindings, one("path", "src/a/b.py", "b/__init__.py", "os.py"))
    return G.affected(edges, one("file", "m20", "m21"), one("name", "n5", "n50"), hosts)


@register("g12_affected", f"WITH {_CHANGE} SELECT file, callee, callee_file, provenance, count(*) AS n FROM hit GROUP BY ALL")
def g12(spark, sf):
    return _change(spark, sf)[0].groupBy("file", "callee", "callee_file", "provenance").agg(F.count("*").alias("n"))


@register("g12_affected_files", f"WITH {_CHANGE} SELECT file FROM hit UNION SELECT callee_file FROM hit WHERE callee_file IS NOT NULL UNION SELECT 'm20' UNION SELECT 'm21'")
def g12_files(spark, sf):
    return _change(spark, sf)[1]


@register(
    "u1_edge_union",
    f"WITH {B.PART_CALLS}, {_CANDIDATES} SELECT caller, callee FROM part_calls UNION SELECT caller, callee FROM candidates",
)
def u1(spark, sf):
    return G.followed(B.part_calls(spark, sf), candidates=_candidates(spark, sf))


@register(
    "q15_enrichment",
    f"""WITH {B.SUPPLY_CALLS}, {B.PART_FILES}, target AS (SELECT 'part:' || node AS node FROM part_files WHERE file = 'Brand#12'),
x AS (SELECT 'callee' AS side, callee AS node FROM supply_calls WHERE caller IN (SELECT node FROM target) UNION SELECT 'caller', caller FROM supply_calls WHERE callee IN (SELECT node FROM target))
SELECT side, node FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY node) AS k FROM x) WHERE k <= 15""",
)
def q15(spark, sf):
    """Distinct callees and callers of one file, capped on each side."""
    from pyspark.sql import Window

    calls = B.supply_calls(spark, sf)
    target = B.part_files(spark, sf).where("file = 'Brand#12'").select(F.concat(F.lit("part:"), "node").alias("t"))
    down = calls.join(target, calls["caller"] == target["t"], "left_semi").select(F.lit("callee").alias("side"), F.col("callee").alias("node"))
    up = calls.join(target, calls["callee"] == target["t"], "left_semi").select(F.lit("caller").alias("side"), F.col("caller").alias("node"))
    both = down.unionByName(up).distinct()
    return both.withColumn("k", F.row_number().over(Window.partitionBy("side").orderBy("node"))).where("k <= 15").drop("k")
