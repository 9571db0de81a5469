"""Resolution, derived edges, clusters, evaluation and plain fact queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindrift.operators import cluster as C
from spindrift.operators import evaluate as E
from spindrift.operators import resolve as R
from spindrift.plans import bindings as B
from spindrift.plans.catalog import register
from spindrift.plans.runtime import table

_CALLS = """calls AS (SELECT c_custkey AS call, c_mktsegment || '/' || c_nationkey AS file, 'n' || (c_custkey % 40) AS name, (c_nationkey % 5)::VARCHAR AS scope, CASE WHEN c_custkey % 3 = 0 THEN 'attribute' ELSE 'name' END AS form FROM customer),
symbols AS (SELECT s_suppkey AS target, (['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE'])[(s_suppkey % 5 + 1)::INT] || '/' || s_nationkey AS file, 'n' || (s_suppkey % 60) AS name, 'n' || (s_suppkey % 45) AS short_name, (s_nationkey % 5)::VARCHAR AS scope FROM supplier),
imports AS (SELECT DISTINCT file, replace(file, 'BUILDING', 'MACHINERY') AS imported FROM calls),
externals AS (SELECT DISTINCT file, name FROM calls WHERE call % 7 = 0)"""


def _resolution(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    calls = c.select(F.col("c_custkey").alias("call"), F.concat("c_mktsegment", F.lit("/"), "c_nationkey").alias("file"), F.concat(F.lit("n"), F.col("c_custkey") % 40).alias("name"), (F.col("c_nationkey") % 5).cast("string").alias("scope"), F.when(F.col("c_custkey") % 3 == 0, "attribute").otherwise("name").alias("form"))
    kinds = F.array(*map(F.lit, ("BUILDING", "MACHINERY", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE")))
    home = F.concat(F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")), F.lit("/"), "s_nationkey")
    symbols = s.select(F.col("s_suppkey").alias("target"), home.alias("file"), F.concat(F.lit("n"), F.col("s_suppkey") % 60).alias("name"), F.concat(F.lit("n"), F.col("s_suppkey") % 45).alias("short_name"), (F.col("s_nationkey") % 5).cast("string").alias("scope"))
    imports = calls.select("file", F.replace("file", F.lit("BUILDING"), F.lit("MACHINERY")).alias("imported")).distinct()
    return calls, symbols, imports, calls.where("call % 7 = 0").select("file", "name").distinct()


_FOUND = f"""{_CALLS}, hits AS (SELECT DISTINCT call, c.file, c.name, c.form, c.scope, target, s.file AS home, s.scope AS sc FROM calls c JOIN symbols s ON c.name = s.name OR c.name = s.short_name),
near AS (SELECT call, target, 2 AS score FROM hits WHERE home = file UNION SELECT call, target, 1 FROM hits WHERE home <> file AND EXISTS (SELECT 1 FROM imports i WHERE i.file = hits.file AND i.imported = home)),
far AS (SELECT call, target, 0 AS score FROM hits WHERE home <> file AND scope = sc AND call NOT IN (SELECT call FROM near) AND NOT (form = 'name' AND EXISTS (SELECT 1 FROM externals x WHERE x.file = hits.file AND x.name = hits.name)) QUALIFY row_number() OVER (PARTITION BY call ORDER BY home, target) <= 10),
found AS (SELECT * FROM near UNION ALL SELECT * FROM far)"""


@register("j6_candidates", f"WITH {_FOUND} SELECT call, target, score FROM found")
def j6(spark, sf):
    return R.candidates(*_resolution(spark, sf))


@register(
    "w5_resolution",
    f"""WITH {_FOUND}, k AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second, count(*) OVER (PARTITION BY call) AS candidates FROM found WINDOW w AS (PARTITION BY call ORDER BY score DESC, target))
SELECT k.call, target, score, CASE WHEN score = second THEN 'speculative' WHEN form = 'attribute' AND score < 2 THEN 'speculative' WHEN score >= 1 THEN 'definite' ELSE 'probable' END AS provenance, candidates FROM k JOIN calls USING (call) WHERE r = 1""",
)
def w5(spark, sf):
    return R.resolution(*_resolution(spark, sf))


@register("j6_stored_candidates", f"WITH {_FOUND} SELECT call, target, score FROM found WHERE call IN (SELECT call FROM found GROUP BY call HAVING count(*) > 1) QUALIFY row_number() OVER (PARTITION BY call ORDER BY score DESC, target) <= 10")
def j6_stored(spark, sf):
    return R.stored_candidates(*_resolution(spark, sf))


_BINDINGS = """paths AS (SELECT DISTINCT lower(p_type) || '/' || replace(p_name, ' ', '/') || '.py' AS path FROM part UNION SELECT DISTINCT 'pkg/' || split_part(p_name, ' ', 1) || '/__init__.py' FROM part),
bindings AS (SELECT s_suppkey AS file, CASE s_suppkey % 5 WHEN 0 THEN 'os.path' WHEN 1 THEN 'blue.bolt' WHEN 2 THEN 'pkg.red' WHEN 3 THEN 'pkg' || s_suppkey ELSE 'economy.red.widget' END AS module, ['a' || s_suppkey, 'b'] AS names FROM supplier),
suffixes AS (SELECT module, unnest([replace(module, '.', '/') || '.py', replace(module, '.', '/') || '/__init__.py']) AS sfx FROM (SELECT DISTINCT module FROM bindings)),
looked AS (SELECT module, count(DISTINCT path) AS hits, min(path) AS path FROM suffixes LEFT JOIN paths ON path = sfx OR suffix(path, '/' || sfx) GROUP BY module)"""


@register(
    "j10_import_bindings",
    f"""WITH {_BINDINGS} SELECT file, path AS imported, NULL AS name FROM bindings JOIN looked USING (module) WHERE hits = 1 AND module <> 'os.path' UNION SELECT file, NULL, unnest(names) FROM bindings JOIN looked USING (module) WHERE hits = 0 OR module = 'os.path'""",
)
def j10_bindings(spark, sf):
    """Modules of the standard library, in one file, in several and in none."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    paths = p.select(F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit(".py")).alias("path")).unionByName(p.select(F.concat(F.lit("pkg/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("/__init__.py")).alias("path"))).distinct()
    k, key = F.col("s_suppkey") % 5, F.col("s_suppkey").cast("string")
    module = F.when(k == 0, "os.path").when(k == 1, "blue.bolt").when(k == 2, "pkg.red").when(k == 3, F.concat(F.lit("pkg"), key)).otherwise("economy.red.widget")
    inside, outside = R.import_bindings(s.select(F.col("s_suppkey").alias("file"), module.alias("module"), F.array(F.concat(F.lit("a"), key), F.lit("b")).alias("names")), paths)
    return inside.withColumn("name", F.lit(None).cast("string")).unionByName(outside.withColumn("imported", F.lit(None).cast("string")))


@register(
    "j10_unique_suffix",
    f"""WITH {B.FOLDERS}, w AS (SELECT 's' || n AS suffix FROM range(1, 120, 7) t(n) UNION SELECT 'NATION_3/s' || n FROM range(1, 60) t(n))
SELECT suffix, count(DISTINCT file) AS hits, CASE WHEN count(DISTINCT file) = 1 THEN min(file) END AS path FROM w LEFT JOIN folders ON file = suffix OR suffix(file, '/' || suffix) GROUP BY suffix""",
)
def j10(spark, sf):
    wanted = spark.range(1, 120, 7).select(F.concat(F.lit("s"), "id").alias("suffix")).unionByName(spark.range(1, 60).select(F.concat(F.lit("NATION_3/s"), "id").alias("suffix")))
    return R.unique_suffix(B.folders(spark, sf).select(F.col("file").alias("path")), wanted)


@register(
    "j15_first_unique_tier",
    """WITH f AS (SELECT o_custkey AS ref, (o_orderkey % 3)::INT AS tier, o_orderpriority AS target FROM orders), t AS (SELECT ref, tier, count(DISTINCT target) AS n, min(target) AS target FROM f GROUP BY ALL)
SELECT ref, target FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.ref = t.ref) AND n = 1""",
)
def j15(spark, sf):
    o = table(spark, sf, "orders")
    return R.first_unique_tier(o.select(F.col("o_custkey").alias("ref"), (F.col("o_orderkey") % 3).cast("int").alias("tier"), F.col("o_orderpriority").alias("target")))


@register(
    "j11_emit_register",
    """WITH r AS (SELECT user_id AS signal, CASE WHEN event_id % 7 > 0 THEN event_id END AS handler, count(*) OVER (PARTITION BY user_id) AS size FROM events WHERE event_type = 'view'),
e AS (SELECT user_id AS signal, event_id AS caller, (event_id % 97)::INT AS line FROM events WHERE event_type = 'click')
SELECT caller, handler AS callee, min(line) AS line, 'observer' AS via FROM e JOIN r USING (signal) WHERE size <= 20 AND handler IS NOT NULL AND caller <> handler GROUP BY 1, 2""",
)
def j11(spark, sf):
    e = table(spark, sf, "events")
    emits = e.where("event_type = 'click'").select(F.col("user_id").alias("signal"), F.col("event_id").alias("caller"), (F.col("event_id") % 97).cast("int").alias("line"))
    registers = e.where("event_type = 'view'").select(F.col("user_id").alias("signal"), F.when(F.col("event_id") % 7 > 0, F.col("event_id")).alias("handler"))
    return R.emit_register(emits, registers, "observer")


def _overrides_sql(pairs: str, owner: str, via: str) -> str:
    return f"""WITH m AS (SELECT {owner} AS owner, p_name AS name, {owner} || '.' || p_name AS node, min(p_size) AS line FROM part GROUP BY ALL), b AS ({pairs}),
e AS (SELECT impl, base, u.node AS caller, d.node AS callee, u.line, u.name FROM b JOIN m u ON u.owner = base JOIN m d ON d.owner = impl AND d.name = u.name WHERE u.node <> d.node),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY impl, base) = 1)
SELECT caller, callee, '{via}' AS via FROM f QUALIFY row_number() OVER (PARTITION BY impl, base ORDER BY line, name, caller, callee) <= 10"""


def _methods(spark, sf, owner):
    return table(spark, sf, "part").groupBy(F.col(owner).alias("owner"), F.col("p_name").alias("name")).agg(F.min("p_size").alias("line")).withColumn("node", F.concat("owner", F.lit("."), "name"))


@register("j12_overrides", _overrides_sql("SELECT 'Brand#' || n AS impl, 'Brand#' || (n + 1) AS base FROM range(1, 20) t(n)", "p_brand", "interface-impl"))
def j12(spark, sf):
    bases = spark.range(1, 20).select(F.concat(F.lit("Brand#"), "id").alias("impl"), F.concat(F.lit("Brand#"), F.col("id") + 1).alias("base"))
    return R.overrides(bases, _methods(spark, sf, "p_brand"), "interface-impl")


@register("j13_trait_dispatch", _overrides_sql("SELECT DISTINCT p_type AS impl, 'ECONOMY' AS base FROM part WHERE p_type <> 'ECONOMY'", "p_type", "trait-impl"))
def j13(spark, sf):
    """As overrides, with the links taken from declared facts."""
    links = table(spark, sf, "part").select(F.col("p_type").alias("impl"), F.lit("ECONOMY").alias("base")).distinct().where("impl <> base")
    return R.overrides(links, _methods(spark, sf, "p_type"), "trait-impl")


@register(
    "j14_pointer_dispatch",
    """WITH layout AS (SELECT p_brand AS owner, p_name AS field, p_size AS slot FROM part WHERE p_size % 2 = 0 OR p_type IN ('SMALL', 'ECONOMY')),
g AS (SELECT p_brand AS owner, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS field, p_size AS slot, p_partkey AS handler FROM part),
r AS (SELECT DISTINCT owner, field, handler FROM (SELECT owner, field, handler FROM g WHERE field IS NOT NULL AND EXISTS (SELECT 1 FROM layout l WHERE l.owner = g.owner AND l.field = g.field) UNION ALL SELECT g.owner, l.field, handler FROM g JOIN layout l ON l.owner = g.owner AND l.slot = g.slot WHERE g.field IS NULL)),
s AS (SELECT o_orderkey AS caller, p_name AS field, CASE WHEN o_orderkey % 2 = 0 THEN 'Brand#' || (o_orderkey % 25) END AS hint FROM orders JOIN part ON p_partkey = o_orderkey % 200),
f AS (SELECT DISTINCT owner, field FROM layout), o AS (SELECT field, count(DISTINCT owner) AS n, min(owner) AS sole FROM f GROUP BY field),
x AS (SELECT caller, s.field, CASE WHEN f.owner IS NOT NULL THEN hint WHEN n = 1 THEN sole END AS owner FROM s LEFT JOIN f ON f.owner = hint AND f.field = s.field LEFT JOIN o ON o.field = s.field)
SELECT DISTINCT caller, handler AS callee FROM x JOIN r ON r.owner = x.owner AND r.field = x.field""",
)
def j14(spark, sf):
    """Fields that hold functions by flag or type, registered by name or slot, over all parts and orders."""
    p = table(spark, sf, "part")
    layout = p.select(F.col("p_brand").alias("owner"), F.col("p_name").alias("field"), F.col("p_size").alias("slot"), F.col("p_type").alias("type"), (F.col("p_size") % 2 == 0).alias("is_pointer"))
    types = spark.range(1).select(F.explode(F.array(F.lit("SMALL"), F.lit("ECONOMY"))).alias("type"))
    fields = R.pointer_fields(layout, types)
    given = p.select(F.col("p_brand").alias("owner"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("field"), F.col("p_size").alias("slot"), F.col("p_partkey").alias("handler"))
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey") % 200)
    sites = o.join(p.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("field")), "k").select(F.col("o_orderkey").alias("caller"), "field", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Brand#"), F.col("o_orderkey") % 25)).alias("hint"))
    return R.pointer_dispatch(fields.select("owner", "field").distinct(), R.registrations(given, fields), sites)


_DEFS = "defs AS (SELECT o_custkey AS key, o_orderkey AS id, CASE WHEN o_custkey % 8 = 0 THEN 't' ELSE o_orderstatus END AS type, CASE WHEN o_custkey % 16 = 0 THEN 's' ELSE o_orderpriority END AS signature, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS line, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT + (o_totalprice / 9000)::INT AS end_line, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS segment FROM orders)"


def _definitions(spark, sf):
    o = table(spark, sf, "orders")
    line = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return o.select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 8 == 0, "t").otherwise(F.col("o_orderstatus")).alias("type"), F.when(F.col("o_custkey") % 16 == 0, "s").otherwise(F.col("o_orderpriority")).alias("signature"),
        line.alias("line"), (line + F.round(F.col("o_totalprice") / 9000).cast("int")).alias("end_line"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("segment"),
    )


_CONFLICTS = "conflicts AS (SELECT key, CASE WHEN count(DISTINCT type) > 1 THEN 'type_variant' WHEN count(DISTINCT signature) > 1 THEN 'signature_variant' ELSE 'duplicate_definition' END AS conflict FROM defs GROUP BY key HAVING count(*) > 1)"


@register("a16_conflicts", f"WITH {_DEFS}, {_CONFLICTS} SELECT * FROM conflicts")
def a16(spark, sf):
    return R.classify_conflicts(_definitions(spark, sf))


@register(
    "w3_canonical",
    f"""WITH {_DEFS}, {_CONFLICTS}, k AS (SELECT key, id, conflict, row_number() OVER (PARTITION BY key ORDER BY line, end_line, type, signature, coalesce(segment, ''), id) - 1 AS occurrence,
  row_number() OVER (PARTITION BY key ORDER BY segment IS NULL, end_line - line DESC, length(coalesce(segment, '')) DESC, line, end_line, type, signature, coalesce(segment, ''), id) AS e FROM defs JOIN conflicts USING (key))
SELECT key, id, occurrence::INT AS occurrence, CASE WHEN conflict = 'signature_variant' THEN occurrence = 0 ELSE e = 1 END AS is_canonical, conflict, CASE WHEN conflict = 'signature_variant' THEN 'earliest_source_position' ELSE 'max_source_extent_then_position' END AS reason FROM k""",
)
def w3(spark, sf):
    d = _definitions(spark, sf)
    return R.canonical(d, R.classify_conflicts(d))


@register("a8_call_dedupe", "SELECT l_returnflag AS file, l_partkey AS caller, l_suppkey AS callee, min(l_linenumber) AS line, CASE WHEN bool_or(l_linestatus = 'O') THEN 'name' ELSE 'attribute' END AS form FROM lineitem GROUP BY 1, 2, 3")
def a8(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linestatus") == "O", "name").otherwise("attribute").alias("form"))
    return R.dedupe_calls(rows)


_CLUSTERS = f"""{B.FOLDERS}, t AS (SELECT file, string_split(file, '/')[1] AS top, count(*) OVER (PARTITION BY string_split(file, '/')[1]) AS n FROM folders),
c AS (SELECT file, CASE WHEN n > 15 THEN string_split(file, '/')[1] || '/' || string_split(file, '/')[2] ELSE top END AS cluster FROM t), members AS (SELECT file, cluster FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS s FROM c) WHERE s >= 2)"""


@register("a7_clusters", f"WITH {_CLUSTERS} SELECT * FROM members")
def a7(spark, sf):
    return C.by_folder(B.folders(spark, sf))


@register(
    "a5_density",
    f"""WITH {_CLUSTERS}, {B.CO_SUPPLY}, i AS (SELECT a.cluster, count(*) AS internal FROM co_supply e JOIN members a ON e.source = a.file JOIN members b ON e.target = b.file WHERE a.cluster = b.cluster GROUP BY 1)
SELECT cluster, files, internal, internal / files AS density FROM (SELECT cluster, count(*) AS files, any_value(coalesce(internal, 0)) AS internal FROM members LEFT JOIN i USING (cluster) GROUP BY cluster) WHERE internal / files >= 0.5""",
)
def a5(spark, sf):
    return C.dense(C.by_folder(B.folders(spark, sf)), B.co_supply(spark, sf))


@register(
    "a4_entry_symbols",
    f"""WITH {_CLUSTERS}, {B.CO_SUPPLY}, n AS (SELECT cluster, 'p' || part AS callee, count(*) AS n FROM co_supply JOIN members ON target = file GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, callee) AS r FROM n), e AS (SELECT cluster, string_agg(callee, ',' ORDER BY r) AS entries FROM k WHERE r <= 3 GROUP BY cluster)
SELECT cluster, coalesce(any_value(entries), min(file) || '::*') AS entries FROM members LEFT JOIN e USING (cluster) GROUP BY cluster""",
)
def a4(spark, sf):
    calls = B.co_supply(spark, sf).select(F.concat(F.lit("p"), "part").alias("callee"), F.col("target").alias("callee_file"))
    return C.entries(C.by_folder(B.folders(spark, sf)), calls)


@register(
    "a6_file_kind",
    f"""WITH {B.FOLDERS}, {B.CO_SUPPLY}, s AS (SELECT r_name AS file, count(*) AS symbols FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0 OR r_regionkey < 3 GROUP BY 1),
e AS (SELECT string_split(source, '/')[1] AS file, count(*) AS intra FROM co_supply WHERE string_split(source, '/')[1] = string_split(target, '/')[1] GROUP BY 1)
SELECT file, symbols, coalesce(intra, 0) AS intra, CASE WHEN symbols < 5 THEN 'trivial' WHEN coalesce(intra, 0) / symbols < 0.25 THEN 'low_cohesion' ELSE 'cohesive' END AS kind FROM s LEFT JOIN e USING (file)""",
)
def a6(spark, sf):
    top = lambda c: F.split(c, "/")[0]
    r = table(spark, sf, "region")
    files = B.folders(spark, sf).withColumn("r_name", top("file")).join(F.broadcast(r), "r_name").where("suppkey % 3 <> 0 or r_regionkey < 3")
    edges = B.co_supply(spark, sf).select(top("source").alias("source"), top("target").alias("target"))
    return C.file_kind(files.select(F.col("r_name").alias("file")), edges)


@register(
    "j5_inbound_clusters",
    f"WITH {_CLUSTERS}, {B.CO_SUPPLY} SELECT DISTINCT b.cluster, a.cluster AS inbound FROM co_supply e JOIN members a ON e.source = a.file JOIN members b ON e.target = b.file WHERE a.cluster <> b.cluster",
)
def j5(spark, sf):
    m, e = C.by_folder(B.folders(spark, sf)), B.co_supply(spark, sf)
    one, two = m.select(F.col("file").alias("source"), F.col("cluster").alias("inbound")), m.select(F.col("file").alias("target"), "cluster")
    return e.join(one, "source").join(two, "target").where("inbound <> cluster").select("cluster", "inbound").distinct()


_SNAP = "a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 17 <> 0)"


def _snapshots(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.where("o_orderkey % 11 <> 0"), o.where("o_orderkey % 17 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))


@register(
    "j16_snapshot_diff",
    f"""WITH {_SNAP}, f AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ak, b.o_orderkey AS bk, a.o_orderstatus AS s1, b.o_orderstatus AS s2 FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, CASE WHEN ak IS NULL THEN 'only_right' WHEN bk IS NULL THEN 'only_left' ELSE 'changed' END AS finding, CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN 'o_orderstatus' END AS "column",
       CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN s1 END AS left_value, CASE WHEN ak IS NOT NULL AND bk IS NOT NULL THEN s2 END AS right_value FROM f WHERE ak IS NULL OR bk IS NULL OR s1 IS DISTINCT FROM s2""",
)
def j16(spark, sf):
    return E.diff(*_snapshots(spark, sf), ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@register(
    "u3_multiset_diff",
    """WITH a AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber <= 4), b AS (SELECT l_partkey, l_returnflag FROM lineitem WHERE l_linenumber >= 3)
SELECT 'left' AS side, l_partkey, l_returnflag, count(*) AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL UNION ALL SELECT 'right', l_partkey, l_returnflag, count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""",
)
def u3(spark, sf):
    rows = table(spark, sf, "lineitem")
    return E.multiset_diff(rows.where("l_linenumber <= 4").select("l_partkey", "l_returnflag"), rows.where("l_linenumber >= 3").select("l_partkey", "l_returnflag"))


@register(
    "a9_count_diff",
    f"""WITH {B.PART_CALLS}, a AS (SELECT caller, count(*) AS n FROM part_calls WHERE provenance = 'inferred' GROUP BY 1), b AS (SELECT caller, count(*) AS n FROM part_calls WHERE provenance = 'inferred' AND line <> 2 GROUP BY 1)
SELECT coalesce(a.caller, b.caller) AS caller FROM a FULL JOIN b ON a.caller = b.caller WHERE a.n IS DISTINCT FROM b.n""",
)
def a9(spark, sf):
    calls = B.part_calls(spark, sf).where("provenance = 'inferred'")
    a, b = calls.groupBy("caller").agg(F.count("*").alias("n")), calls.where("line <> 2").groupBy("caller").agg(F.count("*").alias("m"))
    return a.join(b, "caller", "full_outer").where(~F.col("n").eqNullSafe(F.col("m"))).select("caller")


_SETS = "e AS (SELECT DISTINCT o_custkey AS task, o_orderpriority AS item FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT DISTINCT o_custkey AS task, o_orderpriority AS item FROM orders WHERE o_orderkey % 3 = 0)"


def _sets(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderpriority").alias("item"), "o_orderkey")
    return o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")


@register(
    "a10_set_scores",
    f"""WITH {_SETS}, n AS (SELECT coalesce(e.task, p.task) AS task, count(*) FILTER (e.task IS NOT NULL AND p.task IS NOT NULL) AS m, count(e.task) AS ne, count(p.task) AS np FROM e FULL JOIN p ON e.task = p.task AND e.item = p.item GROUP BY 1),
s AS (SELECT c_custkey AS task, coalesce(m, 0) AS m, CASE WHEN coalesce(ne, 0) + coalesce(np, 0) = 0 THEN 1 ELSE coalesce(m / nullif(ne, 0), 0) END AS r, CASE WHEN coalesce(ne, 0) + coalesce(np, 0) = 0 THEN 1 ELSE coalesce(m / nullif(np, 0), 0) END AS q FROM customer LEFT JOIN n ON task = c_custkey)
SELECT task, m AS matched, round(r, 4) AS recall, round(q, 4) AS "precision", round(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) ELSE 0 END, 4) AS f1 FROM s""",
)
def a10(spark, sf):
    return E.set_scores(table(spark, sf, "customer").select(F.col("c_custkey").alias("task")), *_sets(spark, sf))


@register(
    "a11_ranked_scores",
    """WITH r AS (SELECT o_custkey AS task, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), e AS (SELECT o_custkey AS task, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F')
SELECT task, round(count(*) FILTER (rank <= 1) / count(*), 4) AS recall_at_1, round(count(*) FILTER (rank <= 5) / count(*), 4) AS recall_at_5, round(count(*) FILTER (rank <= 10) / count(*), 4) AS recall_at_10, round(coalesce(1 / min(rank), 0), 4) AS reciprocal_rank FROM e LEFT JOIN r USING (task, item) GROUP BY task""",
)
def a11(spark, sf):
    o = table(spark, sf, "orders")
    ranked = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    return E.ranked_scores(ranked, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("item")))


@register(
    "a11_overall",
    """WITH r AS (SELECT o_custkey AS task, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), e AS (SELECT o_custkey AS task, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT task, round(count(*) FILTER (rank <= 1) / count(*), 4) AS r1, round(count(*) FILTER (rank <= 5) / count(*), 4) AS r5, round(count(*) FILTER (rank <= 10) / count(*), 4) AS r10, round(coalesce(1 / min(rank), 0), 4) AS rr FROM e LEFT JOIN r USING (task, item) GROUP BY task),
t AS (SELECT c_custkey AS task, c_custkey % 10 = 3 AS ee, c_custkey % 15 = 3 AS er, c_custkey % 4 AS results, c_custkey % 7 = 3 AS failed FROM customer)
SELECT count(r1) AS eligible, round(avg(r1), 6) AS mean_recall_at_1, round(avg(r5), 6) AS mean_recall_at_5, round(avg(r10), 6) AS mean_recall_at_10, round(avg(rr), 6) AS mean_reciprocal_rank, round(count(*) FILTER (results = 0 AND NOT failed) / count(*) FILTER (NOT failed), 6) AS no_result_rate,
  count(*) FILTER (ee AND NOT er) AS empty_tasks, round(count(*) FILTER (results = 0 AND ee AND NOT er) / count(*) FILTER (ee AND NOT er), 6) AS empty_accuracy, count(*) FILTER (er) AS error_tasks, round(count(*) FILTER (failed AND er) / count(*) FILTER (er), 6) AS error_accuracy FROM t LEFT JOIN s USING (task)""",
)
def a11_overall(spark, sf):
    k = F.col("c_custkey")
    tasks = table(spark, sf, "customer").select(k.alias("task"), (k % 10 == 3).alias("expected_empty"), (k % 15 == 3).alias("expected_error"), (k % 4).alias("results"), (k % 7 == 3).alias("failed"))
    out = E.overall(tasks, a11(spark, sf))
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@register(
    "a12_median_gain",
    """WITH v AS (SELECT o_orderpriority AS tier, o_custkey % 50 AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS arm, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS value FROM orders),
m AS (SELECT tier, task, arm, median(value) AS m, count(value) AS g, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT tier, task, max(m) FILTER (arm = 'A') AS a, max(m) FILTER (arm = 'B') AS b, coalesce(sum(g) FILTER (arm = 'A'), 0) AS ga, coalesce(sum(n) FILTER (arm = 'A'), 0) AS na, coalesce(sum(g) FILTER (arm = 'B'), 0) AS gb, coalesce(sum(n) FILTER (arm = 'B'), 0) AS nb FROM m GROUP BY ALL),
q AS (SELECT * FROM p UNION ALL SELECT 'overall', * EXCLUDE (tier) FROM p)
SELECT tier, round(median(a) FILTER (a IS NOT NULL AND b IS NOT NULL), 4) AS median_a, round(median(b) FILTER (a IS NOT NULL AND b IS NOT NULL), 4) AS median_b, round(median(b - a), 4) AS gain, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tasks, round(sum(ga) / sum(na), 4) AS answered_a, round(sum(gb) / sum(nb), 4) AS answered_b FROM q GROUP BY tier""",
)
def a12(spark, sf):
    o = table(spark, sf, "orders")
    return E.median_gain(o.select(F.col("o_orderpriority").alias("tier"), (F.col("o_custkey") % 50).alias("task"), F.when(F.col("o_orderkey") % 2 == 0, "A").otherwise("B").alias("arm"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("value")))


@register("a13_nearest_rank", "SELECT event_type, min(value) AS lo, list_sort(list(value))[greatest(1, ceil(0.5 * count(*)))::INT] AS p50, list_sort(list(value))[greatest(1, ceil(0.95 * count(*)))::INT] AS p95, max(value) AS hi FROM events GROUP BY event_type")
def a13(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.min("value").alias("lo"), E.nearest_rank("value", 0.5).alias("p50"), E.nearest_rank("value", 0.95).alias("p95"), F.max("value").alias("hi"))


@register(
    "e5_baseline_classes",
    """SELECT n.c_custkey AS task, CASE WHEN b.c_custkey IS NULL THEN 'new_task' WHEN n.c_custkey % 5 = 0 THEN 'intentional_contract_change' WHEN n.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'behavior_change' END AS class
FROM (SELECT c_custkey, c_mktsegment AS v FROM customer) n LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'OLD' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 9 <> 0) b USING (c_custkey)""",
)
def e5(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("value"))
    before = c.where("task % 9 <> 0").withColumn("value", F.when(F.col("task") % 4 == 0, "OLD").otherwise(F.col("value")))
    return E.compare_baselines(c, before, c.where("task % 5 = 0").select("task"))


@register("j18_cross_references", "SELECT l_partkey AS target, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS sections FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2")
def j18(spark, sf):
    return E.cross_references(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("section")))


@register("f1_symbol_lookup", "SELECT p_partkey, p_name FROM part WHERE p_name = 'blue bolt' OR p_brand = 'Brand#7' ORDER BY p_name, p_partkey LIMIT 50")
def f1(spark, sf):
    return table(spark, sf, "part").where("p_name = 'blue bolt' or p_brand = 'Brand#7'").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(50)


@register("f4_optional_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 46")
def f4(spark, sf):
    """Filters that are absent add no predicate."""
    wanted, out = {"event_type": "click", "user_id": 46, "value": None}, table(spark, sf, "events")
    for column, value in wanted.items():
        out = out if value is None else out.where(F.col(column) == value)
    return out.select("event_id")


@register("f6_static_edges", f"WITH {B.PART_CALLS} SELECT provenance, count(*) AS n FROM part_calls WHERE provenance IN ('definite', 'probable') GROUP BY 1")
def f6(spark, sf):
    from spindrift.operators.graph import is_static

    return B.part_calls(spark, sf).where(is_static(F.col("provenance"))).groupBy("provenance").agg(F.count("*").alias("n"))


@register("f7_changed_rows", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey = o.o_orderkey AND s.o_orderkey % 6 <> 0 AND s.o_totalprice IS NOT DISTINCT FROM o.o_totalprice)")
def f7(spark, sf):
    from spindrift.sources.facts import changed

    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return changed(o, o.where("o_orderkey % 6 <> 0"), ["o_orderkey"], ["o_totalprice"]).select("o_orderkey")


@register("f9_timeline", "SELECT o_orderkey FROM orders WHERE try_strptime(CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d') IS NULL OR o_orderdate >= TIMESTAMP '1998-01-01'")
def f9(spark, sf):
    """Rows since a date; a date that can't be read passes."""
    o = table(spark, sf, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    d = F.try_to_date("raw", "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp("raw", F.lit("yyyy-MM-dd")))
    return o.where(d.isNull() | (d >= F.lit("1998-01-01").cast("date"))).select("o_orderkey")


@register("s12_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS v, 'replace' AS mode FROM orders UNION ALL SELECT o_orderkey, 'old', 'ignore' FROM orders")
def s12(spark, sf):
    from spindrift.sources.facts import upsert

    old = table(spark, sf, "orders").select("o_orderkey", F.lit("old").alias("v"))
    new = old.where("o_orderkey % 3 = 0").withColumn("v", F.lit("new"))
    return upsert(old, new, ["o_orderkey"]).withColumn("mode", F.lit("replace")).unionByName(upsert(old, new, ["o_orderkey"], replace=False).withColumn("mode", F.lit("ignore")))


@register("u4_sweep", "SELECT o_custkey AS path FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0")
def u4(spark, sf):
    """Stored keys that are not discovered any more."""
    stored, found = table(spark, sf, "orders").select(F.col("o_custkey").alias("path")), table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("path"))
    return stored.distinct().join(found, "path", "left_anti")


@register("j9_orphans", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) ON c_custkey = o_custkey WHERE c_custkey IS NULL")
def j9(spark, sf):
    from spindrift.sources.facts import orphans

    parents = table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return orphans(table(spark, sf, "orders"), parents, ["o_custkey"]).select("o_orderkey")


@register("f8_invalid_identities", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 2 = 0 AND c_custkey % 3 IS NOT DISTINCT FROM 1)")
def f8(spark, sf):
    """Rows whose stored identity is none of the current ones."""
    from spindrift.sources.facts import invalid

    stored = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("contract"), (F.col("c_nationkey") % 2).alias("backend"), (F.col("c_custkey") % 3).alias("environment"))
    now = spark.range(1).select(F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("contract"), F.lit(0).alias("backend"), F.lit(1).alias("environment"))
    return invalid(stored, now, ["contract", "backend", "environment"]).select("c_custkey")


_RAW = "SELECT o_orderkey, o_orderdate, try_strptime(CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '%Y-%m-%d') AS d FROM orders"


@register(
    "f9_timeline_modes",
    f"""WITH t AS ({_RAW}) SELECT 'all' AS mode, o_orderkey FROM t UNION ALL SELECT 'fallback', o_orderkey FROM t UNION ALL (SELECT 'last_n', o_orderkey FROM t ORDER BY o_orderkey LIMIT 40)
UNION ALL SELECT 'within_days', o_orderkey FROM t WHERE d IS NULL OR d >= DATE '1998-08-01' - INTERVAL 30 DAY""",
)
def f9_modes(spark, sf):
    from spindrift.sources.facts import timeline

    rows = table(spark, sf, "orders").withColumn("raw", F.when(F.col("o_orderkey") % 10 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    modes = {"all": ("all", ""), "fallback": ("last_n", "many"), "last_n": ("last_n", "40"), "within_days": ("within_days", "30")}
    out = None
    for name, (mode, value) in modes.items():
        one = timeline(rows, "raw", "o_orderkey", mode, value, "1998-08-01").select(F.lit(name).alias("mode"), "o_orderkey")
        out = one if out is None else out.unionByName(one)
    return out


@register("t4_top_clusters", f"WITH {_CLUSTERS} SELECT cluster, count(*) AS files FROM members GROUP BY 1 ORDER BY files DESC, cluster LIMIT 5")
def t4(spark, sf):
    return C.by_folder(B.folders(spark, sf)).groupBy("cluster").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "cluster").limit(5)


@register("t5_kind_priority", "SELECT ref, kind FROM (SELECT p_partkey AS ref, 'symbol' AS kind, 0 AS k FROM part UNION ALL SELECT s_suppkey, 'file', 1 FROM supplier UNION ALL SELECT n_nationkey, 'cluster', 2 FROM nation) ORDER BY k, ref LIMIT (SELECT count(*) + 60 FROM part)")
def t5(spark, sf):
    part, s, n = (table(spark, sf, t) for t in ("part", "supplier", "nation"))
    both = part.select(F.col("p_partkey").alias("ref"), F.lit("symbol").alias("kind"), F.lit(0).alias("k"))
    both = both.unionByName(s.select(F.col("s_suppkey").alias("ref"), F.lit("file").alias("kind"), F.lit(1).alias("k"))).unionByName(n.select(F.col("n_nationkey").cast("long").alias("ref"), F.lit("cluster").alias("kind"), F.lit(2).alias("k")))
    return both.orderBy("k", "ref").limit(part.count() + 60).select("ref", "kind")


@register("q17_overview", f"WITH {_CLUSTERS} SELECT cluster, count(*) AS files, (SELECT count(*) FROM folders) AS all_files FROM members GROUP BY cluster")
def q17(spark, sf):
    f = B.folders(spark, sf)
    return C.by_folder(f).groupBy("cluster").agg(F.count("*").alias("files")).withColumn("all_files", f.agg(F.count("*")).scalar())
