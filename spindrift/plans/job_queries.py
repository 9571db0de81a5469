"""The job queue, freshness, extraction and streaming windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.plans.catalog import register
from spindrift.plans.runtime import table
from spindrift.sources import extract as X
from spindrift.sources import facts as S
from spindrift.streaming import jobs as J


def _log(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type").isin("click", "view", "purchase"), "submit").when(F.col("event_type") == "error", "move").otherwise("recover")
    job = F.when(kind == "submit", F.col("event_id")).otherwise(F.col("event_id") - 150)
    status = F.element_at(F.array(*map(F.lit, ("running", "succeeded", "cancelled"))), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select((F.col("user_id") % 40).alias("project"), F.col("event_id").alias("seq"), kind.alias("kind"), job.alias("job"), F.concat(F.lit("k"), F.col("event_id") % 7).alias("dedupe"), (F.col("event_type") == "purchase").alias("full_scan"), (F.col("event_id") % 5).cast("int").alias("priority"), status.alias("status"))


@register("k1_queue")
def k1(spark, sf):
    return J.reduce_log(_log(spark, sf))


@register(
    "k4_queue_invariants",
    """SELECT o_custkey AS project, o_orderpriority AS dedupe, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS active FROM orders GROUP BY ALL HAVING count(*) FILTER (o_orderstatus = 'O') > 1 OR count(*) FILTER (o_orderstatus = 'P') > 1""",
)
def k4(spark, sf):
    """Keys of a job table that break the invariants."""
    return J.violations(_jobs(spark, sf))


@register("k4_reduced_log_is_sound", "SELECT 0::BIGINT AS broken")
def k4_log(spark, sf):
    """No key of a reduced log breaks them."""
    return J.violations(J.reduce_log(_log(spark, sf))).agg(F.count("*").alias("broken"))


_JOBS = "jobs AS (SELECT o_custkey AS project, o_orderkey AS job, o_orderpriority AS dedupe, o_shippriority AS priority, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'pending' ELSE 'running' END AS status FROM (SELECT *, (o_orderkey % 5)::INT AS o_shippriority FROM orders))"


def _jobs(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return o.select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("dedupe"), (F.col("o_orderkey") % 5).cast("int").alias("priority"), status.alias("status"))


@register("k5_claim_next", f"WITH {_JOBS} SELECT project, job FROM jobs WHERE status = 'pending' AND project NOT IN (SELECT project FROM jobs WHERE status = 'running') QUALIFY row_number() OVER (PARTITION BY project ORDER BY priority DESC, job) = 1")
def k5(spark, sf):
    return J.claimable(_jobs(spark, sf)).select("project", "job")


@register("k8_listing", f"WITH {_JOBS} SELECT job, project FROM jobs WHERE status = 'pending' ORDER BY job DESC LIMIT 200")
def k8(spark, sf):
    return J.listing(_jobs(spark, sf), status="pending", limit=500).select("job", "project")


_STATUS_LIST = ", ".join(f"('{x}')" for x in ("pending", "running", "cancel_requested", "succeeded", "failed", "cancelled", "superseded"))


@register(
    "k3_moves",
    f"""SELECT a.s AS "from", b.s AS "to", (a.s = 'pending' AND b.s IN ('running', 'cancelled', 'superseded')) OR (a.s = 'running' AND b.s IN ('pending', 'succeeded', 'failed', 'cancel_requested', 'superseded')) OR (a.s = 'cancel_requested' AND b.s = 'cancelled') AS legal
FROM (VALUES {_STATUS_LIST}) a(s), (VALUES {_STATUS_LIST}) b(s)""",
)
def k3(spark, sf):
    """Every pair of statuses, and whether the move is legal."""
    every = lambda name: F.explode(F.array(*map(F.lit, J.STATUSES))).alias(name)
    pairs = spark.range(1).select(every("from")).select("from", every("to"))
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in J.MOVES))
    return pairs.withColumn("legal", F.array_contains(legal, F.concat("from", F.lit(">"), "to")))


@register(
    "q14_freshness",
    """WITH s AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS k FROM (SELECT lpad(p_partkey::VARCHAR, 6, '0') AS path, md5(p_name) AS h, md5(CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END) AS now FROM part)),
p AS (SELECT * FROM s WHERE k < 10) SELECT count(*) AS sampled, count(*) FILTER (h <> now) AS mismatched, CASE WHEN count(*) FILTER (h <> now) / count(*) > 0.5 THEN 'stale' WHEN count(*) FILTER (h <> now) / count(*) > 0.2 THEN 'doubtful' ELSE 'fresh' END AS verdict FROM p""",
)
def q14(spark, sf):
    p = table(spark, sf, "part").withColumn("path", F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    stored = p.select("path", F.md5("p_name").alias("struct_hash"))
    found = p.select("path", F.md5(F.when(F.col("p_partkey") % 4 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("struct_hash"))
    return S.sampled_freshness(stored, found)


@register(
    "s4_extract",
    """WITH p AS (SELECT p_brand || '/' || p_partkey || '.py' AS path, replace(p_name, ' ', '_') AS word FROM part)
SELECT path, 'import' AS kind, 'os' AS name, NULL AS owner, 'os' AS target, 1 AS line, NULL AS form FROM p UNION ALL SELECT path, 'binding', NULL, NULL, 'pkg', 2, NULL FROM p UNION ALL SELECT path, 'import', 'x', NULL, 'pkg', 2, NULL FROM p
UNION ALL SELECT path, 'class', 'C' || word, NULL, NULL, 4, NULL FROM p UNION ALL SELECT path, 'base', 'C' || word, NULL, 'Base', 4, NULL FROM p UNION ALL SELECT path, 'function', 'C' || word || '.run', 'C' || word, NULL, 5, NULL FROM p
UNION ALL SELECT path, 'call', NULL, 'C' || word || '.run', 'send', 6, 'attribute' FROM p UNION ALL SELECT path, 'pattern', word, NULL, 'C' || word || '.run', 6, 'django_signal_send' FROM p
UNION ALL SELECT path, 'function', word, NULL, NULL, 8, NULL FROM p UNION ALL SELECT path, 'call', NULL, word, 'x', 9, 'name' FROM p""",
)
def s4(spark, sf):
    """Facts of sources made from all parts."""
    p = table(spark, sf, "part")
    word = F.replace("p_name", F.lit(" "), F.lit("_"))
    source = F.concat(F.lit("import os\nfrom pkg import x\n\nclass C"), word, F.lit("(Base):\n    def run(self):\n        return "), word, F.lit(".send(os)\n\ndef "), word, F.lit("(a, b=1):\n    return x(a)\n"))
    files = p.select(F.concat("p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.lit("python").alias("language"), source.alias("source"))
    return X.extract(files).select("path", "kind", "name", "owner", "target", "line", "form")


@register(
    "d3_synthesizers",
    """WITH t AS (SELECT DISTINCT p_type AS impl FROM part WHERE p_type <> 'ECONOMY'), m AS (SELECT p_type AS owner, p_name AS name, p_type || '.' || p_name AS node, min(p_size) AS line FROM part GROUP BY ALL),
f AS (SELECT impl, u.node AS caller, d.node AS callee, u.line, u.name FROM t JOIN m u ON u.owner = 'ECONOMY' JOIN m d ON d.owner = impl AND d.name = u.name),
e AS (SELECT 'p' || p_partkey AS caller, p_name AS signal, p_size AS line FROM part WHERE p_partkey % 40 = 1), r AS (SELECT p_name AS signal, 'p' || p_partkey AS handler, count(*) OVER (PARTITION BY p_name) AS n FROM part WHERE p_partkey % 40 = 2)
SELECT caller, callee, 0 AS line, 'interface-impl' AS via FROM f QUALIFY row_number() OVER (PARTITION BY impl ORDER BY line, name, caller, callee) <= 10
UNION ALL SELECT caller, handler, min(line), 'observer' FROM e JOIN r USING (signal) WHERE n <= 20 AND caller <> handler GROUP BY ALL""",
)
def d3(spark, sf):
    """All derived edges of the tables that are there."""
    from spindrift.operators import synthesize

    p = table(spark, sf, "part")
    k, node = F.col("p_partkey") % 40, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    kind = F.when(k == 1, "observer_emit").when(k == 2, "observer_register")
    patterns = p.select(kind.alias("pattern_type"), F.col("p_name").alias("signal"), node.alias("handler"), F.col("p_size").alias("line")).where("pattern_type is not null")
    bases = p.select(F.col("p_type").alias("impl"), F.lit("ECONOMY").alias("base")).distinct().where("impl <> base")
    methods = p.groupBy(F.col("p_type").alias("owner"), F.col("p_name").alias("name")).agg(F.min("p_size").alias("line")).withColumn("node", F.concat("owner", F.lit("."), "name"))
    return synthesize.run({"patterns": patterns, "bases": bases, "methods": methods})


@register("windows_beyond_reference", "SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::VARCHAR AS day, count(*) AS n FROM events GROUP BY ALL")
def windows(spark, sf):
    """Tumbling windows by day; an extension beyond the reference, the same plan over a stream."""
    from spindrift.streaming.windows import tumbling

    return tumbling(table(spark, sf, "events")).withColumn("day", F.date_format("day", "yyyy-MM-dd HH:mm:ss"))
