"""Version histories, counters and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import versions as V
from spindrift.plans import bindings as B
from spindrift.plans.catalog import register
from spindrift.plans.runtime import table


def _current(spark, sf):
    return V.current(B.user_versions(spark, sf), B.usable_props())


@register("w1_current_version", f"WITH {B.USER_VERSIONS}, {B.CURRENT} SELECT kind, ref, version, latest_status FROM current_versions")
def w1(spark, sf):
    return _current(spark, sf).drop("summary")


@register(
    "w2_next_version",
    f"""WITH {B.USER_VERSIONS}, n AS (SELECT 'user' AS kind, o_custkey AS ref, o_orderkey FROM orders)
SELECT n.kind, n.ref, o_orderkey, coalesce((SELECT max(version) FROM user_versions v WHERE v.ref = n.ref), 0) + row_number() OVER (PARTITION BY n.ref ORDER BY o_orderkey) AS version FROM n""",
)
def w2(spark, sf):
    new = table(spark, sf, "orders").select(F.lit("user").alias("kind"), F.col("o_custkey").alias("ref"), "o_orderkey")
    return V.next_version(B.user_versions(spark, sf), new, "o_orderkey").select("kind", "ref", "o_orderkey", "version")


@register("j17_previous_version", f"WITH {B.USER_VERSIONS} SELECT ref, version, lag(version) OVER w AS previous_version, lag(summary) OVER w AS previous_summary FROM user_versions WINDOW w AS (PARTITION BY ref ORDER BY version)")
def j17(spark, sf):
    return V.previous(B.user_versions(spark, sf)).select("ref", "version", "previous_version", "previous_summary")


@register(
    "k12_child_changes",
    f"""WITH {B.USER_VERSIONS}, {B.CURRENT}, p AS (SELECT *, lag(summary) OVER (PARTITION BY ref ORDER BY version) AS before FROM user_versions)
SELECT c.ref % 10 AS parent, c.ref, before, p.summary AS after FROM current_versions c JOIN p ON p.ref = c.ref AND p.version = c.version WHERE p.summary IS DISTINCT FROM before""",
)
def k12(spark, sf):
    v = B.user_versions(spark, sf)
    parents = v.select("kind", "ref").distinct().withColumn("parent", F.col("ref") % 10)
    return V.child_changes(v, parents, B.usable_props())


@register(
    "a17_change_counters",
    f"""WITH {B.USER_VERSIONS}, {B.CURRENT}, p AS (SELECT ref, status, summary, lag(summary) OVER (PARTITION BY ref ORDER BY version) AS before FROM user_versions)
SELECT ref % 10 AS parent, count(*) AS changes FROM p WHERE status IN ('ok', 'oversized_warn') AND NOT coalesce(summary = before, false) AND ref % 10 IN (SELECT ref FROM current_versions WHERE version IS NOT NULL) GROUP BY 1""",
)
def a17(spark, sf):
    v = B.user_versions(spark, sf)
    parents = v.select("kind", "ref").distinct().withColumn("parent", F.col("ref") % 10)
    usable = _current(spark, sf).where("version is not null").select(F.col("ref").alias("parent"))
    return V.change_counters(v, parents, usable)


@register(
    "k11_propagation",
    """WITH c AS (SELECT user_id AS parent, count(*) AS changes, count(DISTINCT event_type) AS leaves, date_diff('day', max(ts)::DATE, DATE '2024-02-20') AS age_days,
  count(*) FILTER (event_type = 'purchase') AS real_changes, user_id % 2 = 0 AS judged FROM events GROUP BY user_id)
SELECT parent, CASE WHEN changes >= 50 OR age_days >= 30 THEN 'force' WHEN real_changes = 0 THEN 'reset' WHEN judged THEN 'rewrite' ELSE 'keep' END AS decision FROM c""",
)
def k11(spark, sf):
    e = table(spark, sf, "events")
    age = F.datediff(F.lit("2024-02-20").cast("date"), F.max("ts").cast("date"))
    c = e.groupBy(F.col("user_id").alias("parent")).agg(F.count("*").alias("changes"), F.count_distinct("event_type").alias("leaves"), age.alias("age_days"), F.count_if(F.col("event_type") == "purchase").alias("real_changes"))
    return V.decide(c.withColumn("judged", F.col("parent") % 2 == 0)).select("parent", "decision")


@register(
    "k10_stale_cascade",
    """WITH a AS (SELECT l_orderkey AS parent, md5(string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey)) AS h FROM lineitem GROUP BY 1),
b AS (SELECT l_orderkey AS parent, md5(string_agg(l_partkey || ':' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey)) AS h FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT coalesce(a.parent, b.parent) AS parent FROM a FULL JOIN b ON a.parent = b.parent WHERE a.h IS DISTINCT FROM b.h""",
)
def k10(spark, sf):
    """Parents whose set of children differs between two snapshots."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_partkey", "l_suppkey", "l_returnflag")
    shape = lambda df: df.groupBy("parent").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey"))), lambda x: F.concat(x["l_partkey"].cast("string"), F.lit(":"), x["l_suppkey"].cast("string"))), ",").cast("binary")).alias("h"))
    a, b = shape(rows), shape(rows.where("l_returnflag <> 'R'")).withColumnRenamed("h", "h2")
    return a.join(b, "parent", "full_outer").where(~F.col("h").eqNullSafe(F.col("h2"))).select("parent")


@register(
    "f10_retention",
    f"""WITH {B.USER_VERSIONS}, {B.CURRENT}, keep AS (SELECT ref, max(version) AS version FROM user_versions GROUP BY ref UNION SELECT ref, version FROM current_versions WHERE version IS NOT NULL)
SELECT v.ref, v.version FROM user_versions v WHERE created_at < TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM keep k WHERE k.ref = v.ref AND k.version = v.version)""",
)
def f10(spark, sf):
    return V.expired(B.user_versions(spark, sf), F.expr("timestamp_ntz'2024-01-20'"), _current(spark, sf)).select("ref", "version")


@register("f12_dirty", f"WITH {B.USER_VERSIONS}, {B.CURRENT} SELECT ref FROM current_versions WHERE version IS NULL")
def f12(spark, sf):
    v = B.user_versions(spark, sf)
    return V.dirty(v.select("kind", "ref").distinct(), _current(spark, sf)).select("ref")


@register(
    "x16_transitions",
    """SELECT a.status, b.event, CASE WHEN a.status = 'gone' THEN 'corrupt' ELSE coalesce(t.next_status, a.status) END AS next_status
FROM (VALUES ('ok'), ('stale'), ('pending'), ('oversized_warn'), ('oversized_hard'), ('corrupt'), ('gone')) a(status) CROSS JOIN (VALUES ('llm_success'), ('llm_failure'), ('parse_failure'), ('mark_stale'), ('rewrite_success'), ('other')) b(event)
LEFT JOIN (VALUES ('pending', 'llm_success', 'ok'), ('pending', 'llm_failure', 'pending'), ('pending', 'parse_failure', 'corrupt'), ('ok', 'mark_stale', 'stale'), ('ok', 'parse_failure', 'corrupt'), ('stale', 'rewrite_success', 'ok'), ('stale', 'llm_failure', 'pending'), ('oversized_warn', 'mark_stale', 'stale'), ('oversized_hard', 'mark_stale', 'stale')) t(status, event, next_status) ON t.status = a.status AND t.event = b.event""",
)
def x16(spark, sf):
    """Every status, an unknown one too, with every event and an undefined one."""
    one = spark.range(1).select(F.explode(F.array(*map(F.lit, (*V.STATUSES, "gone")))).alias("status"))
    both = one.select("status", F.explode(F.array(*map(F.lit, (*sorted({e for _, e in V.TRANSITIONS}), "other")))).alias("event"))
    return both.withColumn("next_status", V.transition(F.col("status"), F.col("event")))


@register(
    "k13_generation",
    """SELECT conv_id, turn, role, CASE WHEN turn % 5 = 0 THEN 'pending' WHEN turn % 5 = 1 THEN 'corrupt' WHEN length(text) <= 240 THEN 'ok' WHEN length(text) <= 300 THEN 'oversized_warn' WHEN turn % 5 = 2 THEN 'ok' WHEN turn % 5 = 3 THEN 'corrupt' ELSE 'oversized_hard' END AS status FROM conversations""",
)
def k13(spark, sf):
    """Answers that fail, aren't JSON, or hold a turn's text; the next answer is short, has no text, or isn't JSON."""
    c, k = table(spark, sf, "conversations"), F.col("turn") % 5
    whole = F.to_json(F.struct(F.lit("s").alias("short"), F.col("text").alias("full")))
    first = F.when(k == 0, "Error: busy").when(k == 1, "oops").otherwise(whole)
    second = F.when(k == 2, '{"short":"s"}').when(k == 3, '{"full":"s"}').otherwise("oops")
    return c.select("conv_id", "turn", "role", V.generated(F.array(first, second), 200)["status"].alias("status"))


@register(
    "x15_length_verdict",
    "SELECT conv_id, turn, role, CASE WHEN length(text) <= 240 THEN 'ok' WHEN length(text) <= 300 THEN 'oversized_warn' ELSE 'oversized_hard' END AS verdict FROM conversations",
)
def x15(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", V.length_verdict(F.lit(""), F.col("text"), 200).alias("verdict"))


@register("a2_latest", "SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS day, max(event_id) AS latest FROM events GROUP BY user_id")
def a2(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.substring(F.max("ts").cast("string"), 1, 10).alias("day"), F.max("event_id").alias("latest"))


@register(
    "a3_counts_and_duplicates",
    "SELECT 'kinds' AS finding, event_type AS key, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'duplicates', l_orderkey || '/' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 2",
)
def a3(spark, sf):
    kinds = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n")).select(F.lit("kinds").alias("finding"), "key", "n")
    twice = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 2")
    return kinds.unionByName(twice.select(F.lit("duplicates").alias("finding"), F.concat("l_orderkey", F.lit("/"), "l_linenumber").alias("key"), "n"))


@register(
    "a18_scan_status",
    "SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'success' WHEN count(*) FILTER (event_type IN ('click', 'purchase')) > 0 THEN 'partial' ELSE 'failed' END AS status FROM events GROUP BY user_id",
)
def a18(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("e"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("s"))
    return n.select("user_id", F.when(F.col("e") == 0, "success").when(F.col("s") > 0, "partial").otherwise("failed").alias("status"))
