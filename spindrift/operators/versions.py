"""Append-only version histories: what is current, what changed, and what must be written anew.

Versions are ``(kind, ref, version, status, summary, created_at)`` with ``summary`` a JSON object that has ``short``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

USABLE = ("ok", "oversized_warn")
#: Next status by status and event (fixed values); any other event leaves a status as it is, unknown statuses are corrupt.
TRANSITIONS = {
    ("pending", "llm_success"): "ok",
    ("pending", "llm_failure"): "pending",
    ("pending", "parse_failure"): "corrupt",
    ("ok", "mark_stale"): "stale",
    ("ok", "parse_failure"): "corrupt",
    ("stale", "rewrite_success"): "ok",
    ("stale", "llm_failure"): "pending",
    ("oversized_warn", "mark_stale"): "stale",
    ("oversized_hard", "mark_stale"): "stale",
}
STATUSES = ("pending", "ok", "stale", "corrupt", "oversized_warn", "oversized_hard")
_KEY = ("kind", "ref")


def short_text(summary: Column) -> Column:
    """The short summary; null where the JSON is bad, it isn't a string or it is blank."""
    parsed = F.from_json(summary, "short STRING")["short"]
    raw = F.get_json_object(summary, "$.short")
    return F.when(parsed.isNotNull() & raw.isNotNull() & (F.trim(parsed) != ""), parsed)


def current(versions: DataFrame, usable: Column | None = None) -> DataFrame:
    """``(kind, ref, version, summary, latest_status)`` for every node: the greatest usable version that no stale version
    stands above; null where there is none. ``usable`` is what a version's summary must satisfy, a short text by default."""
    newest = Window.partitionBy(*_KEY).orderBy(F.desc("version")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = F.col("status").isin(*USABLE) & (short_text(F.col("summary")).isNotNull() if usable is None else usable)
    seen = versions.withColumn("barrier", F.max(F.col("status") == "stale").over(newest)).withColumn("latest_status", F.first("status").over(newest))
    taken = F.when(good & ~F.col("barrier"), F.col("version"))
    return seen.withColumn("v", taken).groupBy(*_KEY).agg(F.max("v").alias("version"), F.max_by("summary", "v").alias("summary"), F.any_value("latest_status").alias("latest_status"))


def next_version(versions: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Version numbers for new rows of ``(kind, ref)``, counting on from each node's last."""
    last = versions.groupBy(*_KEY).agg(F.max("version").alias("last"))
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(order))
    return new.withColumn("rank", rank).join(last, list(_KEY), "left").withColumn("version", F.coalesce("last", F.lit(0)) + F.col("rank")).drop("rank", "last")


def previous(versions: DataFrame) -> DataFrame:
    """Each version with the summary of the one before, whatever its status."""
    w = Window.partitionBy(*_KEY).orderBy("version")
    return versions.withColumn("previous_version", F.lag("version").over(w)).withColumn("previous_summary", F.lag("summary").over(w))


def child_changes(versions: DataFrame, parents: DataFrame, usable: Column | None = None) -> DataFrame:
    """``(parent, ref, before, after)``: children whose current summary differs from the version before it. ``parents`` is
    ``(kind, ref, parent)``."""
    now = current(versions, usable).where(F.col("version").isNotNull())
    before = previous(versions).select(*_KEY, "version", "previous_summary")
    both = now.join(before, [*_KEY, "version"]).where(~F.col("summary").eqNullSafe(F.col("previous_summary")))
    return both.join(parents, list(_KEY)).select("parent", "ref", F.col("previous_summary").alias("before"), F.col("summary").alias("after"))


def same_summary(now: Column, before: Column) -> Column:
    """Whether two summaries are the same text or the same JSON value; a missing one is like no other."""
    canonical = lambda x: F.to_json(F.try_parse_json(x))
    return now.isNotNull() & before.isNotNull() & ((now == before) | F.coalesce(canonical(now) == canonical(before), F.lit(False)))


def change_counters(versions: DataFrame, parents: DataFrame, usable_parents: DataFrame) -> DataFrame:
    """``(parent, changes)``: usable versions of children that differ from the one before, whatever its status, for parents
    with a usable summary. A first version and one after a version without summary are changes."""
    changed = previous(versions).where(F.col("status").isin(*USABLE) & ~same_summary(F.col("summary"), F.col("previous_summary")))
    return changed.join(parents, list(_KEY)).join(usable_parents, "parent", "left_semi").groupBy("parent").agg(F.count("*").alias("changes"))


def decide(counters: DataFrame, primary: int = 50, backup: int = 0, days: int = 30) -> DataFrame:
    """``decision`` for parents ``(parent, changes, leaves, age_days, real_changes, judged)``: forced rewrite first, then
    nothing to do, then the judgement. A threshold of 0 or less switches its test off."""
    forced = F.lit(False)
    for column, least in (("changes", primary), ("leaves", backup), ("age_days", days)):
        if least > 0:
            forced = forced | F.coalesce(F.col(column) >= least, F.lit(False))
    return counters.withColumn("decision", F.when(forced, "force").when(F.col("real_changes") == 0, "reset").when(F.col("judged"), "rewrite").otherwise("keep"))


def generated(answers: Column, limit: int) -> Column:
    """``(payload, status)`` from an array of a model's answers in the order of calls: the first, one more where that has no
    short text, and one more where the text is over 1.5 times the limit.

    No answer, or one that begins with ``Error:``, leaves the node pending; what isn't JSON, or lacks a short text twice, is
    corrupt. A text up to 1.2 times the limit is ok and one up to 1.5 times is kept with a warning. A longer one is replaced by
    the last answer: if that is JSON without a short text it is corrupt, up to 1.2 times the limit ok, else oversized_hard;
    without a last answer the first text stays, as oversized_hard."""
    answer = lambda k: F.try_element_at(answers, F.lit(k))
    parsed = lambda x: F.when(~F.startswith(x, F.lit("Error:")), F.try_parse_json(x))
    kind = lambda v, path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = lambda v, path: F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))
    has = lambda v: F.coalesce(F.trim(text(v, "$.short")) != "", F.lit(False))
    size = lambda v: F.greatest(F.coalesce(F.length(text(v, "$.short")), F.lit(0)), F.coalesce(F.length(text(v, "$.full")), F.lit(0)))
    out = lambda payload, status: F.struct(payload.alias("payload"), F.lit(status).alias("status"))
    none = F.lit(None).cast("string")

    def judged(v: Column, raw: Column, last: Column) -> Column:
        then = parsed(last)
        longer = F.when(then.isNull(), out(raw, "oversized_hard")).when(~has(then), out(none, "corrupt")).when(size(then) <= 1.2 * limit, out(last, "ok")).otherwise(out(last, "oversized_hard"))
        return F.when(size(v) <= 1.2 * limit, out(raw, "ok")).when(size(v) <= 1.5 * limit, out(raw, "oversized_warn")).otherwise(longer)

    one, two = parsed(answer(1)), parsed(answer(2))
    failed = answer(1).isNull() | F.startswith(answer(1), F.lit("Error:"))
    again = F.when(two.isNull() | ~has(two), out(none, "corrupt")).otherwise(judged(two, answer(2), answer(3)))
    return F.when(failed, out(none, "pending")).when(one.isNull(), out(none, "corrupt")).when(~has(one), again).otherwise(judged(one, answer(1), answer(2)))


def transition(status: Column, event: Column) -> Column:
    """Next status; an unknown status is corrupt, an undefined event changes nothing."""
    out = F.when(~status.isin(*STATUSES) | status.isNull(), "corrupt")
    for (s, e), to in TRANSITIONS.items():
        out = out.when((status == s) & (event == e), to)
    return out.otherwise(status)


def length_verdict(short: Column, full: Column, limit: int) -> Column:
    """By the longer of both texts: up to 1.2 times the limit ok, up to 1.5 times a warning, else too long."""
    size = F.greatest(F.coalesce(F.length(short), F.lit(0)), F.coalesce(F.length(full), F.lit(0)))
    return F.when(size <= 1.2 * limit, "ok").when(size <= 1.5 * limit, "oversized_warn").otherwise("oversized_hard")


def expired(versions: DataFrame, cutoff, protected_current: DataFrame) -> DataFrame:
    """Versions to delete: made before the cutoff, neither a node's latest nor a current one ``(kind, ref, version)``."""
    latest = versions.groupBy(*_KEY).agg(F.max("version").alias("version"))
    keep = latest.unionByName(protected_current.where(F.col("version").isNotNull()).select(*_KEY, "version")).distinct()
    return versions.where(F.col("created_at") < cutoff).join(keep, [*_KEY, "version"], "left_anti")


def dirty(nodes: DataFrame, now: DataFrame) -> DataFrame:
    """Nodes ``(kind, ref)`` without a usable current version."""
    return nodes.join(now.where(F.col("version").isNotNull()), list(_KEY), "left_anti")
