"""Differences of snapshots and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """``(key..., finding, column, left_value, right_value)``: rows of one side only, and unequal columns, nulls as values."""
    a = left.select(*key, *(F.col(c).cast("string").alias(f"l_{c}") for c in columns), F.lit(1).alias("in_l"))
    b = right.select(*key, *(F.col(c).cast("string").alias(f"r_{c}") for c in columns), F.lit(1).alias("in_r"))
    both = a.join(b, key, "full_outer")
    items = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left_value"), F.col(f"r_{c}").alias("right_value")) for c in columns))
    unequal = F.filter(items, lambda x: ~x["left_value"].eqNullSafe(x["right_value"]))
    none = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    found = F.when(F.col("in_l").isNull(), "only_right").when(F.col("in_r").isNull(), "only_left").otherwise("changed")
    rows = both.select(*key, found.alias("finding"), F.explode(F.when(F.col("in_l").isNull() | F.col("in_r").isNull(), none).otherwise(unequal)).alias("x"))
    return rows.select(*key, "finding", "x.*")


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with how often, that one side has more of."""
    columns = left.columns
    one, other = left.exceptAll(right).withColumn("side", F.lit("left")), right.select(*columns).exceptAll(left).withColumn("side", F.lit("right"))
    return one.unionByName(other).groupBy("side", *columns).agg(F.count("*").alias("surplus"))


#: Kinds of findings, and those that block (fixed values).
FINDINGS = ("missing_row", "extra_row", "field_modified", "inferred_edge", "allowed_diff")
BLOCKING = ("missing_row", "extra_row", "field_modified", "inferred_edge")


def classified_diff(left: DataFrame, right: DataFrame, key: list[str], exact: list[str], allowed: list[str] = []) -> DataFrame:  # noqa: B006
    """``(key..., category, column, left_value, right_value, blocking)``: ``diff`` of two snapshots with a key, by category.
    Differences in ``allowed`` columns are reported, but don't block."""
    found = diff(left, right, key, [*exact, *allowed])
    category = F.when(F.col("finding") == "only_left", "missing_row").when(F.col("finding") == "only_right", "extra_row").when(F.col("column").isin(*allowed), "allowed_diff").otherwise("field_modified")
    return found.select(*key, category.alias("category"), "column", "left_value", "right_value").withColumn("blocking", F.col("category").isin(*BLOCKING))


def classified_surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(columns..., category, n, blocking)``: rows without a key that one snapshot has more of. Derived edges - provenance
    ``inferred``, or a ``synthesized_from`` - are a category of their own, which blocks like the others."""
    rows = multiset_diff(left, right)
    derived = F.lit(False)
    if "provenance" in left.columns:
        derived = F.coalesce(F.col("provenance") == "inferred", F.lit(False))
        if "synthesized_from" in left.columns:
            derived = derived | F.col("synthesized_from").isNotNull()
    category = F.when(derived, "inferred_edge").when(F.col("side") == "left", "missing_row").otherwise("extra_row")
    return rows.select(*left.columns, "side", category.alias("category"), F.col("surplus").alias("n")).withColumn("blocking", F.col("category").isin(*BLOCKING))


def same_environment(left: dict, right: dict, anyway: bool = False) -> list[str]:
    """The fields in which two snapshots' environments differ; an error unless compared ``anyway``."""
    apart = sorted(k for k in {*left, *right} if left.get(k) != right.get(k))
    if apart and not anyway:
        raise ValueError("the environments differ: " + ", ".join(apart))
    return apart


def set_scores(tasks: DataFrame, expected: DataFrame, predicted: DataFrame, group: str = "task", item: str = "item") -> DataFrame:
    """``(group, matched, recall, precision, f1)`` of the sets of each of ``tasks(group)``: both empty is 1, one empty is 0."""
    e, p = expected.select(group, item).distinct().withColumn("e", F.lit(1)), predicted.select(group, item).distinct().withColumn("p", F.lit(1))
    n = e.join(p, [group, item], "full_outer").groupBy(group).agg(F.count_if(F.expr("e = 1 and p = 1")).alias("matched"), F.count("e").alias("expected"), F.count("p").alias("predicted"))
    n = tasks.select(group).distinct().join(n, group, "left").na.fill(0, ["matched", "expected", "predicted"])
    none = (F.col("expected") == 0) & (F.col("predicted") == 0)
    share = lambda of: F.when(none, F.lit(1.0)).otherwise(F.coalesce(F.try_divide("matched", of), F.lit(0.0)))
    recall, precision = share("expected"), share("predicted")
    f1 = F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
    return n.select(group, "matched", F.round(recall, 4).alias("recall"), F.round(precision, 4).alias("precision"), F.round(f1, 4).alias("f1"))


def ranked_scores(ranked: DataFrame, relevant: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``(task, recall_at_k..., reciprocal_rank)`` over tasks with relevant items; ``ranked`` is ``(task, item, rank)``."""
    both = relevant.select("task", "item").distinct().join(ranked, ["task", "item"], "left")
    size = F.count("*")
    return both.groupBy("task").agg(*(F.round(F.count_if(F.col("rank") <= k) / size, 4).alias(f"recall_at_{k}") for k in cuts), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 4).alias("reciprocal_rank"))


def overall(tasks: DataFrame, scores: DataFrame) -> DataFrame:
    """One row of means over the tasks that have scores, and of how often an empty or a failed answer was expected and given.
    ``tasks`` is ``(task, expected_empty, expected_error, results, failed)``; a share of no tasks is null."""
    means = [F.avg(c).alias(f"mean_{c}") for c in scores.columns if c != "task"]
    both = tasks.join(scores, "task", "left")
    empty, error = F.col("expected_empty") & ~F.col("expected_error"), F.col("expected_error")
    rate = lambda hit, of: F.try_divide(F.count_if(hit & of), F.count_if(of))
    return both.agg(
        F.count(scores.columns[1]).alias("eligible"), *means, rate(F.col("results") == 0, ~F.col("failed")).alias("no_result_rate"),
        F.count_if(empty).alias("empty_tasks"), rate(F.col("results") == 0, empty).alias("empty_accuracy"), F.count_if(error).alias("error_tasks"), rate(F.col("failed"), error).alias("error_accuracy"),
    )


def nearest_rank(column: str, p: float) -> Column:
    """The nearest-rank percentile of an aggregate's values: an observed value, never one between."""
    return F.expr(f"percentile_disc({p}) within group (order by `{column}`)")


def median_gain(records: DataFrame) -> DataFrame:
    """``(tier, median_a, median_b, gain, tasks, answered_a, answered_b)``: medians over repetitions of
    ``(tier, task, arm, value)`` for each task and arm, then over tasks and over the differences between both arms, and the
    share of repetitions with a value. The row of tier ``overall`` is over all tasks."""
    per = records.groupBy("tier", "task", "arm").agg(F.median("value").alias("m"), F.count("value").alias("given"), F.count("*").alias("n"))
    arm = lambda f, name, c: f(F.when(F.col("arm") == name, F.col(c)))
    pair = per.groupBy("tier", "task").agg(arm(F.max, "A", "m").alias("a"), arm(F.max, "B", "m").alias("b"), *(F.coalesce(arm(F.sum, x, c), F.lit(0)).alias(f"{c}_{x}") for x in "AB" for c in ("given", "n")))
    every = pair.unionByName(pair.withColumn("tier", F.lit("overall")))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    middle = lambda c: F.round(F.median(F.when(both, c)), 4)
    share = lambda x: F.round(F.try_divide(F.sum(f"given_{x}"), F.sum(f"n_{x}")), 4)
    out = every.groupBy("tier").agg(middle(F.col("a")).alias("median_a"), middle(F.col("b")).alias("median_b"), middle(F.col("b") - F.col("a")).alias("gain"), F.count_if(both).alias("tasks"), share("A").alias("answered_a"), share("B").alias("answered_b"))
    return out.where("tasks > 0")


def compare_baselines(now: DataFrame, before: DataFrame, intended: DataFrame) -> DataFrame:
    """``(task, class)`` over ``(task, value)``: new_task, unchanged, intentional_contract_change or behavior_change; what is
    intended counts whether it changed or not."""
    both = now.select("task", F.col("value").alias("now")).join(before.select("task", F.col("value").alias("before"), F.lit(1).alias("old")), "task", "left").join(intended.select("task", F.lit(1).alias("meant")).distinct(), "task", "left")
    return both.select("task", F.when(F.col("old").isNull(), "new_task").when(F.col("meant") == 1, "intentional_contract_change").when(F.col("now").eqNullSafe(F.col("before")), "unchanged").otherwise("behavior_change").alias("class"))


def cross_references(findings: DataFrame) -> DataFrame:
    """``(target, sections)`` of targets that at least two sections name."""
    return findings.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"), F.count_distinct("section").alias("n")).where("n >= 2").drop("n")


def budget_prefix(lines: DataFrame, group: str, order: str, text: str, most: int) -> DataFrame:
    """Lines of each group, in order, until the first that exceeds the budget of characters, one added for each line."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("used", F.sum(F.length(text) + 1).over(w)).where(F.col("used") <= most)
