"""URL filters: host and path rules, indexed by their rarest literal token.

A rule such as ``example.org/es/`` fits its host and all subdomains where the url's path starts with the rule's. Its literal
tokens are its host labels and those path segments that it closes with a slash. Each rule is filed under the token that the
fewest urls hold; a url's own tokens fetch the rules filed under them, and only those rules' regular expressions run. All
work is done by DataFrame functions.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules up to this number are broadcast; more are joined by shuffling.
BROADCAST_RULES = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def _labels(text: Column, mark: str, sep: str) -> Column:
    return F.transform(F.filter(F.split(text, sep), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))


def _rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(priority, rule, verdict, host, path, pattern, tokens)``; a higher priority is a longer rule."""
    seen: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        host, slash, path = rule.partition("/")
        rule = host.lower() + slash + path
        seen[rule] = "block" if "block" in (verdict, seen.get(rule)) else verdict
    ordered = sorted(seen.items(), key=lambda x: (len(x[0]), x[0]))
    if not ordered:
        ordered = [("\x00", "allow")]  # fits nothing
    rows = json.dumps([{"priority": i, "rule": r, "verdict": v} for i, (r, v) in enumerate(ordered)])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(rows), "array<struct<priority:int,rule:string,verdict:string>>")))
    host = F.substring_index("rule", "/", 1)
    table = table.withColumn("host", host).withColumn("path", F.expr("substring(rule, length(host) + 1)"))
    quoted = lambda c: F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    table = table.withColumn("pattern", F.concat(F.lit("(?s)^(?:[^/]*\\.)?"), quoted("host"), quoted("path")))
    closed = F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)
    tokens = F.concat(F.array(F.lit("*")), _labels(F.col("host"), "h:", r"\."), _labels(closed, "p:", "/"))
    return table.withColumn("tokens", F.array_distinct(tokens))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", url: str = "url", id: str = "page_id") -> DataFrame:
    """``(id, url, host, path, rule, verdict)``, one row for each row of ``pages``.

    ``rules`` are (verdict, rule) pairs. Of the rules that fit, the longest wins, of equally long ones the last by name; without one, ``rule`` is null and the
    verdict is ``default``. A rule listed with both verdicts blocks. Null urls and urls without ``://`` have an empty host
    and path, which only a rule with an empty host can fit. Urls of any length are taken whole. Repeated rows and null ids are returned as often as they occur;
    an empty table gives an empty result; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    few = len(rules) <= BROADCAST_RULES
    small = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    table = _rule_table(spark, rules)
    u = F.col("url")
    base = pages.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url")).select("id", "url", host_of(u).alias("host"), path_of(u).alias("path"))
    base = base.withColumn("tokens", F.array_distinct(F.concat(F.array(F.lit("*")), _labels(F.col("host"), "h:", r"\."), _labels(F.col("path"), "p:", "/"))))

    # how many urls hold each token of a rule
    of_rules = table.select("priority", F.explode("tokens").alias("token"))
    counts = base.select(F.explode("tokens").alias("token")).join(small(of_rules.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("urls"))
    rarity = of_rules.join(counts, "token", "left").select("priority", "token", F.when(F.col("token") == "*", F.lit((1 << 62))).otherwise(F.coalesce("urls", F.lit(0))).alias("urls"))
    rarest = rarity.groupBy("priority").agg(F.min(F.struct("urls", "token")).alias("m")).select("priority", F.col("m.token").alias("token"))
    index = rarest.join(table.select("priority", "pattern", F.col("host").alias("suffix"), F.col("path").alias("start")), "priority").groupBy("token").agg(F.collect_list(F.struct("priority", "pattern", "suffix", "start")).alias("rules"))

    fetched = base.select("id", "url", "host", "path", F.posexplode("tokens").alias("pos", "token")).join(small(index), "token", "left")
    target = F.concat("host", "path")
    # a regular expression is compiled anew for each rule, so it runs last
    fits = F.filter("rules", lambda r: F.endswith(F.col("host"), r["suffix"]) & F.startswith(F.col("path"), r["start"]) & F.regexp_like(target, r["pattern"]))
    best = fetched.withColumn("p", F.array_max(F.transform(fits, lambda r: r["priority"])))
    best = best.groupBy("id", "url", "host", "path").agg(F.max("p").alias("priority"), F.count_if(F.col("pos") == 0).alias("copies"))
    named = best.join(small(table.select("priority", "rule", "verdict")), "priority", "left")
    named = named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return named.select(F.col("id").alias(id), F.col("url").alias(url), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
