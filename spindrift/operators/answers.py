"""The read queries as typed tables, and the parsing and checking of answers from outside."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIMIT = 50
#: What a judge may name as the ground of a verdict, and how sure it may be (fixed values).
DIMENSIONS = (
    "signature", "error_contract", "side_effects", "concurrency", "resource_lifecycle",
    "complexity_tier", "security", "data_contract", "internal_refactor", "rename",
    "extract_inline", "comment_only", "test_only", "log_only", "ambiguous",
)
CONFIDENCES = ("high", "medium", "low")
CAREFUL = "No verdict, or none that is valid: taken as a change."
KINDS = ("symbol", "file", "cluster")


def symbol(symbols: DataFrame, current: DataFrame, name: str, file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Symbols ``(ref, name, short_name, file, line)`` of a name or short name, in one file on demand, with their current
    summary."""
    found = symbols.where((F.col("name") == name) | (F.col("short_name") == name))
    found = found if file is None else found.where(F.col("file") == file)
    return found.orderBy("file", "name", "ref").limit(limit).join(current.select("ref", "version", "summary"), "ref", "left")


def file_summary(symbols: DataFrame, current: DataFrame, file: str, limit: int = LIMIT) -> DataFrame:
    """A file's symbols in the order of their lines."""
    return symbols.where(F.col("file") == file).orderBy("line", "name", "ref").limit(limit).join(current.select("ref", "version", "summary"), "ref", "left")


def patterns(rows: DataFrame, **filters) -> DataFrame:
    """Declared patterns; filters that are None add no predicate."""
    for column, value in filters.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def clusters(members: DataFrame, labels: DataFrame, name: str | None = None) -> DataFrame:
    """Clusters by size, then name, with their label."""
    sized = members.groupBy("cluster").agg(F.count("*").alias("files"))
    sized = sized if name is None else sized.where(F.col("cluster") == name)
    return sized.join(labels, "cluster", "left").orderBy(F.desc("files"), "cluster")


def navigate(candidates: DataFrame, top: int = 5) -> DataFrame:
    """Candidates ``(kind, ref, rank)`` by kind, then rank."""
    order = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    return candidates.withColumn("o", order).orderBy("o", "rank", "ref").limit(top).drop("o")


def projection_counts(projected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(kind, expected, found, duplicates)``: whether every node has one document."""
    have = projected.groupBy("kind", "ref").agg(F.count("*").alias("n")).groupBy("kind").agg(F.count("*").alias("found"), F.count_if(F.col("n") > 1).alias("duplicates"))
    want = nodes.groupBy("kind").agg(F.count_distinct("ref").alias("expected"))
    return want.join(have, "kind", "full_outer").select("kind", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("expected", "found", "duplicates")))


def history(versions: DataFrame, ref) -> DataFrame:
    """All versions of one node, newest first."""
    return versions.where(F.col("ref") == ref).orderBy(F.desc("version"))


def answer_items(answer: Column, prefix: str = "", tag: str = "answer") -> Column:
    """The items ``(name, path)`` that an answer asserts, normalised and distinct.

    Each line of the first block fenced by three backticks and ``tag`` is ``name|path``, or a name alone. Without such a block,
    each line of prose that holds ``name|path``, or one path to a Python file and a name between backticks, gives an item."""
    nothing = F.array().cast("array<struct<name:string,path:string>>")
    item = lambda name, path: F.struct(normal_name(name).alias("name"), normal_path(path, prefix).alias("path"))
    fence = rf"(?s)```{re.escape(tag)}\s*\n(.*?)```"
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^`+|`+$", ""))

    def listed(line: Column) -> Column:
        return item(F.split_part(line, F.lit("|"), F.lit(1)), F.when(F.contains(line, F.lit("|")), F.regexp_extract(line, r"(?s)^[^|]*\|(.*)$", 1)).otherwise(F.lit("")))

    lines = F.transform(F.split(F.regexp_extract(answer, fence, 1), r"\r\n|\r|\n"), bare)
    block = F.transform(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit(tag))), listed)

    word, piped = r"[A-Za-z_][\w.]*(?:::[\w.]+)?", r"([A-Za-z_][\w.]*(?:::[\w.]+)?)\s*\|\s*([^\s|`]+)"

    def said(line: Column) -> Column:
        paths = F.regexp_extract_all(line, F.lit(r"([\w./\\-]+\.py)"), F.lit(1))
        names = F.filter(F.regexp_extract_all(line, F.lit(r"`([^`]+)`"), F.lit(1)), lambda x: ~F.endswith(x, F.lit(".py")) & x.rlike(rf"^(?:{word})$"))
        alone = F.when((F.size(paths) == 1) & (F.size(names) > 0), item(names[0], paths[0]))
        return F.when(line.rlike(piped), item(F.regexp_extract(line, piped, 1), F.regexp_extract(line, piped, 2))).otherwise(alone)

    prose = F.array_compact(F.transform(F.split(answer, r"\r\n|\r|\n"), said))
    found = F.filter(F.when(answer.rlike(fence), block).otherwise(prose), lambda x: x["name"] != "")
    return F.coalesce(F.array_distinct(found), nothing)


def normal_name(name: Column) -> Column:
    """A bare name: without quoting, arguments and what qualifies it."""
    s = F.trim(F.regexp_replace(F.trim(name), r"^[`*]+|[`*]+$", ""))
    s = F.trim(F.regexp_extract(s, r"(?s)^([^(]*)", 1))
    return F.trim(F.element_at(F.split(F.replace(s, F.lit("::"), F.lit(".")), r"\."), -1))


def normal_path(path: Column, prefix: str = "") -> Column:
    """A relative path in lower case with slashes, without leading ``./`` and slashes and without the prefix."""
    s = F.lower(F.replace(F.trim(F.coalesce(path, F.lit(""))), F.lit("\\"), F.lit("/")))
    s = F.regexp_replace(F.regexp_replace(s, r"^(?:\./)+", ""), r"^/+", "")
    head = prefix.strip("/").lower() + "/"
    return F.when(F.startswith(s, F.lit(head)), F.substring(s, len(head) + 1, 1 << 30)).otherwise(s) if prefix else s


def clamped_scores(raw: Column) -> Column:
    """``score`` of each item of a JSON list, kept between 0 and 1; null for what isn't one."""
    items = F.from_json(raw, "array<struct<ref:string,score:double>>")
    return F.transform(items, lambda x: F.struct(x["ref"].alias("ref"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["score"])).alias("score")))


def verdict(raw: Column) -> Column:
    """A judge's verdict ``(propagate, rationale, matched_dimension, confidence)`` if all four fields are there, of their types
    and known; else the careful one, to propagate."""
    v = F.try_parse_json(raw)
    field = lambda name, kind: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind.upper(), F.try_variant_get(v, f"$.{name}", kind.lower()))
    propagate, rationale = field("propagate", "boolean"), field("rationale", "string")
    dimension, confidence = field("matched_dimension", "string"), field("confidence", "string")
    good = propagate.isNotNull() & rationale.isNotNull() & dimension.isin(*DIMENSIONS) & confidence.isin(*CONFIDENCES)
    given = F.struct(propagate.alias("propagate"), rationale.alias("rationale"), dimension.alias("matched_dimension"), confidence.alias("confidence"))
    careful = F.struct(F.lit(True).alias("propagate"), F.lit(CAREFUL).alias("rationale"), F.lit("ambiguous").alias("matched_dimension"), F.lit("low").alias("confidence"))
    return F.when(F.coalesce(good, F.lit(False)), given).otherwise(careful)


def indicators(files: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``(project, layers)``: the names of those rules whose pattern some path of a project fits."""
    hits = F.array_compact(F.array(*(F.when(F.col("path").rlike(r), F.lit(n)) for n, r in rules.items())))
    return files.select("project", F.explode(hits).alias("layer")).groupBy("project").agg(F.array_join(F.array_sort(F.collect_set("layer")), ",").alias("layers"))


def cache_key(intent: Column, top: int, candidates: Column, template: str = "1") -> Column:
    """Key of a request: sha256 of its JSON with sorted keys, no blanks, the intent in lower case with single blanks, and each
    candidate ``(kind, ref, hash)`` as a list of three."""
    text = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    listed = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("["), text(c["kind"]), F.lit(","), text(c["ref"]), F.lit(","), text(F.coalesce(c["hash"], F.lit(""))), F.lit("]"))), ",")
    plain = F.lower(F.trim(F.regexp_replace(intent, r"\s+", " ")))
    whole = F.concat(F.lit('{"candidates":['), listed, F.lit('],"intent":'), text(plain), F.lit(',"template":'), text(F.lit(template)), F.lit(f',"top_k":{top}}}'))
    return F.concat(F.lit("navigate:"), F.sha2(whole, 256))


def _bare(source: str) -> str:
    """One definition's source as its hash sees it, by its syntax tree: without its docstring, and without what follows a ``#``
    on any line, strings included. Source that can't be parsed keeps its strings."""
    try:
        first = ast.parse(source).body[0]
        doc = first.body[0] if isinstance(first, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None
        if isinstance(doc, ast.Expr) and isinstance(doc.value, ast.Constant) and isinstance(doc.value.value, str):
            data, lines = source.encode(), [0]
            for line in source.encode().splitlines(keepends=True):
                lines.append(lines[-1] + len(line))
            start, end = lines[doc.value.lineno - 1] + doc.value.col_offset, lines[doc.value.end_lineno - 1] + doc.value.end_col_offset
            source = (data[:start] + data[end:]).decode()
    except (SyntaxError, ValueError, IndexError, AttributeError, RecursionError):
        pass
    return re.sub(r"#[^\n]*", "", source)


@F.pandas_udf(StringType())
def strip_docstrings(source: pd.Series) -> pd.Series:
    """Definitions without docstrings and comments, as symbol hashes want them; the syntax tree needs Python."""
    return source.map(_bare, na_action="ignore")


def best_by_group(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("k") <= most).drop("k")
