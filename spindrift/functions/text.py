"""Scalar text functions, all of them built from Spark's own expressions but for the fuzzy ratio."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: White space that source hashes ignore: what Unicode and ASCII separators count as such (fixed values).
_BLANKS = r"[\s\x1c-\x1f\x85   -     　]+"


#: How symbol names fall into words (fixed values): pattern and replacement, one after the other.
_SPLITS = ((r"_|::", " "), (r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (_BLANKS, " "))


def tokenize_symbol(name: Column) -> Column:
    """``getUserByID_x`` as ``get User By ID x``."""
    for pattern, by in _SPLITS:
        name = F.regexp_replace(name, pattern, by)
    return F.trim(name)


def words_of(text: str) -> list[str]:
    """``search_words`` of a query's text, on the driver."""
    for pattern, by in _SPLITS:
        text = re.sub(pattern, by.replace("$", "\\"), text)
    out, word = [], ""
    for c in [*text, " "]:
        kind = unicodedata.category(c)[0]
        if kind in "LN" or kind == "M" and word:
            word += c
        elif word:
            out.append(word.lower())
            word = ""
    return out


def search_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, marks included once started."""
    return F.regexp_extract_all(F.lower(tokenize_symbol(text)), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}\p{M}]*)"), F.lit(1))


def word_prefix_count(words: Column, terms: list[str]) -> Column:
    """How many of the terms begin one of the words."""
    begins = lambda t: F.exists(words, lambda w: F.startswith(w, F.lit(t))).cast("int")
    hits = [begins(t) for t in terms]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def contains_phrase(words: Column, phrase: list[str]) -> Column:
    """Whether the words hold the phrase's words one after the other."""
    return F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " "))


def normalize_path(path: Column) -> Column:
    return F.lower(F.replace(F.trim(path), F.lit("\\"), F.lit("/")))


def symbol_hash(source: Column) -> Column:
    """md5 without any white space."""
    return F.md5(F.regexp_replace(source, _BLANKS, ""))


def file_hash(source: Column) -> Column:
    """md5 with all line ends alike."""
    return F.md5(F.regexp_replace(source, "\r\n?", "\n"))


def content_hash(**fields: Column) -> Column:
    """sha256 of the fields as JSON with sorted keys and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"}), 256)


def json_or_empty(raw: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(raw, path), F.lit(""))


def normalize_signature(args: Column) -> Column:
    return F.trim(F.regexp_replace(args, r"\s+", " "))


def format_signature(args: Column, most: int = 80) -> Column:
    """Signatures longer than ``most`` end in the number of their arguments."""
    return F.when(F.length(args) <= most, args).otherwise(F.concat(F.substring(args, 1, most), F.lit("... ("), F.size(F.split(args, ",")).cast("string"), F.lit(" args)")))


def layer_of(path: Column, layers: dict[str, list[str]], default: str = "Core") -> Column:
    """The first layer of which a lower-cased path segment is a pattern, or one with an s."""
    segments = F.split(F.lower(path), "/")
    out = None
    for name, patterns in layers.items():
        wanted = F.array(*(F.lit(p.lower() + s) for p in patterns for s in ("", "s")))
        out = (F if out is None else out).when(F.arrays_overlap(segments, wanted), name)
    return F.lit(default) if out is None else out.otherwise(default)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for whole strings."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or (c if c.isalnum() or c in "_/ " else "\\" + c)
        k += 1
    return f"(?s)^{out}$"


def _any_fits(places: Column, pattern: str) -> Column:
    return F.exists(places, lambda x: x.rlike(pattern) | F.element_at(F.split(x, "/"), -1).rlike(pattern))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern fits the base name, the path or any folder above it; ``**/`` may be left out, and a pattern that
    ends in a slash only fits folders."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = F.slice(above, 1, F.size(parts) - 1)
    tests = []
    for p in patterns:
        only_folders, bare = p.endswith("/"), p.rstrip("/")
        for one in {bare, bare.removeprefix("**/")}:
            tests.append(_any_fits(folders if only_folders else above, glob_regex(one)))
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; no built-in function measures it."""
    return pd.Series([difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def may_reach(a: Column, b: Column, cutoff: float) -> Column:
    """Whether lengths alone allow the ratio; what it rejects can't reach the cutoff."""
    return 2 * F.least(F.length(a), F.length(b)) >= cutoff * (F.length(a) + F.length(b))
