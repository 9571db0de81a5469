"""Facts from source text: symbols, calls, imports, bindings and declared patterns, one tagged row each.

A parser is a plug-in: a name, the extensions it takes, a contract version, and one function from a source to facts. Python is
parsed by the standard library's syntax tree. C-like, TypeScript and Rust sources go through one scanner: comments and strings
are blanked, declarations found by pattern, and their bodies by matching braces. A file that can't be parsed gives one row of
kind ``error`` and stops nothing.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ("path", "kind", "name", "owner", "target", "line", "end_line", "form", "meta")
FACTS = "path string, kind string, name string, owner string, target string, line int, end_line int, form string, meta string"
Fact = tuple


@dataclass(frozen=True)
class Parser:
    """``facts`` gives ``(kind, name, owner, target, line, end_line, form, meta)`` of a source. ``version`` changes with what it
    gives, so that stored facts of another version are read anew."""

    name: str
    extensions: tuple[str, ...]
    facts: Callable[[str], list[Fact]]
    version: str = "1"


class Registry:
    """Parsers by the longest extension that a file's name ends in."""

    def __init__(self, parsers: list[Parser]) -> None:
        self.by_extension: dict[str, Parser] = {}
        names = [p.name for p in parsers]
        if len({*names}) < len(names):
            raise ValueError("two parsers have one name")
        for p in parsers:
            for e in p.extensions:
                if not e.startswith(".") or e.lower() in self.by_extension:
                    raise ValueError(f"extension {e} is not one, or is taken twice")
                self.by_extension[e.lower()] = p

    def resolve(self, path: str) -> Parser | None:
        base = path.rsplit("/", 1)[-1].lower()
        fit = [e for e in self.by_extension if base.endswith(e)]
        return self.by_extension[max(fit, key=len)] if fit else None

    def languages(self) -> dict[str, str]:
        return {e: p.name for e, p in self.by_extension.items()}


def _fact(kind, name=None, owner=None, target=None, line=None, end_line=None, form=None, **meta) -> Fact:
    return kind, name, owner, target, line, end_line, form, json.dumps(meta, sort_keys=True) if meta else None


# Python


class _Python(ast.NodeVisitor):
    """Symbols are functions and classes of a module and methods of its classes; calls belong to the innermost function."""

    def __init__(self) -> None:
        self.rows: list[Fact] = []
        self.owners: list[str] = []
        self.functions: list[str] = []
        self.spans: list[tuple[int, int, str]] = []

    def _function(self, node) -> None:
        name = f"{self.owners[-1]}.{node.name}" if self.owners else node.name
        if not self.functions and len(self.owners) < 2:
            self.rows.append(_fact("function", name, self.owners[-1] if self.owners else None, None, node.lineno, node.end_lineno, None, args=f"({ast.unparse(node.args)})"))
            self.spans.append((node.lineno, node.end_lineno, name))
        self.functions.append(name)
        self.generic_visit(node)
        self.functions.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def visit_ClassDef(self, node) -> None:
        if not self.owners and not self.functions:
            self.rows.append(_fact("class", node.name, None, None, node.lineno, node.end_lineno))
        for base in node.bases:
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.rows.append(_fact("base", node.name, None, base.id if isinstance(base, ast.Name) else base.attr, node.lineno))
        self.owners.append(node.name)
        self.generic_visit(node)
        self.owners.pop()

    def visit_Call(self, node) -> None:
        form = {ast.Name: "name", ast.Attribute: "attribute"}.get(type(node.func))
        if form and self.functions:
            self.rows.append(_fact("call", None, self.functions[-1], node.func.id if form == "name" else node.func.attr, node.lineno, None, form))
        self.generic_visit(node)

    def visit_Import(self, node) -> None:
        self.rows += [_fact("import", a.asname or a.name, None, a.name, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node) -> None:
        module = "." * node.level + (node.module or "")
        self.rows += [_fact("import", a.asname or a.name, None, module, node.lineno) for a in node.names]
        if not node.level and node.module:
            self.rows.append(_fact("binding", None, None, node.module, node.lineno, names=sorted(a.asname or a.name for a in node.names)))


#: What declares, sends or takes a signal, by kind: pattern, and whether the handler is written there (fixed values).
_SIGNALS = {
    "django_signal_send": (r"(\w+)\.send\(", False),
    "django_signal_connect": (r"(\w+)\.connect\(\s*(\w+)", True),
    "pyqt_signal_emit": (r"(\w+)\.emit\(", False),
    "pyqt_signal_connect": (r"(\w+)\.connect\(\s*(?:self\.)?(\w+)", True),
    "observer_emit": (r"for\s+(\w+)\s+in\s+self\.(\w+)\s*:\s*\1\s*\(", False),
    "observer_register": (r"self\.(\w+)\.(?:append|add|insert)\(", False),
}


def _signals(source: str, spans: list[tuple[int, int, str]]) -> list[Fact]:
    """Patterns, each with the innermost function around it unless it names its handler. Those of one library count only where
    the source imports it."""
    library = "from PyQt" in source or "from PySide" in source
    out = []
    for kind, (pattern, named) in _SIGNALS.items():
        if kind.startswith("pyqt") and not library:
            continue
        for m in re.finditer(pattern, source):
            line = source.count("\n", 0, m.start()) + 1
            around = max((s for s in spans if s[0] <= line <= s[1]), default=(0, 0, None))[2]
            signal = m[2] if kind == "observer_emit" else m[1]
            out.append(_fact("pattern", signal, None, m[2] if named else around, line, None, kind))
    return out


def python_facts(source: str) -> list[Fact]:
    tree = ast.parse(source.removeprefix("\ufeff"))
    visitor = _Python()
    visitor.visit(tree)
    return visitor.rows + _signals(source, visitor.spans)


# languages with braces


def blank_comments(source: str, quotes: str = "\"'") -> str:
    """Comments and what strings hold as blanks; lines and places stay."""
    strings = "|".join(rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in quotes)
    blank = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in quotes and len(m[0]) > 1 else re.sub(r"[^\n]", " ", m[0])
    return re.sub(rf"//[^\n]*|/\*.*?\*/|{strings}", blank, source, flags=re.S)


def split_top(text: str) -> list[str]:
    """What commas outside of all brackets separate."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[k - 1 : k] != "-")
        if c == "," and depth == 0:
            out.append(text[start:k])
            start = k + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


class _Braces:
    """A blanked source with the place where each brace is closed."""

    def __init__(self, source: str, quotes: str = "\"'") -> None:
        self.text, self.raw = blank_comments(source, quotes), source
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[{}]", self.text):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def body(self, at: int) -> tuple[int, int]:
        """The next block from a place on, its braces excluded; nothing where a declaration ends first."""
        m = re.compile(r"[{;]").search(self.text, at)
        return (m.start() + 1, self.close.get(m.start(), len(self.text))) if m and m[0] == "{" else (at, at)

    def calls(self, owner: str, start: int, end: int, words: frozenset[str]) -> list[Fact]:
        """Calls within a body."""
        found = re.compile(r"(\.|->|::)?\s*\b([A-Za-z_$][\w$]*)\s*!?\(").finditer(self.text, start, end)
        return [_fact("call", None, owner, m[2], self.line(m.start(2)), None, "attribute" if m[1] in (".", "->") else "name") for m in found if m[2] not in words]


_C_WORDS = frozenset("if for while switch return sizeof else do case goto typeof defined".split())


def c_facts(source: str) -> list[Fact]:
    """Functions with their calls, structs, enums, typedefs, macros and includes; fields of structs, those that hold functions
    flagged; types of such; what is registered for a field by name or slot; and where a field is called."""
    s = _Braces(source)
    out = [_fact("import", m[1], None, m[1], s.line(m.start(1))) for m in re.finditer(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", source, re.M)]
    out += [_fact("macro", m[1], None, None, s.line(m.start(1))) for m in re.finditer(r"^\s*#\s*define\s+(\w+)", s.text, re.M)]
    out += [_fact("typedef", m[1], None, None, s.line(m.start(1)), None, "function_pointer") for m in re.finditer(r"\btypedef\b[^;{}]*?\(\s*\*\s*(\w+)\s*\)\s*\([^;]*?\)\s*;", s.text)]
    for m in re.finditer(r"\b(?:typedef\s+)?(struct|union|enum)\s*(\w*)\s*\{", s.text):
        end = s.close.get(m.end() - 1, len(s.text))
        after = re.compile(r"\s*(\w*)").match(s.text, end + 1)
        name = m[2] or (after[1] if after else "")
        if not name:
            continue
        out.append(_fact("enum" if m[1] == "enum" else "struct", name, None, None, s.line(m.start()), s.line(end)))
        if m[1] == "enum":
            continue
        for slot, item in enumerate(x.strip() for x in s.text[m.end() : end].split(";") if x.strip()):
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)\s*\(", item)
            plain = re.search(r"^(.*?)[\s*]+(\w+)\s*(?:\[[^\]]*\])?$", item, re.S)
            if pointer or plain:
                out.append(_fact("field", pointer[1] if pointer else plain[2], name, None if pointer else " ".join(plain[1].split()), s.line(m.start()), None, "function_pointer" if pointer else None, slot=slot))
    for m in re.finditer(r"\b(?:struct\s+)?(\w+)\s+\w+(?:\s*\[[^\]]*\])?\s*=\s*\{", s.text):
        end = s.close.get(m.end() - 1, len(s.text))
        for slot, item in enumerate(split_top(s.text[m.end() : end])):
            named = re.match(r"\.(\w+)\s*=\s*&?(\w+)$", item)
            if named or re.match(r"&?[A-Za-z_]\w*$", item):
                out.append(_fact("registration", named[1] if named else None, m[1], named[2] if named else item.lstrip("&"), s.line(m.start()), None, "field" if named else "slot", slot=slot))
    for m in re.finditer(r"^[A-Za-z_][\w\s\*]*?\b([A-Za-z_]\w*)\s*\(([^;{}]*)\)\s*\{", s.text, re.M):
        if m[1] in _C_WORDS:
            continue
        start, end = s.body(m.end() - 1)
        out.append(_fact("function", m[1], None, None, s.line(m.start(1)), s.line(end), None, args="(" + ", ".join(split_top(m[2])) + ")"))
        out += s.calls(m[1], start, end, _C_WORDS)
        out += [_fact("dispatch", d[2], m[1], None, s.line(d.start()), None, d[1]) for d in re.compile(r"(\w+)\s*(?:->|\.)\s*(\w+)\s*\(").finditer(s.text, start, end)]
    return out


_TS_WORDS = frozenset("if for while switch return catch function super import typeof new await constructor".split())


def ts_facts(source: str) -> list[Fact]:
    """Functions, classes, interfaces, enums, type aliases and methods, with bases, calls and imports."""
    s = _Braces(source, "\"'`")
    imported = r"""^\s*(?:import|export)\b([^'"\n;]*?)(?:\bfrom\s*)?['"]([^'"]+)['"]"""
    out = [_fact("import", m[2], None, m[2], s.line(m.start(2)), names=re.findall(r"[\w$]+", m[1].replace(" type ", " "))) for m in re.finditer(imported, source, re.M)]
    declared = r"\b(function|class|interface|enum|type|namespace)\s*\*?\s+([A-Za-z_$][\w$]*)"
    arrow = r"\b(const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=]+)?=>"
    for m in sorted([*re.finditer(declared, s.text), *re.finditer(arrow, s.text)], key=lambda m: m.start()):
        kind = {"type": "type_alias", "const": "function", "let": "function", "var": "function"}.get(m[1], m[1])
        start, end = s.body(m.end())
        out.append(_fact(kind, m[2], None, None, s.line(m.start()), s.line(end)))
        if kind == "function":
            out += s.calls(m[2], start, end, _TS_WORDS)
        if kind not in ("class", "interface"):
            continue
        for clause in re.findall(r"\b(?:extends|implements)\s+([^{]*?)(?=\bimplements\b|$)", s.text[m.end() : start - 1]):
            out += [_fact("base", m[2], None, re.split(r"[<\s]", b)[0].split(".")[-1], s.line(m.start())) for b in split_top(clause)]
        method = re.compile(r"^\s*(?:(?:public|private|protected|static|async|readonly|get|set|abstract|override)\s+)*([A-Za-z_$#][\w$]*)\s*(?:<[^>]*>)?\(", re.M)
        for f in method.finditer(s.text, start, end):
            if f[1] in _TS_WORDS - {"constructor"} or any(a < f.start() < s.close[a] for a in s.close if start <= a < f.start()):
                continue
            a, b = s.body(f.end())
            out.append(_fact("function", f"{m[2]}.{f[1]}", m[2], None, s.line(f.start(1)), s.line(b)))
            out += s.calls(f"{m[2]}.{f[1]}", a, b, _TS_WORDS)
    return out


_RUST_WORDS = frozenset("if for while match return loop fn Some Ok Err None".split())


def rust_facts(source: str) -> list[Fact]:
    """Functions, structs, enums, traits and methods, with calls, imports and which type implements which trait."""
    s = _Braces(source, '"')
    out = [_fact("import", m[1].split("::")[-1], None, m[1], s.line(m.start())) for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([\w:]+)", s.text, re.M)]
    out += [_fact("macro", m[1], None, None, s.line(m.start())) for m in re.finditer(r"\bmacro_rules!\s+(\w+)", s.text)]
    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(r"\b(struct|enum|trait|type|mod)\s+(\w+)", s.text):
        start, end = s.body(m.end())
        kind = {"trait": "interface", "type": "type_alias", "mod": "namespace"}.get(m[1], m[1])
        out.append(_fact(kind, m[2], None, None, s.line(m.start()), s.line(end)))
        if m[1] == "trait":
            spans.append((start, end, m[2]))
    for m in re.finditer(r"\bimpl\b\s*(?:<[^{]*?>\s*)?(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?([\w:]+)", s.text):
        start, end = s.body(m.end())
        owner = m[2].split("::")[-1]
        spans.append((start, end, owner))
        if m[1]:
            out.append(_fact("pattern", m[1].split("::")[-1], None, owner, s.line(m.start()), None, "rust_trait_impl"))
    for m in re.finditer(r"\bfn\s+(\w+)", s.text):
        start, end = s.body(m.end())
        owner = max((x for x in spans if x[0] <= m.start() < x[1]), default=(0, 0, None))[2]
        name = f"{owner}.{m[1]}" if owner else m[1]
        out.append(_fact("function", name, owner, None, s.line(m.start()), s.line(end)))
        out += s.calls(name, start, end, _RUST_WORDS)
    return out


PARSERS = Registry([
    Parser("python", (".py", ".pyi"), python_facts),
    Parser("c_cpp", (".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh"), c_facts),
    Parser("typescript", (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts"), ts_facts),
    Parser("rust", (".rs",), rust_facts),
])


def facts_of(language: str, source: str, parsers: Registry = PARSERS) -> list[Fact]:
    """The facts of one source by its language's parser; none for a language without one."""
    parser = next((p for p in parsers.by_extension.values() if p.name == language), None)
    try:
        return parser.facts(source) if parser else []
    except (SyntaxError, ValueError, RecursionError) as e:
        return [_fact("error", type(e).__name__, None, None, getattr(e, "lineno", None))]


def extract(files: DataFrame, parsers: Registry = PARSERS) -> DataFrame:
    """``FACTS`` of ``(path, language, source)``. Parsing takes far longer than reading, and many sources may lie in one small
    file, so they are dealt over all cores first, several tasks to each."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(f.path, *r) for f in pdf.itertuples() for r in facts_of(f.language, f.source or "", parsers)]
            yield pd.DataFrame(found, columns=list(COLUMNS)).astype({"line": "Int32", "end_line": "Int32"})

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return files.select("path", "language", "source").repartition(tasks, "path").mapInPandas(rows, FACTS)
