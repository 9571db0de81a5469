"""Operators on hand-made fixtures: version chains, tiers, caps, walks, clusters, metrics and the queue."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import model
from spindrift.functions import text as X
from spindrift.operators import answers, cluster, evaluate, graph, projection, resolve, search, versions
from spindrift.sources import extract, facts
from spindrift.streaming import jobs

#: Two files that call each other in a ring, a derived edge out of it, an unresolved call and one without provenance.
CALLS = [("w.py::open", "v.py::load", "definite"), ("w.py::open", "w.py::scan", "definite"), ("w.py::scan", "v.py::Disk.seek", "inferred"), ("lost", None, None), ("v.py::load", "w.py::open", None)]


def test_walks(spark):
    edges = spark.createDataFrame(CALLS, "caller string, callee string, provenance string")
    one = lambda *n: spark.createDataFrame([(x,) for x in n], "node string")
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(graph.levels(graph.followed(edges, True), one("w.py::open"), 2)) == {(1, "w.py::scan"), (1, "v.py::load")}
    assert rows(graph.levels(graph.followed(edges), one("w.py::open"), 9)) == {(1, "w.py::scan"), (1, "v.py::load"), (2, "v.py::Disk.seek")}
    assert rows(graph.levels(graph.followed(edges), one("v.py::Disk.seek"), 9, True)) == {(1, "w.py::scan"), (2, "w.py::open"), (3, "v.py::load")}
    assert rows(graph.levels(graph.followed(edges), one("w.py::open"), 0)) == set()
    more = spark.createDataFrame([("w.py::open", "u.py::load")], "caller string, callee string")
    assert rows(graph.levels(graph.followed(edges, candidates=more), one("u.py::load"), 1, True)) == {(1, "w.py::open")}
    walk = graph.followed(edges)
    assert graph.shortest_path(walk, "lost", "lost") == ["lost"] and graph.shortest_path(walk, "v.py::Disk.seek", "w.py::open") is None
    assert graph.shortest_path(walk, "v.py::load", "v.py::Disk.seek", budget=1) is None
    labelled = edges.withColumn("via", F.when(F.col("provenance") == "inferred", "observer"))
    flow = graph.flow(walk, ["v.py::load", "v.py::Disk.seek", "w.py::open", None], labelled=labelled).orderBy("segment", "step").collect()
    assert [(r.segment, r.step, r.node, r.label, r.found) for r in flow] == [
        (1, 0, "v.py::load", None, True), (1, 1, "w.py::open", "call", True), (1, 2, "w.py::scan", "call", True), (1, 3, "v.py::Disk.seek", "synthesized [via: observer]", True),
        (2, 0, "v.py::Disk.seek", None, False), (3, 0, "w.py::open", None, False),
    ]


def test_paths_are_shortest(spark):
    import itertools
    import random

    rnd = random.Random(1)
    pairs = {(rnd.randrange(14), rnd.randrange(14)) for _ in range(22)}
    pairs = {(a, b) for a, b in pairs if a != b}
    edges = spark.createDataFrame(sorted(pairs), "caller long, callee long").coalesce(1)
    far = {(a, a): 0 for a in range(14)}
    for _ in range(14):
        for (a, b), (c, d) in itertools.product(list(far), pairs):
            if b == c:
                far[a, d] = min(far.get((a, d), 99), far[a, b] + 1)
    for a, b in ((0, 5), (3, 9), (7, 1)):
        path = graph.shortest_path(edges, a, b)
        assert (path is None) == ((a, b) not in far)
        if path:
            assert len(path) - 1 == far[a, b] and path[0] == a and path[-1] == b and all(p in pairs for p in zip(path, path[1:]))


def test_walks_deal_edges_only_for_wide_frontiers(spark, monkeypatch):
    made = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (made.append(df.columns), real(df))[1])
    twice = [(n, m) for n in range(12) for m in (n + 1, n + 2)] * 2
    edges = spark.createDataFrame(twice, "caller long, callee long").coalesce(1)
    path = graph.flow(edges, [0, 6, 12, 3]).collect()
    assert [(r.hops, r.found) for r in path if r.step == 0] == [(3, True), (3, True), (None, False)]
    assert made.count(["caller", "callee"]) == 1 and ["node", "next"] not in made
    seeds = spark.createDataFrame([(0,)], "node long")
    near = {tuple(r) for r in graph.levels(edges, seeds, 3).collect()}
    monkeypatch.setattr(graph, "SMALL", 0)
    assert {tuple(r) for r in graph.levels(edges, seeds, 3).collect()} == near == {(1, 1), (1, 2), (2, 3), (2, 4), (3, 5), (3, 6)}
    assert made.count(["node", "next"]) == 1
    chosen = graph.choose_symbol(spark.createDataFrame([("x", 11), ("x", 2), ("y", 12)], "name string, node long"), edges, seeds)
    assert {(r.name, r.node) for r in chosen.collect()} == {("x", 2), ("y", 12)}


def test_current_versions(spark):
    ok = '{"short": "x", "full": "y"}'
    chains = {
        "ok": [("ok", ok)], "stale": [("ok", ok), ("stale", ok)], "hidden": [("ok", ok), ("stale", ok), ("pending", ok)], "pending": [("ok", ok), ("pending", None)], "corrupt": [("ok", ok), ("corrupt", ok)],
        "hard": [("ok", ok), ("oversized_hard", ok)], "warn": [("oversized_warn", ok)], "blank": [("ok", ok), ("ok", '{"short": "  "}')], "bad": [("ok", "{")], "after": [("stale", ok), ("ok", ok)],
    }
    rows = [("s", ref, n, status, summary, "2024") for ref, chain in chains.items() for n, (status, summary) in enumerate(chain, 1)]
    v = spark.createDataFrame(rows, "kind string, ref string, version int, status string, summary string, created_at string")
    got = {r.ref: r.version for r in versions.current(v).collect()}
    assert got == {"ok": 1, "stale": None, "hidden": None, "pending": 1, "corrupt": 1, "hard": 1, "warn": 1, "blank": 1, "bad": None, "after": 2}
    gone = versions.expired(v, F.lit("2025"), versions.current(v))
    assert {(r.ref, r.version) for r in gone.collect()} == {("stale", 1), ("hidden", 1), ("hidden", 2), ("after", 1)}


def test_resolution(spark):
    symbols = spark.createDataFrame([("a::f", "a", "f", "f", "py"), ("b::f", "b", "f", "f", "py"), ("c::K.g", "c", "K.g", "g", "py"), ("d::h", "d", "h", "h", "py"), ("e::h", "e", "h", "h", "py"), ("z::h", "z", "h", "h", "rs")], "target string, file string, name string, short_name string, scope string")
    calls = spark.createDataFrame([(1, "a", "f", "py", "name"), (2, "x", "g", "py", "name"), (3, "x", "h", "py", "name"), (4, "y", "f", "py", "attribute"), (5, "x", "g", "py", "attribute"), (6, "x", "none", "py", "name")], "call int, file string, name string, scope string, form string")
    imports = spark.createDataFrame([("a", "b"), ("y", "b")], "file string, imported string")
    got = {r.call: (r.target, r.provenance, r.candidates) for r in resolve.resolve(calls, resolve.candidates(calls, symbols, imports)).collect()}
    outside = spark.createDataFrame([("x", "h"), ("x", "g")], "file string, name string")
    assert {r.call for r in resolve.candidates(calls, symbols, imports, outside).collect()} == {1, 4, 5}
    assert got == {1: ("a::f", "definite", 2), 2: ("c::K.g", "probable", 1), 3: ("d::h", "speculative", 2), 4: ("b::f", "speculative", 1), 5: ("c::K.g", "speculative", 1)}


@pytest.mark.parametrize("n,edges", [(3, 3), (4, 0)])
def test_signal_cap_drops_whole_signals(spark, n, edges):
    emits = spark.createDataFrame([("s", "e", 5), ("s", "e", 2), (None, "e", 1)], "signal string, caller string, line int")
    registers = spark.createDataFrame([("s", f"h{k}") for k in range(n)], "signal string, handler string")
    got = resolve.emit_register(emits, registers, "via", cap=3).collect()
    assert len(got) == edges and all(r.line == 2 for r in got)


def test_folders(spark):
    files = spark.createDataFrame([(f"big/s{k % 2}/f{k}",) for k in range(16)] + [("small/a",), ("small/b",), ("lone/x",), ("root1",), ("root2",), ("big/top",)], "file string")
    got = {r.file: r.cluster for r in cluster.by_folder(files).collect()}
    assert got["big/s0/f0"] == "big/s0" and got["small/a"] == "small" and got["root1"] == "_root" and "lone/x" not in got and "big/top" not in got


def test_metrics_and_differences(spark):
    e, p = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a")], "task string, item string"), spark.createDataFrame([("t", "b"), ("t", "b"), ("v", "z")], "task string, item string")
    tasks = spark.createDataFrame([(x,) for x in "tuvw"], "task string")
    assert {r.task: (r.matched, r.recall, r.precision, r.f1) for r in evaluate.set_scores(tasks, e, p).collect()} == {"t": (1, 0.5, 1.0, 0.6667), "u": (0, 0.0, 0.0, 0.0), "v": (0, 0.0, 0.0, 0.0), "w": (0, 1.0, 1.0, 1.0)}
    a, b = spark.createDataFrame([(1, "x", None), (2, "y", "q")], "k int, c string, d string"), spark.createDataFrame([(1, "x", "n"), (3, "y", "q")], "k int, c string, d string")
    assert {tuple(r) for r in evaluate.diff(a, b, ["k"], ["c", "d"]).collect()} == {(1, "changed", "d", None, "n"), (2, "only_left", None, None, None), (3, "only_right", None, None, None)}
    assert {(r.k, r.category, r.blocking) for r in evaluate.classified_diff(a, b, ["k"], ["c"], ["d"]).collect()} == {(1, "allowed_diff", False), (2, "missing_row", True), (3, "extra_row", True)}
    x = spark.createDataFrame([("a", "definite", None), ("b", "inferred", None), ("c", None, "s")], "caller string, provenance string, synthesized_from string")
    assert {(r.caller, r.category, r.blocking) for r in evaluate.classified_surplus(x, x.limit(0)).collect()} == {("a", "missing_row", True), ("b", "inferred_edge", True), ("c", "inferred_edge", True)}
    assert evaluate.same_environment({"os": 1, "v": 2}, {"os": 1, "v": 3}, anyway=True) == ["v"]
    with pytest.raises(ValueError):
        evaluate.same_environment({"os": 1}, {})


def test_occurrences(spark):
    rows = [("a", 1, "f", "x", 5, 9, "s"), ("a", 2, "f", "x", 1, 2, "s"), ("b", 3, "f", "x", 7, 8, None), ("b", 4, "f", "y", 3, 20, "s"), ("c", 5, "f", "x", 1, 1, "s"), ("d", 6, "f", "x", 1, 9, None), ("d", 7, "g", "x", 4, 5, "s")]
    d = spark.createDataFrame(rows, "key string, id int, type string, signature string, line int, end_line int, segment string")
    got = {r.id: (r.occurrence, r.is_canonical, r.conflict) for r in resolve.canonical(d, resolve.classify_conflicts(d)).collect()}
    same, variant, kind = "duplicate_definition", "signature_variant", "type_variant"
    assert got == {1: (1, True, same), 2: (0, False, same), 3: (1, False, variant), 4: (0, True, variant), 6: (0, False, kind), 7: (1, True, kind)}


def test_override_caps(spark):
    methods = spark.createDataFrame([("B", f"m{k}", f"B.m{k}", 9 - k) for k in range(5)] + [("I", f"m{k}", f"I.m{k}", k) for k in range(5)], "owner string, name string, node string, line int")
    bases = spark.createDataFrame([("I", "B"), ("I", "B")], "impl string, base string")
    assert {r.caller for r in resolve.overrides(bases, methods, "v", cap=2).collect()} == {"B.m4", "B.m3"}


def test_dispatch_reaches_all_handlers(spark):
    fields = spark.createDataFrame([("ops", "open"), ("ops", "close"), ("dev", "close")], "owner string, field string")
    given = [("ops", "open", n) for n in range(500)] + [("ops", "close", n) for n in range(400, 600)] + [("dev", "close", 7)]
    registered = spark.createDataFrame(given, "owner string, field string, handler int")
    sites = spark.createDataFrame([(1, "open", None), (2, "open", None), (2, "close", "ops"), (2, "close", "ops"), (3, "close", "dev"), (4, "close", None), (5, "read", "ops")], "caller int, field string, hint string")
    got = sorted(tuple(r) for r in resolve.pointer_dispatch(fields, registered, sites).collect())
    assert got == [(1, n) for n in range(500)] + [(2, n) for n in range(600)] + [(3, 7)]


def test_import_bindings(spark):
    paths = spark.createDataFrame([(x,) for x in ("a/b.py", "x/a/b.py", "one/two.py", "pkg/__init__.py", "os.py")], "path string")
    given = spark.createDataFrame([("f", "a.b", ["p"]), ("f", "one.two", ["q"]), ("f", "two", ["r"]), ("g", "os.path", ["s"]), ("g", "none", ["t", "u"]), ("g", "pkg", ["v"]), ("g", "", ["w"])], "file string, module string, names array<string>")
    inside, outside = resolve.import_bindings(given, paths)
    assert {tuple(r) for r in inside.collect()} == {("f", "one/two.py"), ("g", "pkg/__init__.py")}
    assert {tuple(r) for r in outside.collect()} == {("g", "s"), ("g", "t"), ("g", "u")}


def test_calls_that_are_alike_are_resolved_once(spark):
    symbols = spark.createDataFrame([(f"t{n}", "a", "f", "g", "py") for n in range(15)], "target string, file string, name string, short_name string, scope string")
    rows = [(n, ("a", "b")[n % 2], "f", None, "name") for n in range(400)] + [(7, "b", "f", "py", "attribute"), (500, "c", "g", "py", "name")]
    calls = spark.createDataFrame(rows, "call int, file string, name string, scope string, form string")
    imports = spark.createDataFrame([("b", "a")], "file string, imported string")
    seen = []
    got = resolve.alike(calls, lambda once: (seen.append(once.select("call").distinct().count()), resolve.candidates_of(once, symbols, imports))[1])
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    assert seen == [4] and got.columns == ["call", "target", "score"]
    assert plain(got) == plain(resolve.candidates_of(calls, symbols, imports)) and got.count() == 400 * 15 + 10
    assert plain(resolve.stored_candidates(calls, symbols, imports)) == plain(resolve.stored(resolve.candidates_of(calls, symbols, imports)))
    assert plain(resolve.resolution(calls, symbols, imports)) == plain(resolve.resolve(calls, resolve.candidates_of(calls, symbols, imports)))


def test_incremental_resolution_equals_full(spark):
    """A file's symbols change: the affected edges resolved anew, with all others as they were, are those of a full run."""
    import random

    rnd = random.Random(4)
    shape = "target string, file string, name string, short_name string, scope string"
    make = lambda files: [(f"{f}::{n}", f, n, n, "py") for f in files for n in {f"n{rnd.randrange(9)}" for _ in range(4)}]
    old = make([f"m{k}" for k in range(6)])
    new = [r for r in old if r[1] != "m2"] + make(["m2"])
    calls = spark.createDataFrame([(k, f"m{rnd.randrange(6)}", f"n{rnd.randrange(10)}", "py", rnd.choice(["name", "attribute"])) for k in range(60)], "call int, file string, name string, scope string, form string").coalesce(1)
    imports = spark.createDataFrame([("m0", "m2"), ("m1", "m3"), ("m4", "m2")], "file string, imported string").coalesce(1)
    run = lambda c, rows: {tuple(r) for r in resolve.resolve(c, resolve.candidates(c, spark.createDataFrame(rows, shape).coalesce(1), imports)).collect()}
    before, after = run(calls, old), run(calls, new)
    names = {r[2] for r in {*old} ^ {*new}}
    edges = calls.select(F.col("call").alias("edge"), "file", F.col("name").alias("callee"), F.lit(None).cast("string").alias("callee_file"), F.lit(None).cast("string").alias("provenance"))
    hit, files = graph.affected(edges, spark.createDataFrame([("m2",)], "file string"), spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([], "file string"))
    again = {r.edge for r in hit.collect()}
    assert {r for r in before if r[0] not in again} | run(calls.where(F.col("call").isin(*again)), new) == after and before != after
    assert "m2" in {r.file for r in files.collect()}


def test_words_and_channels(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    for text, words in (("getUserByID_x::HTTPServer", "get User By ID x HTTP Server"), ("utf8Decode v2Final", "utf8Decode v2Final"), (" a\t b\n", "a b")):
        assert f(X.tokenize_symbol(F.lit(text))) == words and f(X.search_words(F.lit(text))) == X.words_of(text)
    assert f(X.excluded(F.lit("a/node_modules/b.py"), ["**/node_modules/"])) and not f(X.excluded(F.lit("a/b.py"), ["*.js", "c/"]))
    assert f(X.layer_of(F.lit("src/Utils/a.py"), {"Util": ["util"]})) == "Util" and f(X.layer_of(F.lit("x"), {})) == "Core"


def _corpus(spark):
    files = spark.createDataFrame([("p/io.py", "python"), ("q/net.ts", "ts")], "path string, language string")
    symbols = spark.createDataFrame([("p/io.py", "readBlock", "readBlock", "function", "(a)", 1), ("p/io.py", "read", "read", "function", None, 2), ("q/net.ts", "Pipe.flush_all", "flush_all", "class", "()", 3), ("q/net.ts", "Pipe.unread", "unread", "function", "()", 4)], "file string, name string, short_name string, type string, args string, line int")
    clusters = spark.createDataFrame([("p", "disk things"), ("q", None)], "name string, label string")
    current = spark.createDataFrame([("symbol", "p/io.py::readBlock", 1, "stores café tokens", "x"), ("symbol", "q/net.ts::Pipe.flush_all", 3, "nothing", "cafe here, the cache is cold"), ("file", "p/io.py", 2, "disk cache", None)], "kind string, ref string, version int, short string, full string")
    docs = projection.documents(files, symbols, clusters, current)
    rows = symbols.join(files.withColumnRenamed("path", "file"), "file").withColumn("ref", F.concat("file", F.lit("::"), "name"))
    return docs, rows, search.build(docs, projection.SEARCHED), (files, symbols, clusters)


def test_projection(spark):
    import hashlib
    import json

    docs, _, _, tables = _corpus(spark)
    got = {r.node_ref: r for r in docs.collect()}
    assert len(got) == 8 and got["p"].name == "disk things" and got["q"].name == "q" and got["p/io.py"].name_tokens == "p io.py" and got["q/net.ts::Pipe.flush_all"].name_tokens == "Pipe.flush all"
    for r in got.values():
        payload = {k: r[k] for k in projection.HASHED}
        assert r.content_hash == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert all(r.sound for r in projection.check(docs, *tables).collect()) and not all(r.sound for r in projection.check(docs.union(docs.limit(1)), *tables).collect())
    write, gone = projection.changed(docs.where("node_ref <> 'q'"), docs.withColumn("content_hash", F.when(F.col("node_kind") == "file", "old").otherwise(F.col("content_hash"))))
    assert {r.node_ref for r in write.collect()} == {"p/io.py", "q/net.ts"} and [r.node_ref for r in gone.collect()] == ["q"]


def test_search(spark):
    docs, symbols, index, _ = _corpus(spark)
    details = docs.select(F.col("node_ref").alias("ref"), "signature", F.col("summary_short").alias("summary"))
    run = lambda t, **k: [(r.ref.split("::")[1], r.sources) for r in search.search(symbols, index, details, t, **k).orderBy("position").collect()]
    assert run("read") == [("read", "exact#1, prefix#1"), ("readBlock", "prefix#2")]
    assert run("nread") == [("read", "fuzzy#1"), ("Pipe.unread", "fuzzy#2")] and run("nread b") == []
    assert [x for x, _ in run("cafe")] == ["readBlock", "Pipe.flush_all"] and run("cafe", language="Python", path_hint="P\\") == [("readBlock", "bm25#1")]
    assert run("the cache", match="phrase") == [("Pipe.flush_all", "bm25#1")] and run("cache the", match="phrase") == [] and [x for x, _ in run("cache the")] == ["Pipe.flush_all"]
    assert run("flush", symbol_type="CLASS") == [("Pipe.flush_all", "prefix#1")] and run("flush", symbol_type="enum") == [] and len(run("read tokens", match="any")) == 2
    wrong = (dict(text=" "), dict(text="x", match="odd"), dict(text="x", limit=0), dict(text="x", limit=True), dict(text="x", limit="9"), dict(text="__"), dict(text=4), dict(text="x", match=None), dict(text="x", file_hint="a", path_hint="b"), dict(text="x", path_hint="\0"), dict(text="x", language=" "), dict(text="x", language="cobol"), dict(text="x", symbol_type="verb"), dict(text="x", symbol_type=" "), dict(text="x", file_hint=3), dict(text="x", limit=51))
    for k in wrong:
        assert isinstance(search.search(symbols, index, details, **k), search.Problem), k
    order = lambda t, **k: [r.name for r in search.prefix(symbols, search.make_query(t, **k)).orderBy("category", F.desc("hits"), "name").collect()]
    assert order("read") == ["read", "readBlock"] and order("pipe all", match="any") == ["Pipe.flush_all", "Pipe.unread"]
    found = [(r.kind, r.ref) for r in search.navigate(symbols, index, "disk cache", top=9).collect()]
    assert found == [("symbol", "q/net.ts::Pipe.flush_all"), ("file", "p/io.py"), ("cluster", "p")]
    t = {r.term: (r.candidates, r.truncated) for r in search.truncation(symbols, index, search.make_query("cafe cold", limit=1, match="any")).collect()}
    assert t == {"cafe": (2, False), "cold": (1, False)}


def test_index_counts_terms_without_shuffling_tokens(spark):
    docs = spark.createDataFrame([("file", "p", "a a a", "ab b"), ("file", "q", "b a", None), ("file", "r", None, "")], "node_kind string, node_ref string, name string, summary_short string")
    index = search.build(docs, ("name", "summary_short"))
    assert {(r.column, r.token): (r.n, r.docs) for r in search.vocabulary(index).collect()} == {("name", "a"): (4, 2), ("name", "b"): (1, 1), ("summary_short", "ab"): (1, 1), ("summary_short", "b"): (1, 1)}
    assert {r.ref: r.length for r in index.nodes.collect()} == {"p": 5, "q": 2, "r": 0}
    weights = {"name": 1.0, "summary_short": 5.0}
    hits = search.bm25(index, ["a", "b"], weights)
    assert {r.ref: r.matched for r in hits.collect()} == {"p": 2, "q": 2} and "hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()
    count = lambda c, *t: {r.ref: r.n for r in index.nodes.select("ref", c.alias("n")).collect()}
    assert count(search._phrases("name", ["a", "a"])) == {"p": 2, "q": 0, "r": 0} and count(search._begun("summary_short", "a")) == {"p": 1, "q": 0, "r": 0}


def test_answers(spark):
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first().x
    items = lambda t: [tuple(x) for x in f(answers.answer_items(F.lit(t), "repo"))]
    assert items("x|y\n```answer\n`A.run(x)`|./Repo/Src/a.py:3\n\nns::go | B.py\nalone\n```\nz|w") == [("run", "src/a.py:3"), ("go", "b.py"), ("alone", "")]
    assert items("see A::run | repo/x.PY now\nin `f.g` of lib/y.py it is\n`a` in x.py and y.py\nnothing") == [("run", "x.py"), ("g", "lib/y.py")] and items("") == []
    good = {"propagate": False, "rationale": "r", "matched_dimension": "rename", "confidence": "high"}
    said = lambda **k: f(answers.verdict(F.lit(json.dumps({**good, **k})))).asDict()
    assert said() == good and said(rationale=5)["propagate"] and said(matched_dimension="naming")["confidence"] == "low" and said(propagate="false")["matched_dimension"] == "ambiguous"
    assert f(answers.verdict(F.lit("{")))["propagate"] and f(answers.verdict(F.lit(None).cast("string")))["propagate"]
    source = "def f(x):\n    \'\'\'doc # x\'\'\'\n    return \'#a\'  # note\n"
    assert one.select(answers.strip_docstrings(F.lit(source)).alias("x")).first().x == "def f(x):\n    \n    return \'\n"
    assert one.select(answers.strip_docstrings(F.lit("def (  # z")).alias("x")).first().x == "def (  "
    body = lambda short, full="": json.dumps({"short": short, "full": full})
    outcome = lambda *a: tuple(f(versions.generated(F.array(*(F.lit(x).cast("string") for x in a)), 10)))
    assert outcome(None) == (None, "pending") and outcome("Error: x") == (None, "pending") and outcome("oops") == (None, "corrupt")
    assert outcome(body("abc")) == (body("abc"), "ok") and outcome(body("a" * 13)) == (body("a" * 13), "oversized_warn")
    assert outcome(body(" "), "oops") == (None, "corrupt") and outcome(body(" "), body("b")) == (body("b"), "ok")
    long_ = body("s", "a" * 16)
    assert outcome(long_, body("b")) == (body("b"), "ok") and outcome(long_, "oops") == (long_, "oversized_hard") and outcome(long_, body("")) == (None, "corrupt") and outcome(long_, body("c" * 13)) == (body("c" * 13), "oversized_hard")
    assert outcome(body(""), long_, body("d")) == (body("d"), "ok")
    asked = spark.createDataFrame([("a  b",), (None,)], "p string")
    assert [r.x for r in asked.select(model.answers(F.col("p")).alias("x")).collect()] == ['{"short": "a b", "full": "a  b"}', None]


def test_change_counters(spark):
    rows = [("s", "a", 1, "ok", '{"x": 1, "y": 2}'), ("s", "a", 2, "ok", '{"y":2,"x":1}'), ("s", "a", 3, "pending", None), ("s", "a", 4, "ok", '{"x": 1}'), ("s", "a", 5, "stale", '{"x": 9}'), ("s", "b", 1, "pending", None), ("s", "b", 2, "oversized_warn", "{"), ("s", "b", 3, "ok", "{")]
    v = spark.createDataFrame(rows, "kind string, ref string, version int, status string, summary string")
    parents = spark.createDataFrame([("s", "a", "P"), ("s", "b", "Q")], "kind string, ref string, parent string")
    assert {tuple(r) for r in versions.change_counters(v, parents, parents.select("parent")).collect()} == {("P", 2), ("Q", 1)}


def test_queue_batch_equals_stream(spark, tmp_path):
    log = [(1, 1, "submit", 10, "a", False, 1, None), (1, 2, "submit", 11, "a", False, 5, None), (1, 3, "submit", 12, "b", False, 0, None), (1, 4, "submit", 13, "s", True, 0, None), (1, 5, "submit", 14, "c", False, 0, None), (1, 6, "move", 13, None, None, None, "running"), (1, 7, "move", 13, None, None, None, "succeeded"), (1, 8, "move", 13, None, None, None, "running"), (2, 1, "submit", 20, "a", False, 1, None), (2, 2, "move", 20, None, None, None, "running"), (2, 3, "recover", None, None, None, None, None)]
    events = spark.createDataFrame(log, jobs.EVENTS)
    got = {(r.job, r.status, r.priority, r.superseded_by) for r in jobs.reduce_log(events).collect()}
    assert got == {(10, "superseded", 5, 13), (12, "superseded", 0, 13), (13, "succeeded", 0, None), (14, "superseded", 0, 13), (20, "pending", 1, None)}
    scans = [(3, 1, "submit", 30, "s", True, 0, None), (3, 2, "move", 30, None, None, None, "running"), (3, 3, "submit", 31, "s", True, 0, None), (3, 4, "submit", 32, "a", False, 0, None), (3, 5, "move", 30, None, None, None, "cancel_requested"), (3, 6, "move", 30, None, None, None, "failed"), (3, 7, "submit", 33, "s", True, 0, None), (3, 8, "move", 30, None, None, None, "cancelled"), (3, 9, "submit", 34, "s", True, 0, None)]
    assert {(r.job, r.status, r.superseded_by) for r in jobs.reduce_log(spark.createDataFrame(scans, jobs.EVENTS)).collect()} == {(30, "cancelled", None), (32, "superseded", 34), (34, "pending", None)}
    events.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = jobs.follow(spark.readStream.schema(jobs.EVENTS).parquet(f"{tmp_path}/log"))
    query = stream.writeStream.outputMode("update").format("memory").queryName("jobs").option("checkpointLocation", f"{tmp_path}/at").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.job, r.status, r.priority, r.superseded_by) for r in spark.table("jobs").collect()} == got


def test_queue_recovers_without_looking_at_all_jobs():
    class Counted(dict):
        seen = 0

        def values(self):
            Counted.seen += len(self)
            return super().values()

    queue = jobs.Queue(Counted())
    for n in range(0, 2000, 2):
        queue.step({"kind": "submit", "job": n, "dedupe": f"k{n}", "full_scan": False, "priority": 0})
        queue.step({"kind": "move", "job": n, "status": "running"})
        queue.step({"kind": "submit", "job": n + 1, "dedupe": f"k{n}", "full_scan": False, "priority": 0})
        queue.step({"kind": "recover"})
    assert Counted.seen == 0 and queue.jobs[1998]["superseded_by"] == 1999 and len(queue.active) == 0


def test_queue_gives_jobs_that_left_it(spark):
    log = [(1, 2 * n, "submit", n % 70, "s", n % 2 == 0, n, None) for n in range(100)] + [(1, 2 * n + 1, "move", n % 70, None, None, None, ("cancelled", "running")[n % 2]) for n in range(100)]
    events = spark.createDataFrame(log, jobs.EVENTS)
    small, large = ({tuple(r) for r in jobs.reduce_log(events, sweep=n).collect()} for n in (3, 1000))
    assert small == large and len(small) == len({r[1] for r in small}) > 3


def test_sources(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("import os\nclass A(B):\n    def f(self):\n        return g(os.x())\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (")
    (tmp_path / "pkg" / "c.c").write_text('#include "x.h"\n/* int no(void) { */\nint yes(int a) {\n  return 1;\n}\n')
    files = facts.discover(spark, str(tmp_path), {".py": "python", ".c": "c_cpp"})
    got = {(r.path, r.kind, r.name, r.target) for r in extract.extract(files).collect()}
    assert {("pkg/a.py", "function", "A.f", None), ("pkg/a.py", "call", None, "g"), ("pkg/a.py", "base", "A", "B"), ("pkg/bad.py", "error", "SyntaxError", None), ("pkg/c.c", "function", "yes", None)} <= got
    assert not any(r[2] == "no" for r in got)
    (tmp_path / "t.md").write_text("# x\n\n| d | e |\n|---|---|\n| 1 | a b |\n| 2 | |\n")
    assert [r.cells for r in facts.markdown_table(spark, f"{tmp_path}/t.md").orderBy("line").collect()] == [["1", "a b"], ["2", ""]]


def test_sources_are_dealt_before_they_are_parsed(spark):
    files = spark.range(0, 64, 1, 1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.lit("def f():\n    return g()\n").alias("source"))
    found = extract.extract(files)
    assert found.count() == 128 and found.rdd.getNumPartitions() >= 4 and found.select(F.spark_partition_id()).distinct().count() >= 4


def test_languages():
    facts_ = lambda language, text: {x[:4] + x[6:7] for x in extract.facts_of(language, text)}
    py = facts_("python", "from a.b import c\nfrom PyQt5 import q\nclass K:\n    def go(self):\n        for cb in self.subs:\n            cb(1)\n        self.subs.append(2)\n        sig.emit(3)\n\nsig.connect(self.on)\n")
    assert {("pattern", "subs", None, "K.go", "observer_emit"), ("pattern", "subs", None, "K.go", "observer_register"), ("pattern", "sig", None, "K.go", "pyqt_signal_emit"), ("pattern", "sig", None, "on", "pyqt_signal_connect"), ("binding", None, None, "a.b", None)} <= py
    c = facts_("c_cpp", "#define N 1\ntypedef int (*cb_t)(int);\nstruct ops {\n  int (*open)(int);\n  cb_t shut;\n  int n[3];\n};\nstatic struct ops o = { .open = my_open, .shut = my_shut };\nstruct ops p = { my_open, my_shut };\nint run(struct ops *x) { /* y(1) */ return x->open(f(\"g(2)\")); }\n")
    assert {("macro", "N", None, None, None), ("typedef", "cb_t", None, None, "function_pointer"), ("struct", "ops", None, None, None), ("field", "open", "ops", None, "function_pointer"), ("field", "shut", "ops", "cb_t", None), ("registration", "open", "ops", "my_open", "field"), ("registration", None, "ops", "my_shut", "slot"), ("function", "run", None, None, None), ("call", None, "run", "f", "name"), ("dispatch", "open", "run", None, "x")} <= c
    assert not {x for x in c if x[3] in ("y", "g")}
    ts = facts_("typescript", "import { a, b } from './m';\nexport class K<T> extends N.Base implements I, J<T> {\n  async go(x: number): Promise<void> {\n    if (x) { this.stop(); }\n  }\n}\ninterface I { go(): void }\nconst f = (x) => { go(x); };\ntype Z = string;\n")
    assert {("import", "./m", None, "./m", None), ("class", "K", None, None, None), ("base", "K", None, "Base", None), ("base", "K", None, "I", None), ("base", "K", None, "J", None), ("function", "K.go", "K", None, None), ("call", None, "K.go", "stop", "attribute"), ("interface", "I", None, None, None), ("function", "f", None, None, None), ("call", None, "f", "go", "name"), ("type_alias", "Z", None, None, None)} <= ts
    rs = facts_("rust", "use a::b;\ntrait Draw { fn draw(&self); }\nstruct P { x: i32 }\nimpl Draw for P {\n    fn draw(&self) { paint(self.x); }\n}\nimpl<T> Q<T> { fn new() -> Q<T> { b::c() } }\n")
    assert {("interface", "Draw", None, None, None), ("struct", "P", None, None, None), ("pattern", "Draw", None, "P", "rust_trait_impl"), ("function", "P.draw", "P", None, None), ("function", "Q.new", "Q", None, None), ("call", None, "P.draw", "paint", "name"), ("function", "Draw.draw", "Draw", None, None)} <= rs
    with pytest.raises(ValueError):
        extract.Registry([extract.Parser("a", (".x",), list), extract.Parser("b", (".X",), list)])
    more = extract.Registry([extract.Parser("a", (".x",), list), extract.Parser("b", (".y.x",), list)])
    assert more.resolve("d/f.Y.x").name == "b" and more.resolve("f.x").name == "a" and more.resolve("f.z") is None


def test_targeted_files_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name in ("a.py", "b.py", "skip.py"):
        (tmp_path / "src" / name).write_text(f"# {name}\n")
    known = {".py": "python"}
    stored = spark.createDataFrame([("a.py",), ("gone.py",), ("skip.py",)], "path string")
    found, gone = facts.targeted(spark, f"{tmp_path}/src", ["a.py", "gone.py", "skip.py", "never.py"], stored, known, ["skip*"])
    assert {r.path for r in found.collect()} == {"a.py"} and {r.path for r in gone.collect()} == {"gone.py", "skip.py"}
    rows = spark.createDataFrame([("a.py", 1), ("b.py", 2)], "file string, n int")
    assert {tuple(r) for r in facts.replace_facts(rows, spark.createDataFrame([("a.py", 7), ("a.py", 8)], rows.schema)).collect()} == {("a.py", 7), ("a.py", 8), ("b.py", 2)}
    left = facts.delete_cascade({"symbols": (rows, "file"), "edges": (rows.withColumnRenamed("file", "source"), "source")}, spark.createDataFrame([("a.py",)], "file string"))
    assert all([r[0] for r in df.collect()] == ["b.py"] for df in left.values())
    out = f"{tmp_path}/out.json"
    kept = facts.write_json(rows, out)
    assert kept != out and spark.read.json(kept).count() == 2 and not (tmp_path / "out.json").exists()
    assert facts.write_json(rows, out, promote=True) == out == facts.write_json(rows.limit(1), out, promote=True) and spark.read.json(out).count() == 1
    (tmp_path / "spec.json").write_text('[{"id": "a", "q": "x"}, {"id": "a", "q": null}]')
    with pytest.raises(ValueError):
        facts.json_spec(spark, f"{tmp_path}/spec.json", "id string, q string", key="id")
    with pytest.raises(Exception, match="q is missing"):
        facts.json_spec(spark, f"{tmp_path}/spec.json", "id string, q string", required=("q",)).collect()


def test_windows_drop_nothing_in_a_batch(spark):
    from spindrift.streaming.windows import tumbling

    rows = spark.sql("select timestamp'2024-01-01 10:00:00' as ts, 'a' as event_type union all select timestamp'2024-01-02 00:00:00', 'a' union all select timestamp'2024-01-01 23:59:59', 'a'")
    assert sorted((str(r.day)[:10], r.n) for r in tumbling(rows).collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
