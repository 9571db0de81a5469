"""Reachability, paths and closures over edge tables.

Edges are ``(caller, callee, provenance)``; an edge whose callee is null is unresolved and never followed. Loops run on the
driver over levels, whose number is small and bounded; each level is one join, a distinct and an anti-join. Edges that repeat
do not change what is reached, so walks over edges that are nothing but walked leave them as they are.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.plans.runtime import cut

MAX_DEPTH = 5
#: The most nodes of a frontier that are sent to all edges.
SMALL = 1 << 18
STATIC = ("definite", "probable")


def is_static(provenance: Column) -> Column:
    """Null is neither."""
    return provenance.isin(*STATIC)


def followed(edges: DataFrame, static_only: bool | None = False, default: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """The distinct edges to walk: resolved, static only on demand (``None``: the default), and, where ambiguity is wanted,
    those to every candidate ``(caller, callee)`` too."""
    known = edges.where(F.col("callee").isNotNull())
    if default if static_only is None else static_only:
        known = known.where(is_static(F.col("provenance")))
    known = known.select("caller", "callee")
    if candidates is not None:
        known = known.unionByName(candidates.select("caller", "callee"))
    return known.distinct()


class Steps:
    """Edges ``(caller, callee)``, which may repeat, as steps ``(node, next)`` of walks one way.

    A frontier of at most ``SMALL`` nodes goes to where the edges lie, so these are neither dealt nor sorted. A larger one meets
    edges dealt by node; they are dealt once, when that is first needed, and each level moves its frontier only."""

    def __init__(self, edges: DataFrame, reverse: bool = False) -> None:
        at, to = ("callee", "caller") if reverse else ("caller", "callee")
        self.rows = edges.select(F.col(at).alias("node"), F.col(to).alias("next"))
        self.dealt: DataFrame | None = None

    def after(self, frontier: DataFrame, size: int) -> DataFrame:
        """The steps from a frontier ``(node)`` of that many nodes."""
        if size <= SMALL:
            return self.rows.join(F.broadcast(frontier.select("node")), "node")
        if self.dealt is None:
            self.dealt = cut(self.rows.repartition("node"))
        return self.dealt.join(frontier.select("node"), "node")


def levels(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """``(depth, node)``: nodes by the least number of edges from the seeds ``(node)``, which never reappear. Empty levels
    end the walk; the depth is clamped to ``MAX_DEPTH``. Edges are walked as they are, so those that cost much to make should
    be kept by the caller."""
    steps = Steps(edges, reverse)
    frontier = seen = cut(seeds.select("node").distinct())
    out, size = [], frontier.count()
    for d in range(1, max(0, min(depth, MAX_DEPTH)) + 1):
        reached = steps.after(frontier, size).select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(reached)
        size = frontier.count()
        if not size:
            break
        out.append(frontier.select(F.lit(d).alias("depth"), "node"))
        seen = seen.unionByName(frontier)
    if not out:
        return seeds.select(F.lit(0).alias("depth"), "node").limit(0)
    return reduce(DataFrame.unionByName, out)


def impact(edges: DataFrame, symbols: DataFrame, files: DataFrame, up: int = 3, down: int = 3, labels: int = 5) -> DataFrame:
    """Both directions from all symbols of the given files: per direction and level how many symbols and files are reached,
    the first few file names, and how many more there are. ``symbols`` is ``(node, file)``."""
    edges = cut(edges)
    seeds = symbols.join(files, "file", "left_semi").select("node")
    both = levels(edges, seeds, up, True).withColumn("direction", F.lit("up")).unionByName(levels(edges, seeds, down).withColumn("direction", F.lit("down")))
    placed = both.join(symbols, "node", "left").groupBy("direction", "depth", "file").agg(F.count_distinct("node").alias("n"))
    order = Window.partitionBy("direction", "depth").orderBy(F.col("file").asc_nulls_last())
    named = placed.withColumn("r", F.row_number().over(order)).where((F.col("r") <= labels) & F.col("file").isNotNull())
    first = named.groupBy("direction", "depth").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("labels"))
    sums = placed.groupBy("direction", "depth").agg(F.sum("n").alias("symbols"), F.count("file").alias("files"))
    out = sums.join(first, ["direction", "depth"], "left")
    return out.select("direction", "depth", "symbols", "files", F.coalesce("labels", F.lit("")).alias("labels"), F.greatest(F.lit(0), F.col("files").cast("int") - labels).alias("more"))


def dependencies(imports: DataFrame, indexed: DataFrame, files: DataFrame, direction: str = "both", depth: int = 2) -> DataFrame:
    """``(direction, depth, file, label)`` over ``imports(file, imported)``: what imports the given ``files(file)``, what they
    import, or both, by levels. Files that are not among ``indexed(file)`` are labelled so; seeds that aren't are ignored."""
    if direction not in ("up", "down", "both"):
        raise ValueError("direction must be one of up/down/both")
    edges = cut(imports.select(F.col("file").alias("caller"), F.col("imported").alias("callee")).where("caller is not null and callee is not null").distinct())
    seeds = files.join(indexed.select("file").distinct(), "file", "left_semi").select(F.col("file").alias("node"))
    walks = [levels(edges, seeds, depth, way == "up").withColumn("direction", F.lit(way)) for way in ("up", "down") if direction in (way, "both")]
    known = indexed.select(F.col("file").alias("node"), F.lit(True).alias("known")).distinct()
    both = reduce(DataFrame.unionByName, walks).join(known, "node", "left")
    return both.select("direction", "depth", F.col("node").alias("file"), F.when(F.col("known"), F.col("node")).otherwise(F.concat("node", F.lit(" (not indexed)"))).alias("label"))


def adjacency(edges: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between known symbols, and the counts of those skipped because an end is unknown."""
    ends = edges.join(symbols.select(F.col("node").alias("caller"), F.lit(1).alias("c")), "caller", "left").join(symbols.select(F.col("node").alias("callee"), F.lit(1).alias("d")), "callee", "left")
    return ends.where("c = 1 and d = 1").drop("c", "d"), ends.agg(F.count_if(F.expr("c is null or d is null")).alias("skipped"), F.count("*").alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, fan_in, fan_out, degree)`` of every end of an edge."""
    ends = edges.select(F.col("caller").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("callee").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.count("*").alias("degree"))


def shortest_path(edges: DataFrame, source, target, rounds: int = 15, budget: int = 2000, steps: dict[bool, Steps] | None = None) -> list | None:
    """Nodes of a shortest path found from both ends, a level of each a round; parents of least node win ties, and of several
    meeting places the least. None beyond the rounds, or once more nodes than the budget were seen at the start of a round.
    Parents are looked up one at a time; no table of them reaches the driver. ``steps``, forwards and backwards, may be given where
    several paths share them."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    kind = edges.schema["caller"].dataType.simpleString()
    begin = lambda x: spark.range(1).select(F.lit(x).cast(kind).alias("node"), F.lit(None).cast(kind).alias("parent"))
    seen = {False: begin(source), True: begin(target)}
    front, size, wide = dict(seen), 2, {False: 1, True: 1}
    if steps is None:
        edges = cut(edges)
        steps = {reverse: Steps(edges, reverse) for reverse in (False, True)}

    def back(side: bool, node) -> list:
        out = []
        while (row := seen[side].where(F.col("node") == F.lit(node)).select("parent").first()) is not None and row[0] is not None:
            node = row[0]
            out.append(node)
        return out

    for _ in range(rounds):
        if size > budget:
            return None
        for reverse in (False, True):
            new = steps[reverse].after(front[reverse], wide[reverse]).groupBy("next").agg(F.min("node").alias("parent")).select(F.col("next").alias("node"), "parent")
            front[reverse] = cut(new.join(seen[reverse].select("node"), "node", "left_anti"))
            wide[reverse] = front[reverse].count()
            size += wide[reverse]
            seen[reverse] = seen[reverse].unionByName(front[reverse])
            meet = front[reverse].join(seen[not reverse].select("node"), "node").agg(F.min("node")).first()[0]
            if meet is not None:
                return [*back(False, meet)[::-1], meet, *back(True, meet)]
        if not any(wide.values()):
            return None
    return None


def edge_label(provenance: Column, via: Column) -> Column:
    """What a step of a flow is called."""
    made = F.when(via.isNotNull(), F.concat(F.lit("synthesized [via: "), via, F.lit("]"))).otherwise("synthesized")
    return F.when(provenance == "inferred", made).when(provenance == "speculative", "call [speculative resolution]").when(provenance == "probable", "call [name-match]").otherwise("call")


def flow(edges: DataFrame, stops: list, rounds: int = 15, budget: int = 2000, labelled: DataFrame | None = None) -> DataFrame:
    """``(segment, step, node, label, hops, found)``: the nodes of a path between each two stops that follow each other, the
    first with step 0 and no label. Two stops without a path, or one that is None, give one row that is not found.
    ``labelled`` is ``(caller, callee, provenance, via)``; of several edges between two nodes the least by name counts."""
    spark, rows = edges.sparkSession, []
    edges = cut(edges)
    steps = {reverse: Steps(edges, reverse) for reverse in (False, True)}
    for k, (a, b) in enumerate(zip(stops, stops[1:]), 1):
        path = shortest_path(edges, a, b, rounds, budget, steps) if a is not None and b is not None else None
        if path is None:
            rows.append((k, 0, a, None, None, False))
        for step, node in enumerate(path or []):
            rows.append((k, step, node, path[step - 1] if step else None, len(path) - 1, True))
    kind = edges.schema["caller"].dataType.simpleString()
    out = spark.createDataFrame(rows, f"segment int, step int, node {kind}, caller {kind}, hops int, found boolean")
    if labelled is None:
        return out.select("segment", "step", "node", F.when(F.col("caller").isNotNull(), "call").alias("label"), "hops", "found")
    # as many rows as the paths have steps
    taken = F.broadcast(out.select("caller", F.col("node").alias("callee")).where("caller is not null").distinct())
    least = labelled.join(taken, ["caller", "callee"], "left_semi").groupBy("caller", F.col("callee").alias("node")).agg(F.min(F.struct("provenance", "via")).alias("m"))
    named = out.join(least, ["caller", "node"], "left")
    return named.select("segment", "step", "node", F.when(F.col("caller").isNotNull(), edge_label(F.col("m.provenance"), F.col("m.via"))).alias("label"), "hops", "found")


def named_symbols(symbols: DataFrame, names: list[str]) -> DataFrame:
    """``(name, node, hint)`` of the symbols ``(node, file, symbol, short_name)`` that each name may mean: ``path:name`` within
    paths that contain it, ``Class.method`` or ``ns::name`` by its last part with the rest as a hint, or a bare name. A hint that
    some candidate's file or name contains keeps only those that do."""
    out = None
    for name in names:
        path, hint, last = "", "", name
        if "/" in name and ":" in name:
            path, last = name.rsplit(":", 1)
        elif "::" in name or "." in name:
            hint, last = name.rsplit("::" if "::" in name else ".", 1)
        found = symbols.where((F.col("symbol") == last) | (F.col("short_name") == last)).where(F.contains("file", F.lit(path)))
        whole = F.lower(F.concat("file", F.lit("::"), "symbol"))
        one = found.select(F.lit(name).alias("name"), "node", F.contains(whole, F.lit(hint.lower())).alias("hint"))
        out = one if out is None else out.unionByName(one)
    best = out.groupBy("name").agg(F.max("hint").alias("some"))
    return out.join(best, "name").where("hint = some").select("name", "node", "hint")


def choose_symbol(candidates: DataFrame, edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Of several candidates ``(name, node)`` for a name the one to take: within two steps of what is resolved already
    first, then by degree, shorter and lesser nodes first."""
    edges = cut(edges)
    both = edges.unionByName(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")))
    near = levels(both, resolved, 2).select("node", F.lit(1).alias("near"))
    ranked = candidates.join(near, "node", "left").join(degrees(edges).select("node", "degree"), "node", "left")
    order = F.struct(-F.coalesce("near", F.lit(0)), -F.coalesce("degree", F.lit(0)), F.length(F.col("node").cast("string")), F.col("node").cast("string"))
    return ranked.withColumn("o", order).groupBy("name").agg(F.min_by("node", "o").alias("node"), F.count("*").alias("candidates"))


def affected(edges: DataFrame, touched: DataFrame, changed_names: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a change makes resolve anew, over ``(edge, file, callee, callee_file, provenance)``: the edges, but for derived ones,
    of ``touched(file)``, to ``changed_names(name)`` or in ``hosts(file)``, whose imports may now mean something else; and
    the files ``(file)`` whose derived facts may differ by it: those touched, those of the edges and what the edges led to."""
    direct = edges.where(~F.coalesce(F.col("provenance") == "inferred", F.lit(False)))
    near = touched.select("file").unionByName(hosts.select("file")).distinct().withColumn("near", F.lit(True))
    named = changed_names.select(F.col("name").alias("callee")).distinct().withColumn("named", F.lit(True))
    hit = direct.join(near, "file", "left").join(named, "callee", "left").where("near or named").select(*edges.columns)
    files = touched.select("file").unionByName(hit.select("file")).unionByName(hit.select(F.col("callee_file").alias("file")))
    return hit, files.where("file is not null").distinct()


def import_hosts(bindings: DataFrame, changed: DataFrame) -> DataFrame:
    """``(file)``: those with a binding ``(file, module)`` outside the standard library whose file may be one of the paths that
    were added or removed, ``changed(path)``."""
    place = F.replace("module", F.lit("."), F.lit("/"))
    wanted = bindings.where((F.col("module") != "") & ~F.split("module", r"\.")[0].isin(*sorted(sys.stdlib_module_names)))
    wanted = wanted.select("file", F.explode(F.array(F.concat(place, F.lit(".py")), F.concat(place, F.lit("/__init__.py")))).alias("suffix"))
    parts = F.split("path", "/")
    ends = changed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("suffix")).distinct()
    return wanted.join(ends, "suffix", "left_semi").select("file").distinct()
