"""Derived edges: an ordered list of functions from facts to edges, each applied to the same facts.

A synthesizer takes a dict of tables - ``patterns(pattern_type, signal, handler, line)``, ``bases(impl, base)``,
``traits(impl, base)``, ``methods(owner, name, node, line)``, ``pointers(owner, field, handler)``, ``fields(owner, field)`` and
``sites(caller, field, hint)`` - and gives ``(caller, callee, line, via)``. More may be appended.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import resolve

Synthesizer = Callable[[dict[str, DataFrame]], DataFrame]
_EDGE = ("caller", "callee", "line", "via")


def signals(facts: dict[str, DataFrame]) -> DataFrame:
    return resolve.signal_edges(facts["patterns"])


def interfaces(facts: dict[str, DataFrame]) -> DataFrame:
    return resolve.overrides(facts["bases"], facts["methods"], "interface-impl").withColumn("line", F.lit(0))


def traits(facts: dict[str, DataFrame]) -> DataFrame:
    return resolve.overrides(facts["traits"], facts["methods"], "trait-impl").withColumn("line", F.lit(0))


def pointers(facts: dict[str, DataFrame]) -> DataFrame:
    edges = resolve.pointer_dispatch(facts["fields"], facts["pointers"], facts["sites"])
    return edges.withColumn("line", F.lit(0)).withColumn("via", F.lit("fnptr-dispatch"))


SYNTHESIZERS: tuple[tuple[str, tuple[str, ...], Synthesizer], ...] = (
    ("signals", ("patterns",), signals),
    ("interfaces", ("bases", "methods"), interfaces),
    ("traits", ("traits", "methods"), traits),
    ("pointers", ("fields", "pointers", "sites"), pointers),
)


def run(facts: dict[str, DataFrame], synthesizers=SYNTHESIZERS) -> DataFrame:
    """The edges of all synthesizers whose tables are there, in their order; of equal ones (caller, callee, via) the first by
    line stays."""
    made = [f(facts).select(*_EDGE) for _, needs, f in synthesizers if all(t in facts for t in needs)]
    if not made:
        raise ValueError("no synthesizer has its tables")
    return reduce(DataFrame.unionByName, made).groupBy("caller", "callee", "via").agg(F.min("line").alias("line")).select(*_EDGE)
