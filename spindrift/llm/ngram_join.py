"""N-gram Jaccard self-join by prefix filters under several global token orders.

A text's set holds its distinct runs of five words (64-bit hashes; two different runs share one with probability 2^-64).
Equal sets have equal hashes of 126 bits; they go by 62 of these, and by the others where two sets share the first.
Two sets of Jaccard similarity t or more share at least l tokens within their prefixes - the first n - ceil(t n) + l tokens -
under *every* global order of the tokens, for every l up to the overlap that they need. Candidates come from an inverted
index over the prefixes of a first order, which puts common tokens last and must give ``AGREE`` shared tokens; they stay only
if their prefixes under the further orders meet too, and are then compared exactly.

Rows never meet pairwise inside a group of copies. Equal sets are one node. A posting with two nodes is a pair as it stands,
from a ``min`` and a ``max`` that combine before the shuffle. Short postings give their pairs. Long postings offer their members
against the node that most postings hold; those that still hold several components after that are dealt again under an order
by exact rarity, where nodes meet the most held one once more and then only nodes of other components. No pair that could link different components is left out,
so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm import bitmap, textcore
from spindrift.llm.components import components
from spindrift.llm.staging import discard, release, stage

WIDTH = 5
PERCENT = 75
#: Postings of up to so many nodes give all their pairs.
SHORT = 32
#: Prefix tokens that a pair must share, where its sets are that large.
AGREE = 3
#: Tokens that more texts than this hold within their prefixes by hash are common: they come last in the first order.
COMMON = 16
#: 64-bit words of a set's sketch: each token flips one bit, so sketches differ in at most as many bits as sets in tokens.
SKETCH = 16
_ORDERS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D))


def prefix_length(n, percent: int, agree: int = 1):
    """Prefix tokens of a set of ``n``: enough that similar sets share ``agree`` of them, or all that they need if fewer."""
    need = (percent * n + 99) // 100
    return n - need + min(agree, need)


def token_sets(part: pa.RecordBatch, column: str, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ascending distinct shingle hashes of each text."""
    data, offsets = textcore.buffers(part.column(part.schema.get_field_index(column)))
    hashes, at = textcore.shingles(*textcore.word_hashes(data, offsets), width)
    for row in range(part.num_rows):
        one = np.sort(hashes[at[row] : at[row + 1]])
        if len(one):
            one = one[np.concatenate(([True], one[1:] != one[:-1]))]
        yield row, one


def signature(tokens: np.ndarray) -> int:
    """Name of a set: the upper 62 bits are a hash of the whole, the lower two hold the size up to ``AGREE``."""
    return _whole(tokens, _ORDERS[0], _ORDERS[1]) & ~3 | min(len(tokens), AGREE)


def twin(tokens: np.ndarray) -> int:
    """A second hash of the whole, independent of the first; also a name."""
    return _whole(tokens, _ORDERS[1], np.uint64(0x9FB21C651E98DF25)) & ~3 | min(len(tokens), AGREE)


def _whole(tokens: np.ndarray, times: np.uint64, plus: np.uint64) -> int:
    return int(textcore.mix(np.atleast_1d(textcore.mix(tokens * times + plus).sum(dtype=np.uint64) + np.uint64(len(tokens))))[0])


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens that fall on each bit."""
    bit = (tokens * _ORDERS[1]) >> np.uint64(64 - 6 - (SKETCH - 1).bit_length())
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


@dataclass
class Elected:
    """Which rows stand for the sets: a bitmap of the least id of each set, and the names that several sets share, which
    go by their second hash instead."""

    ids: np.ndarray | None
    shared: frozenset[int] = frozenset()

    def name(self, tokens: np.ndarray) -> int:
        sig = signature(tokens)
        return twin(tokens) if self.shared and sig in self.shared else sig


def _fresh(batches: Iterator[pa.RecordBatch], use: Elected, width: int, seen_limit: int = 100_000) -> Iterator[tuple[int, np.ndarray]]:
    """Name and set of each elected row; copies that the same task saw lately are passed over."""
    seen: set[int] = set()
    for batch in batches:
        ids = batch.column(0)
        near = bitmap.passes(use.ids, textcore.mix(ids.fill_null(0).to_numpy().view(np.uint64)))
        batch = batch.filter(pa.array(near | ids.is_null().to_numpy(zero_copy_only=False)))
        for part in textcore.slices(batch, "text"):
            for _, tokens in token_sets(part, "text", width):
                if len(tokens) and (sig := use.name(tokens)) not in seen:
                    if len(seen) >= seen_limit:
                        seen.clear()
                    seen.add(sig)
                    yield sig, tokens


def _as_long(values: list) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def with_sets(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, shared: frozenset[int] = frozenset()) -> DataFrame:
    """``docs`` with ``__sig``, ``__twin`` and ``__n``: both hashes and the size of each row's set; the hashes are null for an
    empty one. Names in ``shared`` give way to the second hash."""
    names = docs.columns
    at, use = names.index(text), Elected(None, shared)

    def rows(batches):
        for batch in batches:
            for part in textcore.slices(batch, text):
                sigs, twins, sizes = [], [], []
                for _, tokens in token_sets(part, text, width):
                    sizes.append(len(tokens))
                    sigs.append(use.name(tokens) if len(tokens) else 0)
                    twins.append(twin(tokens) if len(tokens) else 0)
                sizes = np.array(sizes, dtype=np.int64)
                hashes = (pa.array(np.array(x, dtype=np.uint64).view(np.int64), mask=sizes == 0) for x in (sigs, twins))
                yield pa.RecordBatch.from_arrays([*part.columns, *hashes, pa.array(sizes)], names=[*names, "__sig", "__twin", "__n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(textcore.tidy(rows), f"{schema}, __sig long, __twin long, __n long")


def _prefixes(docs: DataFrame, use: Elected, width: int, prefix, schema: str) -> DataFrame:
    """What ``prefix(sig, tokens)`` gives for each elected row: arrays of one length, in bounded batches."""
    shared = docs.sparkSession.sparkContext.broadcast(use)
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches):
        out, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out)], names=names)

        for sig, tokens in _fresh(batches, shared.value, width):
            out.append(prefix(sig, tokens))
            held += len(out[-1][0])
            if held > 100_000:
                yield flush()
                out, held = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(textcore.tidy(rows), schema)


def common_tokens(docs: DataFrame, use: Elected, width: int, percent: int) -> DataFrame:
    """``(token)``: those that more than ``COMMON`` sets hold in their prefixes by hash alone."""
    found = _prefixes(docs, use, width, lambda _, tokens: (tokens[: prefix_length(len(tokens), percent, AGREE)],), "token long")
    return found.groupBy("token").agg(F.count("*").alias("texts")).where(F.col("texts") > COMMON).select("token")


def postings(docs: DataFrame, use: Elected, width: int, percent: int, common: np.ndarray | None, keep: np.ndarray | None = None) -> DataFrame:
    """``(token, sig)`` for the prefix tokens of each set under the first order: those in the bitmap of common tokens last,
    else by hash. With ``keep``, only tokens that pass that bitmap are returned."""
    sc = docs.sparkSession.sparkContext
    last, wanted = sc.broadcast(common), sc.broadcast(keep)

    def prefix(sig, tokens):
        p = prefix_length(len(tokens), percent, AGREE)
        if last.value is None:
            head = tokens[:p]
        else:
            late = bitmap.passes(last.value, tokens)
            head = tokens[~late][:p]
            if len(head) < p:
                head = np.concatenate((head, tokens[late][: p - len(head)]))
        if wanted.value is not None:
            head = head[bitmap.passes(wanted.value, head)]
        return head, np.full(len(head), sig, dtype=np.uint64)

    return _prefixes(docs, use, width, prefix, "token long, sig long")


def _sets_of(docs: DataFrame, use: Elected, sigs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(sig, n, sketch, p2, p3, tokens)`` of the given nodes: the sketch, the prefixes under the further orders and the whole
    set. A node may occur again where a row that was not elected passed the bitmap."""
    sc = docs.sparkSession.sparkContext
    shared, keep = sc.broadcast(use), sc.broadcast(bitmap.build(sigs.select(F.shiftright("sig", 2).alias("sig")), "sig"))

    def rows(batches):
        out = []

        def flush():
            flat = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r[k]) for r in out]))), pa.int32()), pa.array(np.concatenate([r[k] for r in out]).view(np.int64))) for k in (2, 3, 4, 1)]
            return pa.RecordBatch.from_arrays([_as_long([r[0] for r in out]), pa.array([len(r[1]) for r in out], pa.int64()), *flat], names=["sig", "n", "sketch", "p2", "p3", "tokens"])

        held = 0
        for sig, tokens in _fresh(batches, shared.value, width):
            if bitmap.passes(keep.value, np.array([sig >> 2], dtype=np.uint64))[0]:
                p = prefix_length(len(tokens), percent)
                out.append((sig, tokens, sketch(tokens), *(tokens[np.argsort(textcore.mix(tokens ^ o), kind="stable")[:p]] for o in _ORDERS)))
                held += len(tokens)
                if held > 100_000:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return docs.mapInArrow(textcore.tidy(rows), "sig long, n long, sketch array<long>, p2 array<long>, p3 array<long>, tokens array<long>")


def _near(percent: int) -> str:
    """Whether sizes and sketches allow the similarity: similar sets differ in a bounded number of tokens, and sketches in as
    many bits at most."""
    apart = " + ".join(f"bit_count(sketch_a[{k}] ^ sketch_b[{k}])" for k in range(SKETCH))
    return f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and {100 + percent} * ({apart}) <= {100 - percent} * (n_a + n_b)"


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that pass all filters and have Jaccard similarity ``percent`` / 100 or more. Sizes and sketches
    travel with every pair; prefixes under the further orders and whole sets only with what those leave."""

    def both(rows: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
        side = lambda x: sets.select(F.col("sig").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))
        return rows.join(side("a"), "a").join(side("b"), "b")

    near = both(pairs, _narrow(sets), "n", "sketch").where(_near(percent)).select("a", "b")
    near = both(near, sets, "n", "p2", "p3", "tokens").where(F.arrays_overlap("p2_a", "p2_b")).where(F.arrays_overlap("p3_a", "p3_b"))
    whole = near.withColumn("common", F.size(F.array_intersect("tokens_a", "tokens_b")))
    return whole.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b").distinct()


def _narrow(sets: DataFrame) -> DataFrame:
    """``(sig, n, sketch)``, one row for each node."""
    return sets.groupBy("sig").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch"))


def _to_hub(members: DataFrame) -> DataFrame:
    """Each posting's members against the one of them that most postings hold: what others were copied from."""
    degree = members.groupBy("sig").agg(F.count("*").alias("degree"))
    hubs = members.join(degree, "sig").groupBy("token").agg(F.max_by("sig", F.col("degree") * F.lit(1 << 40) + F.expr("sig & 1099511627775")).alias("hub"))
    pairs = members.join(hubs, "token").where("sig <> hub").select(F.least("sig", "hub").alias("a"), F.greatest("sig", "hub").alias("b"))
    return pairs.distinct()


def _within(members: DataFrame) -> DataFrame:
    """All pairs within each posting, once for each posting."""
    return members.select("token", F.col("sig").alias("a")).join(members.select("token", F.col("sig").alias("b")), "token").where("a < b").select("a", "b")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(token, sig, label)``: the postings that still hold more than one component."""
    labels = components(links).withColumnRenamed("node", "sig")
    named = stage(members.join(labels, "sig", "left").select("token", "sig", F.coalesce("label", "sig").alias("label")))
    open_ = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    return named.join(open_, "token", "left_semi")


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs between different components within each posting, but for those whose sizes or sketches rule them out: what
    is left of a crowded posting after its links are found is compared here within the join, and only few pairs leave it."""
    full = members.join(_narrow(sets), "sig")
    side = lambda x: full.select("token", F.col("sig").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("label", "n", "sketch")))
    one, other = side("a"), side("b")
    fit = F.expr(f"a < b and label_a <> label_b and {_near(percent)}")
    return one.join(other, (one["token"] == other["token"]) & fit).select("a", "b").distinct()


def _by_rarity(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(token, sig)`` prefixes of these nodes under the order by how many of them hold a token, rarest first."""
    nodes = stage(members.select("sig").distinct())
    own = sets.join(nodes, "sig", "left_semi").groupBy("sig").agg(F.min("n").alias("n"), F.min("tokens").alias("tokens"))
    tokens = own.select("sig", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = tokens.join(counts, "token")
    # tokens that one node alone holds come first in the order; they can't be shared and only use up prefix places
    alone = own.select("sig", "n").join(common.groupBy("sig").agg(F.count("*").alias("m")), "sig", "left")
    room = alone.select("sig", (F.expr(f"n - (({percent} * n + 99) div 100) + 1") - (F.col("n") - F.coalesce("m", F.lit(0)))).alias("room")).where("room > 0")
    ranked = common.join(room, "sig").withColumn("r", F.row_number().over(Window.partitionBy("sig").orderBy("df", "token")))
    return ranked.where("r <= room").select("token", "sig")


def links(docs: DataFrame, use: Elected, width: int = WIDTH, percent: int = PERCENT, short: int = SHORT) -> DataFrame:
    """Links ``(a, b)`` between the names of sets whose components are those of all links. ``docs`` is ``(id, text)``."""
    common = bitmap.build(common_tokens(docs, use, width, percent), "token")
    sums = postings(docs, use, width, percent, common).groupBy("token").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.count("*").alias("c"))
    spark = docs.sparkSession
    found = stage(sums.where("a <> b"))
    release(spark)
    crowded = found.where("c > 2").select("token")
    members = stage(postings(docs, use, width, percent, common, bitmap.build(crowded, "token")).join(crowded, "token", "left_semi").distinct())
    release(spark)
    sizes = members.groupBy("token").agg(F.count("*").alias("size"))
    few, many = members.join(sizes.where(F.col("size") <= short), "token", "left_semi"), stage(members.join(sizes.where(F.col("size") > short), "token", "left_semi"))
    pairs = found.where("c = 2").select("a", "b").unionByName(_within(few)).groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = stage(pairs.where(F.col("shared") >= F.least(F.expr("a & 3"), F.expr("b & 3"))).select("a", "b"))
    discard(found)
    discard(members)
    release(spark)
    pairs, found = stage(pairs.unionByName(_to_hub(many)).distinct()), pairs
    discard(found)
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig")))
    sets = stage(_sets_of(docs, use, ends, width, percent))
    release(spark)
    good = stage(verified(pairs, sets, percent))
    release(spark)
    left = stage(_open(many, good))
    if not left.isEmpty():
        dealt = stage(_by_rarity(left, sets, percent))
        good = stage(good.unionByName(verified(_to_hub(dealt), sets, percent)))
        good = stage(good.unionByName(verified(_across(stage(_open(dealt, good)), sets, percent), sets, percent)))
        discard(dealt)
        release(spark)
    for used in (many, pairs, sets, left):
        discard(used)
    return good


def _grouped(docs: DataFrame, text: str, id: str, width: int, percent: int, short: int) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """``(id, sig, n)`` of all rows; ``(sig, first, label)`` with the least id of each set and the least name that links reach;
    and the names that go by their second hash."""
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    named = stage(with_sets(source, "text", "id", width).select("id", F.col("__sig").alias("sig"), F.col("__twin").alias("twin"), F.col("__n").alias("n")))
    clash = lambda rows: rows.where("sig is not null").groupBy("sig").agg(F.min("twin").alias("x"), F.max("twin").alias("y")).where("x <> y").select("sig")
    # of 10^10 sets about three pairs share 62 bits
    shared = frozenset(r["sig"] & (1 << 64) - 1 for r in clash(named).toLocalIterator())
    if shared:
        named = stage(named.join(F.broadcast(clash(named).withColumn("clash", F.lit(True))), "sig", "left").withColumn("sig", F.when(F.col("clash"), F.col("twin")).otherwise(F.col("sig"))).drop("clash"))
        if not clash(named).isEmpty():
            raise RuntimeError("different sets share both hashes")
    named = named.drop("twin")
    firsts = stage(named.where("sig is not null").groupBy("sig").agg(F.min("id").alias("first")))
    use = Elected(bitmap.build(_mixed(firsts.where("first is not null")), "first"), shared)
    labels = components(links(source, use, width, percent, short))
    reps = stage(firsts.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", F.coalesce("label", "sig").alias("label")))
    return named, reps, shared


def _mixed(ids: DataFrame) -> DataFrame:
    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(textcore.mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["first"])

    return ids.select("first").mapInArrow(rows, "first long")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, short: int = SHORT) -> DataFrame:
    """``(id, n_shingles, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id that links reach, the row's own included. Nulls and texts without words have an
    empty set: they link with nothing and keep their own id. Repeated rows and equal texts share a component. A null id is
    never the smallest; a component of null ids only has a null id. Texts of any length are taken whole, by blocks of bytes;
    ties can't occur, as only the least id counts. Columns other than ``id`` and ``text`` are not read, whatever their names;
    an empty table gives an empty result.
    """
    named, reps, _ = _grouped(docs, text, id, width, percent, short)
    least = reps.groupBy("label").agg(F.min("first").alias("component_id"))
    final = reps.join(least, "label").select("sig", "component_id")
    out = named.join(final, "sig", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, text: str = "text", id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT, short: int = SHORT) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, with all its columns.

    It is a row of the least id whose set belongs to the group; of several such rows the one of least text stays. An empty
    set is a group for each id, as it is linked with nothing. Rows are told apart by id and set, so that a row whose id
    stands for another group as well is kept or dropped by its own text. A null id comes after all others.
    """
    _, reps, shared = _grouped(docs, text, id, width, percent, short)
    least = reps.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "sig")).alias("m"))
    key = lambda c: (F.coalesce(c, F.lit(0)).alias("__i"), c.isNull().alias("__z"))
    chosen = stage(least.select(F.col("m.sig").alias("__s"), *key(F.col("m.first"))))
    rows = with_sets(docs, text, id, width, shared).withColumn("__s", F.coalesce("__sig", F.lit(0)))
    rows = rows.select("*", *key(F.col(id).cast("long")))
    empty = rows.where("__s = 0").select("__s", "__i", "__z").distinct()
    kept = rows.join(chosen.unionByName(empty), ["__s", "__i", "__z"], "left_semi")
    order = Window.partitionBy("__s", "__i", "__z").orderBy(text)
    return kept.withColumn("__r", F.row_number().over(order)).where("__r = 1").select(*docs.columns)
