"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least m + 1 - q (k + 1) q-grams with the place,
on diagonals (position in the text less position in the item) that lie within k + 1 of each other. Shared q-grams are counted
in overlapping bands of diagonals; bands that reach the bound are verified by a banded alignment, adjacent ones as one band.

Q-grams that an item repeats over ``REPEATS`` times would meet a repetitive text at any diagonal. They are left out of the
count, and the bound is lowered by as many, as each edit still spoils q places at most. Items that have too few others are
looked for wherever a text holds enough of their q-grams at all: these stretches are one band each. So the work on a text is
bounded by its length times the items', and what is held at once by ``EXPANDED`` and ``WIDE``.

Texts are only read once, with no shuffle; the benchmark is held in blocks of bounded size, and each block passes over all
texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textcore

Q = 12
RATE = 0.05
#: The bound is kept at this at least, by lowering the edit budget of short items.
LEAST = 4
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 8 << 20
#: Places of a q-gram in one item beyond which it is not counted by diagonals.
REPEATS = 8
#: Shared q-grams that are expanded at once, and diagonals that are aligned at once.
EXPANDED, WIDE = 1 << 20, 1 << 15

_A = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str | None) -> str:
    """Lower-cased, with every run of white space as one blank and none at the ends."""
    return " ".join((text or "").lower().split())


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed for an item of ``m`` characters: ``rate * m``, less where the lemma's bound would fall under ``LEAST``."""
    return max(0, min(int(rate * m), (m + 1 - LEAST) // q - 1))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    have, span, power = points.astype(np.uint64) + np.uint64(1), 1, _A
    parts: list[tuple[np.ndarray, int, np.uint64]] = []
    rest = q
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                parts.append((have, span, power))
            rest >>= 1
            if rest:
                have, span, power = have[: len(have) - span] * power + have[span:], span * 2, power * power
        out, at = np.zeros(n, dtype=np.uint64), 0
        for values, width, power in parts:
            out = out * power + values[at : at + n]
            at += width
    return textcore.mix(out)


@dataclass
class Index:
    ids: list
    texts: list[str]
    points: list[np.ndarray]
    sizes: np.ndarray
    budgets: np.ndarray
    bounds: np.ndarray  #: counted q-grams that a place within the budget shares
    screen: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray  #: -1 for an item that is not counted by diagonals, once for each of its q-grams
    plain: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  #: by length, hashes and numbers of items shorter than q
    q: int


def index(ids: list, texts: list[str | None], q: int = Q, rate: float = RATE) -> Index:
    """Postings of the items' q-grams. Items shorter than q are searched for as they are; empty ones never match."""
    texts = [normalise(t) for t in texts]
    points = [_points(t) for t in texts]
    sizes = np.array([len(p) for p in points], dtype=np.int64)
    budgets = np.array([budget(int(m), q, rate) for m in sizes], dtype=np.int64)
    bounds, plain = np.maximum(1, sizes + 1 - q * (budgets + 1)), np.ones(len(texts), dtype=bool)
    flat, item, place = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i, p in enumerate(points):
        own = _grams(p, q)
        kinds, inverse, count = np.unique(own, return_inverse=True, return_counts=True)
        counted = np.flatnonzero(count[inverse] <= REPEATS)
        left = int(bounds[i]) - (len(own) - len(counted))
        if len(own) and left < 1:
            plain[i] = False
            flat, item, place = [*flat, kinds], [*item, np.full(len(kinds), i)], [*place, np.full(len(kinds), -1)]
        else:
            bounds[i] = max(1, left)
            flat, item, place = [*flat, own[counted]], [*item, np.full(len(counted), i)], [*place, counted]
    flat, item, place = np.concatenate(flat), np.concatenate(item), np.concatenate(place)
    order = np.argsort(flat, kind="stable")
    flat, item, place = flat[order], item[order], place[order]
    grams, first = np.unique(flat, return_index=True)
    screen = np.zeros(1 << 20, dtype=bool)
    screen[(grams >> np.uint64(44)).astype(np.int64)] = True
    short = {}
    for m in sorted({int(m) for m in sizes if 0 < m < q}):
        own = np.flatnonzero(sizes == m)
        keys = np.array([_grams(points[i], m)[0] for i in own], dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        short[m] = keys[order], own[order]
    return Index(ids, texts, points, sizes, budgets, bounds, screen, grams, np.append(first, len(flat)), item, place, plain, short, q)


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a piece of ``text`` over the diagonals from ``low`` to ``high``, and where that
    piece ends, if at most ``k``."""
    width = high - low + 1
    far = k + 1
    steps = np.arange(width)
    begin = np.arange(low, high + 1)
    row = np.where((begin >= 0) & (begin <= len(text)), 0, far).astype(np.int64)
    padded = np.full(len(item) + width, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + len(padded))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    inside = np.zeros(len(padded) + 1, dtype=bool)
    inside[max(0, -low) : max(0, len(text) - low + 1)] = True
    for i in range(1, len(item) + 1):
        new = row + (padded[i - 1 : i - 1 + width] != item[i - 1])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new = np.where(inside[i : i + width], new, far)
        row = np.minimum(np.minimum.accumulate(new - steps) + steps, far)
        row = np.where(inside[i : i + width], row, far)
        if row.min() > k:
            return None
    best = int(row.argmin())
    return int(row[best]), low + best + len(item)


def align_wide(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int] | None:
    """``align`` over any number of diagonals, some at a time: an alignment within the budget keeps to k + 1 of them."""
    best = None
    for a in range(low, high + 1, WIDE):
        seen = align(item, text, a, min(high, a + WIDE + 2 * k), k)
        if seen is not None and (best is None or seen < best):
            best = seen
        if best is not None and best[0] == 0:
            break
    return best


def _pieces(count: np.ndarray, most: int):
    """Slices of positions whose counts add up to about ``most``."""
    part = np.cumsum(count) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(count)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts."""
    if len(keys) == 1:
        return keys[0], counts[0]
    all_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return all_, np.bincount(inverse, np.concatenate(counts), len(all_)).astype(np.int64)


def search(idx: Index, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """For each normalised text: ``(item, distance, end)`` of the items that occur within their budgets."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    points = _points("".join(texts))
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begin = np.append(0, ends)
    for m, (keys, numbers) in idx.short.items():
        grams = _grams(points, m)
        if not len(grams):
            continue
        at = np.flatnonzero(np.isin(grams, keys))
        doc = np.searchsorted(ends, at, side="right")
        once = np.unique(np.stack((doc, grams[at].astype(np.uint64).view(np.int64)), axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.int64)
        for d, g in once.tolist():
            g = np.uint64(g & (1 << 64) - 1)
            for i in numbers[np.searchsorted(keys, g) : np.searchsorted(keys, g, side="right")].tolist():
                if (p := texts[d].find(idx.texts[i])) >= 0:
                    found[d].append((i, 0, p + m))
    if not len(idx.grams):
        return [sorted(x) for x in found]
    grams = _grams(points, idx.q)
    at = np.flatnonzero(idx.screen[(grams >> np.uint64(44)).astype(np.int64)])
    k = np.minimum(np.searchsorted(idx.grams, grams[at]), len(idx.grams) - 1)
    hit = idx.grams[k] == grams[at]
    at, k = at[hit], k[hit]
    doc = np.searchsorted(ends, at, side="right")
    whole = at + idx.q <= ends[doc] if len(at) else np.zeros(0, dtype=bool)
    at, k, doc = at[whole], k[whole], doc[whole]
    many = np.bincount(doc, minlength=len(texts)) >= idx.bounds.min()
    at, k, doc = at[many[doc]], k[many[doc]], doc[many[doc]]
    if not len(at):
        return [sorted(x) for x in found]
    n, count = len(idx.ids), idx.first[k + 1] - idx.first[k]

    def expanded(part: slice):
        """Pairs of text and item, positions and places of the shared q-grams."""
        to = np.cumsum(count[part])
        post = np.repeat(idx.first[k[part]] - (to - count[part]), count[part]) + np.arange(to[-1])
        return np.repeat(doc[part], count[part]) * n + idx.item[post], np.repeat(at[part], count[part]), idx.place[post]

    parts = _pieces(count, EXPANDED)
    seen = [np.unique(expanded(part)[0], return_counts=True) for part in parts]
    pairs, total = _summed([x for x, _ in seen], [x for _, x in seen])
    enough = total >= idx.bounds[pairs % n]
    pairs, total = pairs[enough], total[enough]
    spans: list[tuple[int, int, int, int]] = []
    for group in _pieces(total, 4 * EXPANDED):
        wanted, bands, counts, loose = pairs[group], [], [], []
        for part in parts:
            pair, position, place = expanded(part)
            w = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            keep = wanted[w] == pair
            w, position, place = w[keep], position[keep], place[keep]
            item, start = wanted[w] % n, begin[wanted[w] // n]
            free = place < 0
            loose.append(np.stack((w[free], position[free] - start[free]), axis=1))
            # bands of 2 (k + 1) diagonals, each k + 1 on from the one before
            w, step = w[~free], (idx.budgets[item] + 1)[~free]
            band = (position - start - place)[~free] // step
            key = np.tile(w, 2) * (1 << 32) + np.concatenate((band, band - 1)) + (1 << 31)
            one, times = np.unique(key, return_counts=True)
            bands.append(one)
            counts.append(times)
        bands, counts = _summed(bands, counts)
        w, band = bands >> 32, (bands & (1 << 32) - 1) - (1 << 31)
        full = counts >= idx.bounds[wanted[w] % n]
        w, band = w[full], band[full]
        edge = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (band[1:] - band[:-1] > 2)))) if len(w) else np.zeros(0, dtype=np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(w)]):
            p, i = int(wanted[w[a]]), int(wanted[w[a]] % n)
            k_ = int(idx.budgets[i])
            spans.append((p, i, int(band[a]) * (k_ + 1) - k_, int(band[b - 1]) * (k_ + 1) - k_ + 2 * (k_ + 1) - 1 + 2 * k_))
        loose = np.concatenate(loose)
        loose = loose[np.lexsort((loose[:, 1], loose[:, 0]))]
        reach = (idx.sizes + idx.budgets)[wanted % n]
        edge = np.flatnonzero(np.concatenate(([True], (loose[1:, 0] != loose[:-1, 0]) | (loose[1:, 1] - loose[:-1, 1] > reach[loose[1:, 0]])))) if len(loose) else np.zeros(0, dtype=np.int64)
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(loose)]):
            p = int(wanted[loose[a, 0]])
            if b - a >= idx.bounds[p % n]:
                spans.append((p, p % n, int(loose[a, 1]) - int(reach[loose[a, 0]]), int(loose[b - 1, 1]) + int(idx.budgets[p % n])))
    best: dict[int, tuple[int, int]] = {}
    for p, i, low, high in spans:
        if best.get(p, (1, 0))[0] == 0:
            continue
        d, size = p // n, int(idx.sizes[i])
        place = texts[d].find(idx.texts[i], max(0, low), max(0, high) + size)
        near = (0, place + size) if place >= 0 else align_wide(idx.points[i], points[begin[d] : begin[d + 1]], low, high, int(idx.budgets[i]))
        if near is not None and near < best.get(p, (1 << 30, 0)):
            best[p] = near
    for p, (distance, end) in best.items():
        found[p // n].append((p % n, distance, end))
    return [sorted(x) for x in found]


def _blocks(benchmark: DataFrame, text: str, id: str, block_bytes: int):
    """The benchmark's rows, a bounded number of bytes at a time."""
    items = benchmark.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") > 0).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow().to_pylist()
        yield sorted(rows, key=lambda r: (r["id"] is None, r["id"] or 0, r["text"]))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", q: int = Q, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: an array of (item_id, distance, start, end), one for each benchmark item that occurs in the
    row's whole text, however long or repetitive, within its edit budget; positions count characters of the normalised text,
    ``start`` up to the number of edits. Of several places the one of least distance counts, of those the first that ends. A
    column ``leaks`` is replaced. Null and empty texts and an empty benchmark give empty arrays; items with a null id are
    searched for like others, items listed twice count once; repeated rows get equal results; all other columns pass through.
    """
    base = docs.drop("leaks")
    names = base.columns
    kind = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", leaks {kind}"
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    out = base.withColumn("leaks", F.expr(f"cast(array() as {kind})"))
    for block in _blocks(benchmark, item_text, item_id, block_bytes):
        if not block:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(index([r["id"] for r in block], [r["text"] for r in block], q, rate))

        def rows(batches, shared=shared):
            idx, at = shared.value, names.index(text)
            for batch in batches:
                for part in textcore.slices(batch, text, textcore.BLOCK):
                    texts = [normalise(t) for t in part.column(at).to_pylist()]
                    before = part.column(len(names)).to_pylist()
                    leaks = [
                        [*old, *({"item_id": idx.ids[i], "distance": distance, "start": max(0, end - int(idx.sizes[i])), "end": end} for i, distance, end in new)]
                        for old, new in zip(before, search(idx, texts))
                    ]
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(leaks, arrow)], names=[*names, "leaks"])

        out = out.mapInArrow(textcore.tidy(rows), schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", id: str = "doc_id", **options) -> DataFrame:
    """``(id, item_id, distance, start, end)``: one row for each leak, in each row of ``docs`` that has one; null, empty and clean
    texts give none. Columns other than ``id`` and ``text`` are not read."""
    found = with_leaks(docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")), benchmark, **options)
    return found.select(F.col("id").alias(id), F.explode("leaks").alias("leak")).select(id, "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item occurs; null and empty texts stay, as often as they are repeated."""
    return with_leaks(docs, benchmark, text, **options).where(F.size("leaks") == 0).drop("leaks")
