"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

A whole batch is split into pieces by character classes, as the tokenizer's pattern would. Pieces not met before go, padded to
the bucket of their length, into matrices of token ids; each round every row merges its leftmost pair of minimum rank, looked
up in a hash table of pairs, and the row is compacted. Rows without a pair left are done. What pieces encode to is kept for
the worker in a table of bounded size, by a 64-bit hash; the decoded bytes are compared with the text, so that two pieces of
one hash could not go unnoticed.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textcore

#: Cells of one matrix; longest piece in bytes that is merged in a matrix.
CELLS, WIDEST = 1 << 20, 512
#: Pieces whose ids a worker keeps.
CACHE = 1 << 19
NONE = np.int32(1 << 30)

#: The pattern whose splitting ``pieces`` reproduces (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes by rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASSES:
        table = np.zeros(0x110000, dtype=np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                first, last = ord(m[0][0]), ord(m[0][-1])
                table[first : last + 1] = kind
        table[0xD800:0xE000] = _OTHER
        _CLASSES.append(table)
    return _CLASSES[0]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the pieces of all texts start, and where each text's begin among them (one more than texts)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(byte_at, offsets)] = True
    kind = _classes()[points]
    run = first[:n].copy()
    run[0] = True
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    gap, blank = kind == _SPACE, points == 32
    # the last white space before something else: a blank joins what follows, anything else stands alone
    before = np.flatnonzero(gap[:-1] & ~gap[1:] & ~first[1:n])
    start[before] = True
    start[before[blank[before]] + 1] = False
    # contractions, where a piece starts at their apostrophe
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[mark + 1 < n]
    mark = mark[run[mark + 1] & ~first[mark + 1] & (kind[mark + 1] == _LETTER)]
    if len(mark):
        x = points[mark + 1]
        y = np.where((mark + 2 < n) & ~first[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        one = np.isin(x, [115, 116, 109, 100])  # s t m d
        two = (np.isin(x, [114, 118]) & (y == 101)) | ((x == 108) & (y == 108))  # re ve ll
        start[mark[one | two] + 1] = False
        for end in (mark[one] + 2, mark[two] + 3):
            end = end[end < n]
            start[end[~gap[end] & (kind[end] == _LETTER)]] = True
    at = np.flatnonzero(start)
    where = byte_at[at]
    return where, np.searchsorted(where, offsets)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ragged slices, one after the other."""
    to = np.cumsum(lengths)
    return np.repeat(starts - (to - lengths), lengths) + np.arange(to[-1] if len(to) else 0)


class Rows:
    """Row numbers by 64-bit key, in sorted arrays; what was added since the last look-up is merged in then."""

    def __init__(self) -> None:
        self.keys, self.at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Of keys that are there already the first row stays."""
        self.new.append((keys, rows))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if self.new:
            fresh = np.concatenate([k for k, _ in self.new])
            order = np.argsort(fresh, kind="stable")
            fresh, rows = fresh[order], np.concatenate([r for _, r in self.new])[order].astype(np.int32)
            at = np.searchsorted(self.keys, fresh, side="right")
            self.keys, self.at, self.new = np.insert(self.keys, at, fresh), np.insert(self.at, at, rows), []
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, self.at[k], -1).astype(np.int64)


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values()) + 1
        by_rank = [b""] * self.size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.lengths = np.array([len(t) for t in by_rank], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_rank), dtype=np.uint8)
        self.label = [str(i) for i in range(self.size)].__getitem__
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.whole = Rows()
        if all(self.lengths):
            self.whole.add(textcore.hash_spans(self.bytes, self.starts, self.starts + self.lengths), np.arange(self.size))
        self._pair_table(ranks)
        self._empty()

    def _pair_table(self, ranks: dict[bytes, int]) -> None:
        """Open-addressed table from (left id, right id) to the rank of their concatenation."""
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    keys.append(left * self.size + right)
                    values.append(rank)
        self.keys, self.values, self.shift = _table(np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation; ``NONE`` where there is none or an id is negative (padding)."""
        pad = (left < 0) | (right < 0)
        keys = np.where(pad, 0, left).astype(np.uint64) * np.uint64(self.size) + np.where(pad, 0, right).astype(np.uint64)
        out = _find(self.keys, self.values, self.shift, keys.ravel(), NONE).reshape(keys.shape)
        out[pad] = NONE
        return out

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fully merged ids of each row, and how many; rows are padded with -1 at their ends."""
        out = np.full(ids.shape, -1, dtype=np.int32)
        rows = np.arange(len(ids))
        ids = np.concatenate((ids, np.full((len(ids), 2), -1, dtype=np.int32)), axis=1)
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            line = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            least = ranks[line, at]
            live = least != NONE
            if not live.all():
                over = ~live
                width = min(ids.shape[1], out.shape[1])
                out[rows[over], :width] = ids[over, :width]
                rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
                if not len(rows):
                    break
                width = int((ids >= 0).sum(axis=1).max()) + 2
                ids, ranks, line = ids[:, :width], ranks[:, : width - 1], np.arange(len(rows))
            # the merged token takes the left place; everything right of the pair moves one place left
            right = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            then = np.full(ids.shape, -1, dtype=np.int32)
            then[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
            then[line, at] = least
            after = np.full(ranks.shape, NONE, dtype=np.int32)
            after[:, :-1] = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ids, ranks = then, after
            ranks[line, at] = self.pair_ranks(least, ids[line, at + 1])
            has = at > 0
            line, at = line[has], at[has]
            ranks[line, at - 1] = self.pair_ranks(ids[line, at - 1], ids[line, at])
        return out, (out >= 0).sum(axis=1)

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same for one long row. All places of the least rank that merge in turn, leftmost first, without any new pair
        of that rank or a lesser one arising before the next, are merged in one round."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ids) > 1 and (least := ranks.min()) != NONE:
            places = np.flatnonzero(ranks == least)
            if len(places) > 1:  # overlapping places alternate within a run
                begin = np.concatenate(([True], np.diff(places) > 1))
                run = np.maximum.accumulate(np.where(begin, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
            follow = np.append(ids, np.int32(-1))[places + 2]
            low = self.pair_ranks(np.full(len(places), least, dtype=np.int32), follow) <= least
            lead = np.append(ids, np.int32(-1))[places - 1]
            lead[1:] = np.where(places[1:] - places[:-1] == 2, least, lead[1:])
            lead[places == 0] = -1
            low |= self.pair_ranks(lead, np.full(len(places), least, dtype=np.int32)) <= least
            if low.any():  # only up to the first merge that makes such a pair
                places = places[: int(np.flatnonzero(low)[0]) + 1]
            merged = ids.copy()
            merged[places] = least
            keep = np.ones(len(ids), dtype=bool)
            keep[places + 1] = False
            ids = merged[keep]
            ranks = self.pair_ranks(ids[:-1], ids[1:])
        return ids

    def _empty(self) -> None:
        self.row_of, self.rows = Rows(), 0
        self.store, self.used = np.zeros(1 << 16, dtype=np.int32), 0
        self.begin, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int32)

    def _keep(self, keys: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(flat) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        row = self.rows
        while row + len(keys) > len(self.begin):
            self.begin, self.count = np.concatenate((self.begin, np.zeros_like(self.begin))), np.concatenate((self.count, np.zeros_like(self.count)))
        self.store[self.used : self.used + len(flat)] = flat
        self.begin[row : row + len(keys)] = self.used + np.cumsum(counts) - counts
        self.count[row : row + len(keys)] = counts
        self.rows += len(keys)
        self.used += len(flat)
        self.row_of.add(keys, np.arange(row, row + len(keys)))

    def learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode distinct pieces, bucket by bucket of like length."""
        whole = self.whole.get(keys).astype(np.int32)
        known = whole >= 0
        self._keep(keys[known], whole[known], np.ones(known.sum(), dtype=np.int32))
        keys, starts, lengths = keys[~known], starts[~known], (ends - starts)[~known]
        for i in np.flatnonzero(lengths > WIDEST):
            found = self.merge_long(self.byte_ids[data[starts[i] : starts[i] + lengths[i]]])
            self._keep(keys[i : i + 1], found, np.array([len(found)], dtype=np.int32))
        bucket = np.where(lengths > WIDEST, 0, np.where(lengths <= 32, (lengths + 3) // 4 * 4, (lengths + 31) // 32 * 32))
        for width in np.unique(bucket[bucket > 0]):
            members = np.flatnonzero(bucket == width)
            step = max(1, CELLS // int(width))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                ids = np.full((len(part), width), -1, dtype=np.int32)
                ids[np.arange(width)[None, :] < lengths[part][:, None]] = self.byte_ids[data[_ragged(starts[part], lengths[part])]]
                out, counts = self.merge_matrix(ids)
                self._keep(keys[part], out[out >= 0], counts)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more than texts)."""
        starts, at = pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        ends = np.append(starts[1:], len(data))
        keys = textcore.hash_spans(data, starts, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if self.rows + len(distinct) > CACHE:
            self._empty()
        rows = self.row_of.get(distinct)
        new = np.flatnonzero(rows < 0)
        if len(new):
            self.learn(data, distinct[new], starts[first[new]], ends[first[new]])
            rows[new] = self.row_of.get(distinct[new])
        row = rows[inverse]
        counts = self.count[row].astype(np.int64)
        ids = self.store[_ragged(self.begin[row], counts)]
        return ids, np.concatenate(([0], np.cumsum(counts)))[at]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes that ids stand for."""
        return self.bytes[_ragged(self.starts[ids], self.lengths[ids])]

    def encode_checked(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``encode``, and the bytes that the ids decode to; never wrong by a shared hash."""
        ids, at = self.encode(data, offsets)
        back = self.decode(ids)
        if not np.array_equal(back, data):
            parts = []
            for d in range(len(offsets) - 1):
                self._empty()
                parts.append(self.encode(data[offsets[d] : offsets[d + 1]], np.array([0, offsets[d + 1] - offsets[d]]))[0])
            ids, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
            back = self.decode(ids)
        return ids, at, back


def _table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Open-addressed table of distinct keys, none of which is the greatest 64-bit number."""
    bits = max(10, int(np.ceil(np.log2(6 * len(keys) + 1))))
    shift = np.uint64(64 - bits)
    held, out = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, dtype=values.dtype)
    slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    todo = np.arange(len(keys))
    while len(todo):
        _, first = np.unique(slot[todo], return_index=True)
        put = todo[first]
        put = put[held[slot[put]] == ~np.uint64(0)]
        held[slot[put]], out[slot[put]] = keys[put], values[put]
        todo = np.setdiff1d(todo, put, assume_unique=True)
        slot[todo] = (slot[todo] + 1) & ((1 << bits) - 1)
    return held, out, shift


def _find(held: np.ndarray, values: np.ndarray, shift: np.uint64, keys: np.ndarray, missing) -> np.ndarray:
    """Values of keys; probing goes on only for those that met another key."""
    slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    found = held[slot]
    out = np.where(found == keys, values[slot], missing)
    open_ = np.flatnonzero((found != keys) & (found != ~np.uint64(0)))
    while len(open_):
        slot[open_] = (slot[open_] + 1) & (len(held) - 1)
        found = held[slot[open_]]
        hit = found == keys[open_]
        out[open_[hit]] = values[slot[open_[hit]]]
        open_ = open_[~hit & (found != ~np.uint64(0))]
    return out


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a rank file that each worker can read, made once in each process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(load_ranks(path))
    return _CODECS[path]


def encode(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, ids)``: the token ids of each row's whole text. Null and empty texts have none."""

    def rows(batches):
        use = codec(path)
        for batch in batches:
            for part in textcore.slices(batch, "text", textcore.BLOCK):
                ids, at, _ = use.encode_checked(*textcore.buffers(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["id", "ids"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(textcore.tidy(rows), "id long, ids array<int>").withColumnRenamed("id", id)


def decode(tokens: DataFrame, path: str, ids: str = "ids", id: str = "doc_id") -> DataFrame:
    """``(id, bytes)``: the bytes that each row's ids stand for. Null ids give null."""

    def rows(batches):
        use = codec(path)
        for batch in batches:
            out = [None if x is None else use.decode(np.array(x, dtype=np.int32)).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    source = tokens.select(F.col(id).cast("long").alias("id"), F.col(ids).alias("ids"))
    return source.mapInArrow(textcore.tidy(rows), "id long, bytes binary").withColumnRenamed("id", id)


def round_trip(docs: DataFrame, path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: each whole text encoded, its ids decoded again, and both digested
    within the task, so that ids need not leave it. Null counts as empty, repeated rows are returned as often as they
    occur, an empty table gives an empty result, and columns other than ``id`` and ``text`` are not read."""

    def rows(batches):
        use = codec(path)
        for batch in batches:
            for part in textcore.slices(batch, "text", textcore.BLOCK):
                data, offsets = textcore.buffers(part.column(1))
                ids, at, back = use.encode_checked(data, offsets)
                named = list(map(use.label, ids.tolist()))
                cut = at.tolist()
                coded = [hashlib.sha256(",".join(named[a:b]).encode()).hexdigest() for a, b in zip(cut, cut[1:])]
                decoded = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(textcore.tidy(rows), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id)
