"""Language identification by error-correcting output codes.

Each language has a codeword; one linear classifier over hashed byte n-grams is trained for each of its bits. A text's
outputs are compared with every codeword by a hinge loss that weighs bits by how well they separate the training rows; the
nearest codeword wins, and a text whose two nearest are almost as near is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textcore
from spindrift.llm.sampling import fold, labelled

#: The classifiers are fitted on a sample of so many labelled rows at most, and of about so many bytes of text in all.
SAMPLE_ROWS, SAMPLE_BYTES = 8_000, 48 << 20
DIMENSIONS = 1 << 12
AMBIGUOUS = 0.1
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ANY_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  #: one row of -1 and 1 for each language
    weights: np.ndarray  #: features and a constant, by bit
    trust: np.ndarray  #: weight of each bit


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One codeword for each language: all splits of up to seven languages into two, else the best of some random codes by
    the least distance between codewords."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        splits = np.arange(1, 1 << (languages - 1))
        return np.where((splits[None, :] >> np.arange(languages)[:, None]) & 1, 1.0, -1.0)
    bits, rng = int(np.ceil(15 * np.log2(languages))), np.random.default_rng(seed)
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(languages) * bits
        if apart.min() > least and (np.abs(code.sum(axis=0)) < languages).all():
            best, least = code, apart.min()
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of hashed counts of one to three bytes, A-Z lower-cased and digits alike, scaled to unit length."""
    n = len(offsets) - 1
    x = textcore.LOWER[data].astype(np.uint32)
    x[(x >= 48) & (x <= 57)] = 48
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    counts = np.zeros(n * DIMENSIONS)
    for size in (1, 2, 3):
        if len(x) < size:
            continue
        gram = x[: len(x) - size + 1] + np.uint32(size) * np.uint32(7919)
        for k in range(1, size):
            gram = gram * np.uint32(2654435761 & 0xFFFF | 1) + x[k : len(x) - size + 1 + k]
        place = (gram * np.uint32(0x9E3779B1) >> np.uint32(20)).astype(np.int64)
        same = doc[: len(gram)] == doc[size - 1 :]
        counts += np.bincount((doc[: len(gram)] + place)[same], minlength=n * DIMENSIONS)
    out = np.sqrt(counts.reshape(n, DIMENSIONS)).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fit(texts, labels: list[str], rounds: int = 150) -> Model:
    """A model from texts and their languages; deterministic."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    column = pa.array(texts, pa.string()) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((DIMENSIONS + 1, 1), dtype=np.float32), np.ones(1))
    parts = [features(*textcore.buffers(column.slice(a, 250))) for a in range(0, len(column), 250)]
    x = np.concatenate(parts)
    place = {v: k for k, v in enumerate(languages)}
    y = np.array([place[v] for v in labels])
    share = np.bincount(y, minlength=len(languages)) / len(y)
    importance = (1 / (share * len(languages)))[y][:, None].astype(np.float32)
    target = code[y].astype(np.float32)
    theta = np.zeros((DIMENSIONS + 1, code.shape[1]), dtype=np.float32)
    speed = np.zeros_like(theta)
    for _ in range(rounds):
        out = x @ theta[:-1] * 10 + theta[-1]
        error = -target / (1 + np.exp((target * out).clip(-30, 30))) * importance / len(y)
        grad = np.concatenate((10 * (x.T @ error), error.sum(axis=0, keepdims=True))).astype(np.float32)
        speed = 0.9 * speed - 0.5 * grad
        theta += speed
    right = np.sign(x @ theta[:-1] * 10 + theta[-1]) == target
    error = np.clip(1 - right.mean(axis=0), 1e-3, 0.499)
    return Model(languages, code, theta, np.log((1 - error) / error))


def decode(model: Model, out: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its score and the lead over the next, by loss-weighted decoding."""
    loss = np.stack([(np.maximum(0, 1 - np.clip(out, -4, 4) * c) * model.trust).sum(axis=1) / model.trust.sum() for c in model.code], axis=1)
    like = np.exp(-2 * (loss - loss.min(axis=1, keepdims=True)))
    like /= like.sum(axis=1, keepdims=True)
    order = np.sort(like, axis=1)
    return loss.argmin(axis=1), order[:, -1], order[:, -1] - (order[:, -2] if like.shape[1] > 1 else 0)


def train(docs: DataFrame, text: str = "text", id: str = "doc_id", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of rows with a language outside the held-out fold, drawn evenly over languages, by their whole
    texts. Of several languages of one id the greatest name counts, of several texts the least; null ids, languages and texts
    teach nothing. A language with a row in the fold of training is always learned, up to ``sample_rows`` languages."""
    known = docs.select(F.col(id).cast("long").alias("id"), F.col(lang).cast("string").alias("label")).where("label is not null and id is not null")
    known = known.where(fold(F.col("id"), FOLDS) != HELD_OUT)
    sizes = known.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("id", F.lit(3)).alias("h"), "id")).alias("first"))
    each = F.lit(float(sample_rows)) / F.greatest(F.lit(1), F.lit(sizes.count()))
    drawn = known.join(sizes, "label").where((F.col("id") == F.col("first.id")) | (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.least(F.lit(1.0), each / F.col("n")) * 1_000_000))
    known = drawn.select("id", "label")
    sample = labelled(docs, known, sample_rows, SAMPLE_BYTES, text, id)
    model = fit(sample.column("text"), sample.column("label").to_pylist())
    textcore.give_back()
    return model


def predict(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, held_out, lang_pred, score, ambiguous)``, one row for each row of ``docs``, by its whole text.

    ``lang_pred`` is ``und`` with score 0 where the text is null, empty or without a letter, or no language was learned; of
    codewords that are equally near the first language by name wins. Texts of any length count whole, by blocks of bytes. A
    null id is not held out; repeated rows get equal results; an empty table gives an empty result; other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        use = shared.value
        names = np.array([*use.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part in textcore.slices(batch, "text", textcore.BLOCK):
                data, offsets = textcore.buffers(part.column(1))
                has = np.diff(np.concatenate(([0], np.cumsum(_LETTER[data])))[offsets]) > 0
                for d in np.flatnonzero(~has):
                    has[d] = bool(_ANY_LETTER.search(data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8")))
                has &= len(use.languages) > 0
                best, score, lead = np.full(len(has), -1), np.zeros(len(has)), np.zeros(len(has))
                if has.any():
                    for a in range(0, len(has), 512):
                        b = min(len(has), a + 512)
                        out = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) @ use.weights[:-1] * 10 + use.weights[-1]
                        best[a:b], score[a:b], lead[a:b] = decode(use, out)
                best, score = np.where(has, best, -1), np.where(has, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best], pa.string()), pa.array(score), pa.array(has & (lead < AMBIGUOUS))], names=["id", "lang_pred", "score", "ambiguous"])

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = source.mapInArrow(textcore.tidy(rows), "id long, lang_pred string, score double, ambiguous boolean")
    held = F.coalesce(fold(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select(F.col("id").alias(id), held.alias("held_out"), "lang_pred", "score", "ambiguous")
