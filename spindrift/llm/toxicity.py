"""Toxicity by weak supervision.

Many voters look at a text. Lexicon voters each hold a share of the terms - words and word beginnings - that a likelihood
test on labelled rows finds to mark toxic texts, or a short list of common insults; pattern voters look at exclamation,
capitals and drawn-out letters; one voter speaks for clean texts. A generative label model over two classes gives posterior
labels: each voter votes at rates that depend on the class and on one other voter, its parent in a tree of the strongest
correlations given the class. Rates and tree are estimated by expectation maximisation. A linear classifier over term
presence is trained on the posteriors and scores every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textcore
from spindrift.llm.sampling import fold, labelled

#: The classifier is fitted on a sample of so many labelled rows at most, and of about so many bytes of text in all.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 64 << 20
TERMS = 4_000
#: A term enters the lexicon if so many sampled rows hold it and this share of them is toxic, beyond chance.
LEAST, PURITY = 4, 0.9
GROUPS = 16
STEMS = (4, 5, 6)
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1

#: Common insults (fixed values).
INSULTS = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool",
    "jerk", "ugly", "imbécile", "crétin", "débile", "stupide", "ordure", "trottel", "dummkopf", "abschaum", "widerlich", "estúpido", "imbécil", "basura", "asqueroso",
)

_EDGE = np.zeros(256, dtype=bool)
_EDGE[[*b".,;:!?\"'()[]{}*_#%|<>&-"]] = True


@dataclass
class Model:
    keys: np.ndarray  #: hashes of the terms, ascending
    weights: np.ndarray
    pattern_weights: np.ndarray
    bias: float
    voters: dict[str, tuple[float, float]]  #: rate of a toxic vote among toxic and among clean texts
    parents: dict[str, str | None]  #: the voter that each depends on, given the class


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every word and of its beginnings, one row for each word (0: too short), where each text's words begin, and
    the lower-cased bytes. Punctuation at a word's edges is left out."""
    lower = textcore.LOWER[data]
    separate = lower.copy()
    separate[_EDGE[lower]] = 32
    starts, ends, at = textcore.spans(separate, offsets)
    out = np.zeros((1 + len(STEMS), len(starts)), dtype=np.uint64)
    if not len(starts):
        return out, at, lower
    out[0] = textcore.hash_spans(separate, starts, ends)
    byte_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    point = np.searchsorted(byte_at, starts)
    for k, size in enumerate(STEMS):
        stop = byte_at[np.minimum(point + size, len(byte_at) - 1)]
        fit = stop < ends
        out[1 + k, fit] = textcore.hash_spans(separate, starts[fit], stop[fit]) ^ np.uint64(size)
    return out, at, lower


def _patterns(data: np.ndarray, offsets: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Shares of exclamation marks, capitals and letters drawn out over three places in each text."""
    size = np.maximum(np.diff(offsets), 1)
    long_ = np.zeros(len(data), dtype=bool)
    if len(data) > 3:
        letter = (lower >= 97) & (lower <= 122)
        long_[3:] = (lower[3:] == lower[2:-1]) & (lower[2:-1] == lower[1:-2]) & (lower[1:-2] == lower[:-3]) & letter[3:]
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
    return np.stack([total(data == 33) / size * 20, total((data >= 65) & (data <= 90)) / size * 4, total(long_) / size * 50], axis=1).clip(0, 1)


def _rows(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct terms of each text, and its patterns."""
    data, offsets = textcore.buffers(column)
    terms, at, lower = _terms(data, offsets)
    shape = _patterns(data, offsets, lower)
    return [(np.unique(terms[:, at[d] : at[d + 1]]), shape[d]) for d in range(len(offsets) - 1)]


def _copies(column) -> np.ndarray:
    """Which texts share a least shingle, under any of four hashes, with an earlier one: near copies would count the words
    of one text as evidence many times."""
    hashes, at = textcore.shingles(*textcore.word_hashes(*textcore.buffers(column)))
    seen: set[tuple[int, int]] = set()
    out = np.zeros(len(at) - 1, dtype=bool)
    for d in range(len(out)):
        own = hashes[at[d] : at[d + 1]]
        marks = {(k, int(textcore.mix(own ^ np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))).min())) for k in range(4)} if len(own) else set()
        out[d] = not seen.isdisjoint(marks)
        seen |= marks
    return out


def _batches(column, size: int = 500):
    """Distinct terms and patterns of all texts, a few at a time; they are never held together."""
    for a in range(0, len(column), size):
        yield from _rows(column.slice(a, size))


def _lexicon(column, toxic: np.ndarray) -> np.ndarray:
    """Terms whose documents are toxic far more often than all are, by a likelihood ratio that allows for how many terms
    are tried; strongest first."""
    base = toxic.mean() if len(toxic) else 0.0
    if not 0 < base < 1:
        return np.zeros(0, dtype=np.uint64)
    seen = np.zeros(0, dtype=np.uint64)
    for terms, _ in _batches(column.filter(pa.array(toxic))):
        seen = np.concatenate((seen, terms)) if len(seen) < 1 << 20 else np.unique(np.concatenate((seen, terms)))
    seen = np.unique(seen)
    hit, miss = np.zeros(len(seen)), np.zeros(len(seen))
    for (terms, _), y in zip(_batches(column), toxic):
        k = np.searchsorted(seen, terms)
        inside = k < len(seen)
        k = k[inside][seen[k[inside]] == terms[inside]]
        (hit if y else miss)[k] += 1
    share = hit / (hit + miss)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = hit * np.log(share / base) + np.where(miss > 0, miss * np.log((1 - share) / (1 - base)), 0)
    tried = hit + miss >= LEAST
    keep = tried & (share >= PURITY) & (share > 3 * base) & (gain > np.log(tried.sum() + 1) + 1) & (seen != 0)
    order = np.argsort(-gain[keep], kind="stable")
    return seen[keep][order][:TERMS]


def correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the class."""
    out = np.zeros((votes.shape[1],) * 2)
    for weight in (post, 1 - post):
        total = weight.sum() + 1e-9
        share = (votes.T @ weight) / total
        both = (votes.T * weight) @ votes / total
        for cell, a, b in ((both, share, share), (share[:, None] - both, share, 1 - share), (share[None, :] - both, 1 - share, share), (1 - share[:, None] - share[None, :] + both, 1 - share, 1 - share)):
            cell, free = cell.clip(1e-12), np.outer(a, b).clip(1e-12)
            out += total / len(votes) * cell * np.log(cell / free)
    np.fill_diagonal(out, 0)
    return out


def tree(weights: np.ndarray, least: float) -> np.ndarray:
    """Parent of each place in the forest of greatest weights, of edges over ``least`` only; -1 at its roots."""
    m = len(weights)
    parent, best, near = np.full(m, -1), np.full(m, -np.inf), np.full(m, -1)
    todo = np.ones(m, dtype=bool)
    while todo.any():
        at = int(np.where(todo, best, -np.inf).argmax()) if np.isfinite(best[todo]).any() else int(np.flatnonzero(todo)[0])
        parent[at], todo[at] = near[at], False
        closer = todo & (weights[at] > least) & (weights[at] > best)
        best[closer], near[closer] = weights[at][closer], at
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the positive class of each row, rates of a positive vote of each voter by its parent's vote and the class,
    and the parents.

    ``votes`` holds 1 where a voter speaks and 0 where it abstains. At first any vote speaks for the class; from those
    posteriors comes the tree of the correlations that pay for their parameters, and the model with that tree is estimated.
    Its posteriors give the tree of the second estimate. Rates by a parent's vote are drawn towards those without. The last
    voter stays out of the tree: it speaks where no lexicon does, so given it the others would have nothing left to say.
    """
    n, m = votes.shape
    post = np.clip(votes[:, :-1].max(axis=1) * 0.9 + 0.02, 0, 1) if m > 1 else np.full(n, prior)
    rates = np.full((m, 2, 2), 0.5)
    for _ in range(2):
        weights = correlations(votes, post)
        weights[-1], weights[:, -1] = 0, 0
        parent = tree(weights, np.log(max(n, 2)) / max(n, 2))
        above = np.where(parent >= 0, votes[:, parent], 0)
        for _ in range(rounds):
            weight = np.stack([post, 1 - post], axis=1)
            plain = (votes.T @ weight + 1e-2) / (weight.sum(axis=0) + 2e-2)
            for u in (0, 1):
                here = above == u
                rates[:, u] = ((votes * here).T @ weight + 2 * plain) / (here.T @ weight + 2)
            rates = rates.clip(1e-4, 1 - 1e-4)
            prior = float(np.clip(0.5 * prior + 0.5 * post.mean(), 1e-4, 1 - 1e-4))
            logit = np.full(n, np.log(prior / (1 - prior)))
            for u in (0, 1):
                here = above == u
                logit += (votes * here) @ np.log(rates[:, u, 0] / rates[:, u, 1]) + ((1 - votes) * here) @ np.log((1 - rates[:, u, 0]) / (1 - rates[:, u, 1]))
            post = 1 / (1 + np.exp(-logit.clip(-30, 30)))
    return post, rates, parent


def fit(texts, labels) -> Model:
    """A model from texts and their 0/1 labels. Without rows of both kinds, only the insult list speaks."""
    toxic, column = np.array(labels, dtype=bool), texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    single = ~_copies(column)
    toxic, column = toxic[single], column.filter(pa.array(single))
    insults, _, _ = _terms(*textcore.buffers(pa.array(list(INSULTS))))
    insults = np.unique(insults[0])
    learned = _lexicon(column, toxic)
    keys = np.union1d(learned, insults)
    present, shapes = [], []
    for terms, pattern in _batches(column):
        k = np.searchsorted(keys, terms)
        inside = k < len(keys)
        present.append(k[inside][keys[k[inside]] == terms[inside]])
        shapes.append(pattern)
    n = len(column)
    strength = np.full(len(keys), len(learned))
    strength[np.searchsorted(keys, learned)] = np.arange(len(learned))
    group = np.where(np.isin(keys, insults), GROUPS, strength % GROUPS)
    shape = np.array(shapes).reshape(n, 3)

    votes = np.zeros((n, GROUPS + 1 + 3 + 1))
    for i, k in enumerate(present):
        votes[i, group[k]] = 1
    votes[:, GROUPS + 1 : GROUPS + 4] = shape > 0.5
    votes[:, -1] = votes[:, : GROUPS + 1].max(axis=1, initial=0) == 0
    names = [f"lexicon{g}" for g in range(GROUPS)] + ["insults", "exclamation", "capitals", "drawn_out", "clean"]
    if n:
        prior = float(np.clip(toxic.mean(), 0.01, 0.99))
        post, rates, parent = label_model(votes, prior)
    else:
        post, rates, parent = np.zeros(0), np.full((votes.shape[1], 2, 2), 0.5), np.full(votes.shape[1], -1)

    weights, pattern, bias = np.where(np.isin(keys, insults), 5.0, 1.0), np.zeros(3), -3.0
    if 0 < toxic.sum() < len(toxic):
        row_of = np.repeat(np.arange(n), [len(k) for k in present])
        flat = np.concatenate(present) if len(row_of) else np.zeros(0, dtype=np.int64)
        state = [np.zeros(len(keys) + 4) for _ in range(2)]
        theta = np.concatenate((weights, pattern, [bias]))
        for step in range(1, 301):
            logit = np.bincount(row_of, theta[flat], n) + shape @ theta[-4:-1] + theta[-1]
            error = (1 / (1 + np.exp(-logit.clip(-30, 30))) - post) / n
            grad = np.concatenate((np.bincount(flat, error[row_of], len(keys)), error @ shape, [error.sum()]))
            grad[:-1] += 1e-6 * theta[:-1]
            state[0] = 0.9 * state[0] + 0.1 * grad
            state[1] = 0.99 * state[1] + 0.01 * grad**2
            theta -= 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-9)
        weights, pattern, bias = theta[: len(keys)], theta[-4:-1], float(theta[-1])
    return Model(keys, weights, pattern, bias, {name: tuple(rate[0]) for name, rate in zip(names, rates)}, {name: names[p] if p >= 0 else None for name, p in zip(names, parent)})


def _scores(model: Model, screen: np.ndarray, part: pa.RecordBatch, column: int) -> np.ndarray:
    data, offsets = textcore.buffers(part.column(column))
    terms, at, lower = _terms(data, offsets)
    logit = _patterns(data, offsets, lower) @ model.pattern_weights + model.bias
    found = []
    for line in terms:
        maybe = np.flatnonzero(screen[(line & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(model.keys, line[maybe]), len(model.keys) - 1)
        hit = model.keys[k] == line[maybe]
        doc = np.searchsorted(at, maybe[hit], side="right") - 1
        found.append(doc * len(model.keys) + k[hit])
    pairs = np.unique(np.concatenate(found))
    logit += np.bincount(pairs // len(model.keys), model.weights[pairs % len(model.keys)], len(offsets) - 1)
    return 1 / (1 + np.exp(-logit.clip(-500, 500)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold, by their whole texts.

    An id that is labelled both ways counts as toxic; of an id with several texts the least is taken; null ids, labels and
    texts teach nothing."""
    known = labels.select(F.col(id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where(fold(F.col("id"), FOLDS) != HELD_OUT)
    sample = labelled(docs, known, sample_rows, SAMPLE_BYTES, text, id)
    labels_, texts = [bool(x) for x in sample.column("label").to_pylist()], sample.column("text").combine_chunks()
    del sample
    model = fit(texts, labels_)
    textcore.give_back()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; columns of those names are replaced.

    Every whole text is scored, however long; null and empty texts get the score of a text without any term; a score of
    just ``threshold`` counts as toxic. A null id is not held out. Repeated rows get equal scores; an empty table gives an empty result; all other
    columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("held_out", "score", "predicted")
    at = base.columns.index(text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", score double"

    def rows(batches):
        use = shared.value
        screen = np.zeros(1 << 16, dtype=bool)
        screen[(use.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for part in textcore.slices(batch, text, textcore.BLOCK):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_scores(use, screen, part, at))], names=[*part.schema.names, "score"])

    scored = base.mapInArrow(textcore.tidy(rows), schema)
    held = F.coalesce(fold(F.col(id), FOLDS) == HELD_OUT, F.lit(False))
    return scored.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
