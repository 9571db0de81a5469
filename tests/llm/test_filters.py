"""Filters, classifiers and tokenisers on small tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace
from time import process_time

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import tiktoken

from spindrift.llm import bpe, decontaminate, language_id, line_dedup, lm, toxicity, url_filter
from tests.llm.fixtures import SCHEMA, corpus, documents, nothing, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = []
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme/org/", "http://a.ORG/x", "http://b.org", "http://example.org/es/1?x=/", "http://m.example.org/en/12", "http://example.org/en/21", "http://x.com/fr/#a", "http://x.com/de/a"]
    urls += ["http://notcom/de/", "ftp://com/de/q", "http://org?x", "http://a.org/", "http://a.org/", "x://y://z.org/", "http://example.org./es/", "http://.*.org/", "http://a.org/\n/x", "http://" + "a" * 9000 + ".org/" + "b/" * 9000]
    rows = [(i if i != 3 else None, u, 1, "r") for i, u in enumerate(urls)] + [(4, urls[4], 1, "r")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, pos int, rule string"), RULES).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((i, *brute_verdict(u)) for i, u, *_ in rows), key=str)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, pos int, rule string"), [], "block").collect()} == {"block"}


@pytest.mark.parametrize("most", [200_000, -1])
def test_lines(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rows = [(i, "\n".join(["menu ", f"own {i}", "", "menu", "twice", "twice"] if i % 2 else [f"own {i}", "twice"]), None, None if i % 3 == 0 else "s", 1) for i in range(30)]
    rows += [rows[1], (77, None, None, "s", None), (78, "", None, "s", 0), (79, "menu", None, "small", 4)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA), ratio=0.3, min_pages=3).collect()
    pages, totals = defaultdict(Counter), Counter()
    for _, t, _, s, _ in rows:
        totals[s] += 1
        pages[s].update({x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")})
    want = []
    for i, t, _, s, _ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if not x.strip(" ") or not (pages[s][x.strip(" ")] >= 3 and pages[s][x.strip(" ")] > 0.3 * totals[s])]
        want.append((i, s, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    assert sorted(((r.doc_id, r.source, r.n_lines, r.n_dropped, r.text) for r in got), key=str) == sorted(want, key=str)
    clashing = line_dedup.drop_boilerplate(documents(spark, True))
    assert clashing.count() == len(corpus()) and line_dedup.drop_boilerplate(nothing(spark)).count() == 0


def sellers(item, text):
    row, points = np.zeros(len(text) + 1, dtype=int), np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (points != ord(c)), row[1:] + 1)))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row.min())


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(4)
    items = ["".join(rnd.choice("abcdef gh") for _ in range(m)) for m in (5, 11, 30, 60, 120, 200)] + ["", None, "   ", "éèê " * 12]
    texts = []
    for k in range(60):
        item = list(rnd.choice(items) or "")
        for _ in range(rnd.randrange(9)):
            if item:
                p = rnd.randrange(len(item))
                item[p : p + rnd.randrange(2)] = rnd.choice("xyz ") * rnd.randrange(2)
        noise = lambda: "".join(rnd.choice("abcdefgh ij") for _ in range(rnd.randrange(90)))
        texts.append(noise() + "".join(item) + noise())
    rows = [(k, t, None, None, None) for k, t in enumerate(texts + ["", None])] + [(0, texts[0], None, None, None)]
    bench = spark.createDataFrame([(k, t, "extra") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    want = []
    for k, t, *_ in rows:
        for i, item in enumerate(map(decontaminate.normalise, items)):
            if item and t:
                d = sellers(item, decontaminate.normalise(t))
                if d <= decontaminate.budget(len(item)):
                    want.append((k, i, d))
    for block in (1 << 20, 100):
        got = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), bench, block_bytes=block).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
    assert decontaminate.clean(documents(spark, True).drop("leaks"), bench.limit(0)).count() == len(corpus())
    assert decontaminate.leaks(nothing(spark), bench).count() == 0


def test_leaks_in_repetitive_texts():
    import time

    rnd = random.Random(8)
    items = ["a" * 400, "ab" * 150, "the same words again and again " * 12, "q" * 30, "".join(rnd.choice("abcd efgh") for _ in range(300))]
    idx = decontaminate.index(list(range(5)), items)
    assert idx.plain.tolist() == [False, False, False, False, True]
    texts = ["a" * 1_000_000, "b" * 1_000_000, "a" * 390 + "x" + "a" * 380, ("a" * 70 + "c") * 900, "xy" + items[4][:150] + "z" + items[4][150:] * 3, "ab" * 100 + "c" + "ab" * 49 + "  " + "ab" * 30, "q" * 29, "q" * 28 + "r" + "q" * 30]
    texts += [("the same words again and again " * 5 + "or else ") * 40, "x" * 50 + "the same words again and agan " * 13]
    began = time.time()
    got = decontaminate.search(idx, [decontaminate.normalise(t) for t in texts])
    assert time.time() - began < 60
    for t, hits in zip(texts, got):
        if len(t) < 100_000:
            want = {i: sellers(decontaminate.normalise(item), decontaminate.normalise(t)) for i, item in enumerate(items)}
            assert {i: d for i, d, _ in hits} == {i: d for i, d in want.items() if d <= int(idx.budgets[i])}
    assert got[0] == [(0, 0, 400)] and got[1] == []


def test_bpe_equals_the_library(spark):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    assert bpe.PATTERN == public_tokenizers.PATTERN
    rnd = random.Random(5)
    odd = ["a" * 4000, "ab" * 3000, "é" * 900, "\n" * 900 + " x", " 's't\n's'll've'tx 're", "it's they're I'll'mm\t'sa \n\n  ab", "".join(chr(rnd.randrange(32, 0x2FFF)) for _ in range(3000))]
    odd += ["".join(rnd.choice(" \n'sstmdrevl1é. A") for _ in range(rnd.randrange(14))) for _ in range(500)] + ["".join(rnd.choice("aabcdetr") for _ in range(1500))]
    rows = [(k, t, None, None, None) for k, t in enumerate(odd)] + [r for r in corpus() if r[0] is not None]
    got = {(r.doc_id, r.decoded_sha256): r for r in bpe.round_trip(spark.createDataFrame(rows, SCHEMA), RANKS).collect()}
    for i, t, *_ in rows:
        ids = encoding.encode_ordinary(t or "")
        r = got[i, hashlib.sha256((t or "").encode()).hexdigest()]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    coded = bpe.encode(documents(spark, True), RANKS)
    back = bpe.decode(coded, RANKS).collect()
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in back) == sorted((str(i), t or "") for i, t, *_ in corpus())
    assert bpe.round_trip(nothing(spark), RANKS).count() == 0


def test_language(spark):
    rnd = random.Random(6)
    kinds = {"aa": "the of and ing tion", "bb": "der und die keit ung", "cc": "que los ción para del"}
    make = lambda k: " ".join(rnd.choice(kinds[k].split()) + rnd.choice("abc") for _ in range(30))
    rows = [(i, make(k), k, None, None) for i in range(240) for k in [list(kinds)[i % 3]]]
    rows += [(900, None, "aa", None, None), (901, "123 !?", "aa", None, None), (902, "", None, None, None), (None, make("aa"), None, None, None), rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language_id.predict(docs, language_id.train(docs)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[k].lang_pred == "und" for k in (900, 901, 902))
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == list(kinds)[r.doc_id % 3] for r in held if r.doc_id < 240) >= 0.95 * sum(r.doc_id < 240 for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    empty = language_id.train(nothing(spark))
    assert {r.lang_pred for r in language_id.predict(documents(spark, True), empty).collect()} == {"und"}
    code = language_id.codewords(12)
    assert min((code[a] != code[b]).sum() for a in range(12) for b in range(a)) >= 10


def test_toxicity(spark):
    rnd = random.Random(7)
    plain = [f"w{k}" for k in range(300)]
    make = lambda bad: " ".join([rnd.choice(plain) for _ in range(40)] + [rnd.choice(["grumfle", "grumfix", "zork"]) for _ in range(3 * bad)])
    rows = [(i, make(i % 5 == 0), None, None, None) for i in range(400)]
    rows += [(900, None, None, None, None), (901, "", None, None, None), (None, "zork", None, None, None), rows[5]]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"lang", "source", "n_chars"}
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert held and sum(r.predicted == int(r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) for r in got) and {r.predicted for r in got if r.doc_id in (900, 901)} == {0}
    model = toxicity.train(nothing(spark), labels.limit(0))
    assert toxicity.score(documents(spark, True), model).count() == len(corpus()) and toxicity.score(nothing(spark), model).count() == 0
    long_ = [(i, " ".join([make(i % 5 == 0)] * 400), None, None, None) for i in range(100)]  # none is left out for its length
    learned = toxicity.train(spark.createDataFrame(long_, SCHEMA), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(100)] + [(5, 0), (15, 0)], "doc_id long, toxic int"))
    assert {r.doc_id for r in toxicity.score(spark.createDataFrame(long_, SCHEMA), learned).where("predicted = 1").collect()} == set(range(0, 100, 5))


def naive_label_model(votes, prior, parent, start, rounds):
    """Expectation maximisation with a given tree, row by row."""
    rows, post = votes.astype(int).tolist(), list(start)
    m = len(rows[0])
    for _ in range(rounds):
        weight = {(r, c): post[r] if c == 0 else 1 - post[r] for r in range(len(rows)) for c in (0, 1)}
        mass = [sum(weight[r, c] for r in range(len(rows))) for c in (0, 1)]
        rate = {}
        for j in range(m):
            for c in (0, 1):
                plain = (sum(weight[r, c] for r, v in enumerate(rows) if v[j]) + 0.01) / (mass[c] + 0.02)
                for u in (0, 1):
                    own = [r for r, v in enumerate(rows) if (v[parent[j]] if parent[j] >= 0 else 0) == u]
                    x = (sum(weight[r, c] for r in own if rows[r][j]) + 2 * plain) / (sum(weight[r, c] for r in own) + 2)
                    rate[j, u, c] = min(max(x, 1e-4), 1 - 1e-4)
        prior = min(max(0.5 * prior + 0.5 * sum(post) / len(post), 1e-4), 1 - 1e-4)
        for r, v in enumerate(rows):
            odds = prior / (1 - prior)
            for j in range(m):
                u = v[parent[j]] if parent[j] >= 0 else 0
                one, two = rate[j, u, 0], rate[j, u, 1]
                odds *= one / two if v[j] else (1 - one) / (1 - two)
            post[r] = odds / (1 + odds)
    return post


def test_label_model(monkeypatch):
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.3
    votes = np.stack([rng.random(400) < np.where(truth, hi, lo) for hi, lo in ((0.8, 0.1), (0.7, 0.05), (0.6, 0.1), (0.5, 0.02))] + [~truth & (rng.random(400) < 0.9)], axis=1).astype(float)
    votes[:, 3] = np.where(rng.random(400) < 0.9, votes[:, 2], votes[:, 3])  # one voter mostly repeats another
    post, rates, parent = toxicity.label_model(votes, 0.3)
    assert parent[-1] == -1 and 4 not in parent and (parent[2] == 3 or parent[3] == 2) and rates.shape == (5, 2, 2) and ((post > 0.5) == truth).mean() > 0.85
    for fixed in ([-1] * 5, [-1, 0, -1, 2, 0]):
        monkeypatch.setattr(toxicity, "tree", lambda weights, least, fixed=fixed: np.array(fixed))
        prior, start = 0.3, np.clip(votes[:, :-1].max(axis=1) * 0.9 + 0.02, 0, 1)
        want = naive_label_model(votes, prior, fixed, start, 6)
        assert np.allclose(toxicity.label_model(votes, prior, rounds=3)[0], want)
    monkeypatch.undo()
    # information of two voters given the class, by its definition
    want = 0.0
    for c in (0, 1):
        w = truth if c else ~truth
        for x in (0, 1):
            for y in (0, 1):
                both = ((votes[:, 0] == x) & (votes[:, 1] == y) & w).sum() / w.sum()
                one, two = ((votes[:, 0] == x) & w).sum() / w.sum(), ((votes[:, 1] == y) & w).sum() / w.sum()
                want += w.mean() * both * math.log(both / one / two) if both else 0
    assert abs(toxicity.correlations(votes, truth.astype(float))[0, 1] - want) < 1e-6
    assert toxicity.tree(np.array([[0, 5, 1], [5, 0, 2], [1, 2, 0]], dtype=float), 0.5).tolist() == [-1, 0, 1]


def test_lm(spark):
    rows = [r for r in corpus() if r[0] != 500] + [(600 + k, " ".join(["the cat sat on a mat"] * 4), None, None, None) for k in range(20)]
    got = lm.score(spark.createDataFrame(rows, SCHEMA), RANKS, frequent=7).collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts, train = Counter(), 0
    for i, t, *_ in rows:
        if i is not None and fold(i) != 1:
            counts.update((t or "").encode().lower().split())
            train += 1
    total, kinds = sum(counts.values()) + train, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        want[i, i is not None and fold(i) == 1, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total, round(sum(log(counts[x]) for x in w) + log(train), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    easy = [r.score / r.n_tokens for r in got if r.doc_id is not None and r.doc_id >= 600]
    assert min(easy) > max(r.score / r.n_tokens for r in got if r.doc_id in (0, 2, 4))
    assert lm.score(nothing(spark), RANKS).count() == 0 and lm.score(documents(spark, True).limit(3), RANKS).count() == 3


def test_lm_learns_from_every_training_text(spark, monkeypatch):
    """The attention is trained on every window of all training texts, however many there are."""
    rows = [(k, " ".join(f"word{(k * j) % 97}" for j in range(20)), None, None, None) for k in range(4_200)]
    train, found = lm.train, []

    def watched(docs, model, path, windows, *rest):
        _, _, ids, at = lm.spell(docs.select("text").toArrow().column("text").combine_chunks(), lm._codec(path))
        there, again = len(lm._windows(model, ids, at)[2]), max(1, -(-lm.STEPS * lm.BATCH // windows))
        found.append((train(docs, model, path, windows, *rest), there * again))
        return found[-1][0]

    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "train", watched)
    assert lm.score(spark.createDataFrame(rows, SCHEMA), RANKS).count() == len(rows)
    model, windows = found[0]
    assert model.windows == windows > 0 and len(model.losses) == lm.ROUNDS and model.losses[-1] < model.losses[0]


def test_lm_by_a_plain_loop():
    """Every id's probability by loops over single positions, without windows, batches or arrays of more than one id."""
    texts = ["some words to learn from and some more", "", "more words", "wordless wordings"]
    model = lm.fit(texts * 30, RANKS, steps=20)
    import pyarrow as pa

    _, _, ids, at = lm.spell(pa.array(texts), lm._codec(RANKS))
    size = len(model.classes)
    keys = np.unique(np.arange(0, 65 * size, 977))
    table = lm.within(model, keys, np.arange(len(keys)) % 5 + 1)
    words = {int(ids[0]) + 1: 5, (int(ids[0]) + 1) | (int(ids[1]) + 1) << 16: 3}
    known = lm.prefixes(np.array(list(words), dtype=np.uint64), np.array(list(words.values())))
    got = lm.word_logprobs(model, table, known, ids, at)
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    want = []
    for d in range(len(texts)):
        own = ids[at[d] : at[d + 1]].tolist()
        classes = [model.start] + [int(model.classes[i]) for i in own]
        prefix = ()
        for t, i in enumerate(own):
            last = t // lm.STRIDE * lm.STRIDE + lm.STRIDE  # the window that scores this id reaches back so far
            context = [classes[k] if k >= 0 else model.start for k in range(last - lm.WINDOW, t + 1)]
            seen = [k >= 0 for k in range(last - lm.WINDOW, t + 1)]
            query = model.query[classes[t]]
            scores = np.array([query @ model.key[c] / np.sqrt(lm.WIDTH) + model.near[len(context) - 1 - k] - (0 if s else 200) for k, (c, s) in enumerate(zip(context, seen))])
            p = softmax(softmax(scores) @ model.value[context] @ model.out + model.after[classes[t]])
            chosen, begin, c = p[classes[t + 1]] * table[classes[t], i], p[: lm.BEGINNINGS].sum(), classes[t + 1]
            packed = sum((x + 1) << 16 * k for k, x in enumerate(prefix)) if 0 < len(prefix) <= 4 else 0
            events = {}
            for word, n in words.items():
                parts = [word >> 16 * k & 0xFFFF for k in range(4) if word >> 16 * k & 0xFFFF]
                if packed and parts[: len(prefix)] == [x + 1 for x in prefix]:
                    events[parts[len(prefix)] if len(parts) > len(prefix) else 0] = events.get(parts[len(prefix)] if len(parts) > len(prefix) else 0, 0) + n
            total = sum(events.values())
            prior = lm.PRIOR + lm.LEAK * total
            goes = lambda event, back: (events.get(event, 0) + prior * back) / (total + prior)
            if t == 0:
                want.append(chosen)
            elif c < lm.BEGINNINGS:
                want[-1] *= goes(0, begin)
                want.append(chosen / begin)
            else:
                want[-1] *= goes(i + 1, chosen)
            prefix = (i,) if c < lm.BEGINNINGS else (*prefix, i)
    assert np.allclose(got, np.log10(want), atol=1e-3)


def plain_step(model, m, classes, f, begin, stop, step, rate):
    """A step of the attention's training, row by row: what it adds to each weight."""
    at = f[:, None] + np.arange(lm.STRIDE - lm.WINDOW, lm.STRIDE)
    known = at >= begin[:, None]
    keys = np.where(known, np.take(classes, at, mode="clip"), model.start)
    queries = keys[:, lm.WINDOW - lm.STRIDE :]
    back = (np.arange(lm.STRIDE)[:, None] + lm.WINDOW - lm.STRIDE) - np.arange(lm.WINDOW)[None, :]
    places = np.clip(back, 0, lm.WINDOW - 1)
    scores = model.query[queries] @ model.key[keys].transpose(0, 2, 1) / np.sqrt(lm.WIDTH) + model.near[places]
    weights = np.exp(scores) * (back >= 0) * known[:, None, :]
    weights /= weights.sum(axis=2, keepdims=True)
    context = weights @ model.value[keys]
    p = np.exp(context @ model.out + model.after[queries])
    p /= p.sum(axis=2, keepdims=True)
    target = f[:, None] + np.arange(1, lm.STRIDE + 1)
    real = (target <= stop[:, None])[:, :, None]
    wanted = np.minimum(classes[np.minimum(target, len(classes) - 1)], lm.CLASSES - 1)[:, :, None]
    loss = -np.log(np.take_along_axis(p, wanted, axis=2)[real]).mean()
    np.put_along_axis(p, wanted, np.take_along_axis(p, wanted, axis=2) - 1, axis=2)
    p = p * real / real.sum()
    d_context = p @ model.out.T
    d_weights = d_context @ model.value[keys].transpose(0, 2, 1)
    d_scores = weights * (d_weights - (d_weights * weights).sum(axis=2, keepdims=True))
    grad = {k: np.zeros(getattr(model, k).shape) for k in lm._WEIGHTS}
    grad["out"] = np.einsum("bqd,bqc->dc", context, p)
    np.add.at(grad["after"], queries.ravel(), p.reshape(-1, lm.CLASSES))
    np.add.at(grad["value"], keys.ravel(), (weights.transpose(0, 2, 1) @ d_context).reshape(-1, lm.WIDTH))
    np.add.at(grad["query"], queries.ravel(), (d_scores @ model.key[keys]).reshape(-1, lm.WIDTH) / np.sqrt(lm.WIDTH))
    np.add.at(grad["key"], keys.ravel(), (d_scores.transpose(0, 2, 1) @ model.query[queries]).reshape(-1, lm.WIDTH) / np.sqrt(lm.WIDTH))
    np.add.at(grad["near"], places, d_scores.sum(axis=0))
    for k in lm._WEIGHTS:
        a, v = m[k]
        a += 0.1 * (grad[k] - a)
        v += 0.01 * (grad[k] ** 2 - v)
        weight = getattr(model, k)
        weight -= (rate * 0.02 * min(1, step / 50) * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(weight.dtype)
    return loss


def test_lm_trains_as_a_plain_loop_does_in_less_time():
    model = lm.fit([" ".join(words(k, 90)) for k in range(60)], RANKS, steps=20)
    ids, at = lm.spell(pa.array([" ".join(words(k, 7 + 9 * k)) for k in range(40)]), lm._codec(RANKS))[2:]
    classes, _, first, begin, stop = lm._windows(model, ids, at)
    one, other = (replace(model, **{k: getattr(model, k).copy() for k in lm._WEIGHTS}) for _ in range(2))
    m, plain = lm._moments(one), {k: [np.zeros(getattr(model, k).shape) for _ in range(2)] for k in lm._WEIGHTS}
    spent = [[], []]
    for step in range(1, 31):
        pick = np.random.default_rng(step).integers(0, len(first), lm.BATCH)
        losses = []
        for took, run, weights, moments in zip(spent, (lm._step, plain_step), (one, other), (m, plain)):
            begun = process_time()
            losses.append(run(weights, moments, classes, first[pick], begin[pick], stop[pick], step, 0.5))
            took.append(process_time() - begun)
        assert abs(losses[0] - losses[1]) < 1e-3
    assert all(np.abs(getattr(one, k) - getattr(other, k)).max() < 1e-2 for k in lm._WEIGHTS)
    assert 2 * min(spent[0]) < min(spent[1])


def test_lm_counts_by_key():
    keys = np.random.default_rng(2).integers(0, 1 << 64, 5_000, dtype=np.uint64)
    for n in (0, 1, 5, 5_000):
        held = lm.Counts.of(keys[:n], np.arange(n) + 1)
        assert held.get(keys).tolist() == [k + 1 if k < n else 0 for k in range(5_000)]
        assert held.get(np.array([0, (1 << 64) - 1], dtype=np.uint64)).tolist() == [0, 0] and len(held.get(keys[:0])) == 0


def test_lm_is_a_distribution():
    """Over all ids that may come next, probabilities add up to one."""
    model = lm.fit(["some words to learn from and some more"] * 40, RANKS, steps=20)
    use = lm._codec(RANKS)
    import pyarrow as pa

    _, _, ids, at = lm.spell(pa.array(["some words"]), use)
    size = len(model.classes)
    table = lm.within(model, np.arange(0), np.arange(0))
    inside = int(np.flatnonzero(model.classes >= lm.BEGINNINGS)[70])
    known = lm.prefixes(np.array([int(ids[0]) + 1, (int(ids[0]) + 1) | (inside + 1) << 16], dtype=np.uint64), np.array([5, 3]))
    every = np.arange(size, dtype=np.int32)
    texts = np.stack((np.full(size, ids[0], dtype=np.int32), every), axis=1).ravel()
    both = lm.text_logprobs(model, table, known, texts, np.arange(0, 2 * size + 1, 2))
    first = lm.text_logprobs(model, table, known, ids[:1], np.array([0, 1]))
    assert abs((10 ** (both - first)).sum() - 1) < 1e-3


def test_lm_counts_all_words(spark, monkeypatch):
    docs = spark.createDataFrame([r for r in corpus() if r[0] != 500], SCHEMA)
    monkeypatch.setattr(lm, "_held", lambda events, most: lm.Prefixes(lm.Counts.of(*np.zeros((2, 0), dtype=np.uint64)), lm.Counts.of(*np.zeros((2, 0), dtype=np.uint64))))
    few, all_ = ([(r.doc_id, r.n_tokens, r.n_known, round(r.score, 3)) for r in lm.score(docs, RANKS, frequent=n).collect()] for n in (7, 1 << 18))
    assert sorted(few, key=str) == sorted(all_, key=str)
    ids = np.arange(5, 11, dtype=np.uint64)
    spelt = np.array([sum(int(x + 1) << 16 * k for k, x in enumerate(ids[:4].tolist()))], dtype=np.uint64)
    known = lm.prefixes(spelt, np.array([3]), ids[4:5] + np.uint64(1))
    assert [int(x[0]) for x in known.look(spelt, ids[4:5] + np.uint64(1))] == [3, 3]
