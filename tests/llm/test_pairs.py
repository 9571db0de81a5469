"""Exact, near-duplicate and passage operators against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from spindrift.llm import components, exact_dedup, ngram_join, passages, textcore
from tests.llm.fixtures import corpus, documents, nothing, words


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=75):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        groups[find(x)].append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets)), key=str)


def test_word_primitives():
    texts = ["A b\tC", "", "é x\x0by", "one", "a" * 3_000_000 + " z"]
    import pyarrow as pa

    data, offsets = textcore.buffers(pa.array(texts))
    hashes, at = textcore.word_hashes(data, offsets)
    split = [t.encode().lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(s) for s in split]
    names = {}
    for word, h in zip((w for s in split for w in s), hashes.tolist()):
        assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("short", [32, 1])
def test_join_equals_brute_force(spark, short):
    got = ngram_join.near_duplicates(documents(spark, clashing=short == 1), short=short).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_components(corpus())


def test_join_of_crowded_copies(spark, monkeypatch):
    import random

    rnd, base = random.Random(3), [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = base[:]
        for _ in range(rnd.randrange(4)):
            own[rnd.randrange(60)] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(own), None, None, None))
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), short=2).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_components(rows)


def test_join_with_names_that_sets_share(spark, monkeypatch):
    """Many sets share their first hash; the second tells them apart."""
    monkeypatch.setattr(ngram_join, "signature", lambda tokens: int(tokens[0]) % 3 * 4 + 4 | min(len(tokens), 3))
    got = ngram_join.near_duplicates(documents(spark)).collect()
    assert sorted(((r[0], r[1], r[2]) for r in got), key=str) == brute_components(corpus())


def test_representatives(spark):
    a, b = " ".join(words(1, 70)), " ".join(words(2, 70))
    rows = [(3, a), (5, b), (5, a), (5, b.upper()), (7, ""), (7, ""), (8, None), (9, " ".join(words(2, 70)[:68])), (None, a), (None, "other words only here in this row")]
    got = ngram_join.representatives(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, sig int"))
    assert got.columns == ["doc_id", "text", "sig"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(3, a), (5, b.upper()), (7, ""), (8, None), (None, "other words only here in this row")], key=str)


def test_join_of_nothing(spark):
    assert ngram_join.near_duplicates(nothing(spark)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5)], "a long, b long")
    assert dict(components.components(edges).collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("digest_bytes,keep,clashing,runs,most", [(32, "largest", True, 4, 1 << 24), (1, "smallest", False, 1, 1 << 24), (32, "smallest", False, 8, 8)])
def test_exact_dedup(spark, digest_bytes, keep, clashing, runs, most):
    got = exact_dedup.deduplicate(documents(spark, clashing), digest_bytes=digest_bytes, keep=keep, runs=runs, most=most).collect()
    groups = defaultdict(list)
    for i, t, *_ in corpus():
        groups[t or ""].append(i)
    best = max if keep == "largest" else min
    want = []
    for ids in groups.values():
        chosen = best((i for i in ids if i is not None), default=None)
        want += [(i, chosen, len(ids), i == chosen) for i in ids]
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    assert exact_dedup.deduplicate(nothing(spark)).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(1)
    to = np.concatenate(([0], np.cumsum(rng.integers(0, 40, 6))))
    values = rng.integers(0, 1 << 62, to[-1]).astype(np.uint64)
    want = []

    def tree(left, right):
        if right - left + 1 >= 5:
            c = left + int(values[left : right + 1].argmin())
            want.append((max(left, c - 4), c, min(right, c + 4)))
            tree(left, c - 1)
            tree(c + 1, right)

    for d in range(6):
        tree(int(to[d]), int(to[d + 1]) - 1)
    assert sorted(zip(*(x.tolist() for x in passages.compact_windows(values, to, 5)))) == sorted(want)


@pytest.mark.parametrize("short", [16, 1])
def test_passages(spark, monkeypatch, short):
    monkeypatch.setattr(passages, "SHORT", short)
    got = passages.repeated(documents(spark, clashing=short == 1)).collect()
    found = {frozenset((r.doc_id, r.of_doc_id)) for r in got}
    texts = {i: (t or "").encode().lower().split() for i, t, *_ in corpus() if i is not None}
    held = defaultdict(set)
    for i, w in texts.items():
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])].add(i)
    repeats = {i for ids in held.values() if len(ids) > 1 for i in ids}
    assert repeats <= {i for pair in found for i in pair}
    assert frozenset((9, 10)) in found
    for r in got:
        a, b = texts[r.of_doc_id][r.of_start : r.of_end], texts[r.doc_id][r.start : r.end]
        x, y = shingles(b" ".join(a).decode()), shingles(b" ".join(b).decode())
        assert len(a) >= 50 and len(b) >= 50 and 100 * len(x & y) >= 75 * len(x | y)
    assert passages.repeated(nothing(spark)).count() == 0


def test_passages_of_several_texts_of_one_id(spark):
    one, two, three = (words(k, 70) for k in (1, 2, 3))
    rows = [(1, one), (1, two), (2, one), (3, words(4, 9) + two), (None, three), (None, words(5, 7) + three), (None, one), (1, one), (4, None)]
    got = passages.repeated(spark.createDataFrame([(i, " ".join(t) if t else t) for i, t in rows], "doc_id long, text string")).collect()
    got = {(r.doc_id, r.of_doc_id) for r in got}
    star = {(2, 1), (None, 1), (None, 2)}  # which of the three stands for them depends on the numbers of the rows
    assert got - star == {(3, 1), (None, None)} and len(got & star) == 2


def test_recall_of_planted_passages(spark):
    """Passages of 60 words with up to two changed words, in other surroundings: the least similarity is over 0.75."""
    rows, planted = [], []
    for k in range(120):
        passage = words(10_000 + k, 60)
        other = passage[:]
        for e in range(k % 3):
            other[(17 * k + 23 * e) % 60] = f"edit{k}x{e}"
        x, y = shingles(" ".join(passage)), shingles(" ".join(other))
        rows += [(2 * k, words(k, 50 + k % 40) + passage + words(500 + k, 30)), (2 * k + 1, words(900 + k, 20 + k % 60) + other + words(1500 + k, 50))]
        if 100 * len(x & y) >= 75 * len(x | y):
            planted.append((2 * k + 1, 2 * k, k % 3))
    got = {(r.doc_id, r.of_doc_id) for r in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert all((b, a) in got for b, a, edits in planted if edits == 0)
    assert sum((b, a) in got for b, a, _ in planted) >= 0.9 * len(planted) and got <= {(2 * k + 1, 2 * k) for k in range(120)}


def test_links_that_pass_by_the_least_text(spark):
    """The second of three texts matches both others, which don't match each other; none of the links may be missing."""
    rows = []
    for k in range(30):
        one = words(20_000 + k, 60)
        two = one[:25] + [f"edit{k}"] + one[26:]
        three = two[:35] + [f"more{k}"] + two[36:]
        rows += [(3 * k + n, words(30_000 + 3 * k + n, 30 + k) + t + words(40_000 + 3 * k + n, 40)) for n, t in enumerate((one, two, three))]
    got = {(r.doc_id, r.of_doc_id) for r in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert got == {(3 * k + n + 1, 3 * k + n) for k in range(30) for n in (0, 1)}


@pytest.mark.parametrize("lines", [False, True])
def test_crowded_windows_without_matches_cost_little(spark, monkeypatch, lines):
    """Texts that share one word over and over, or a line, in other surroundings don't meet each other one by one."""
    line, compared, verified = words(70_000, 20), [], passages._verified
    part = lambda i: line if lines else ["the"] * (60 if i % 4 == 1 else 20)
    rows = [(i, words(50_000 + i, 60) + part(i) + words(60_000 + i, 60)) for i in range(60)]
    rows += [(100 + i, words(80_000 + i, 60) + words(50_000 + i, 130)[:55]) for i in range(2)]
    monkeypatch.setattr(passages, "_verified", lambda spans, *rest: compared.append(spans.count()) or verified(spans, *rest))
    got = {(r.doc_id, r.of_doc_id) for r in passages.repeated(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    same = {i for i in range(60) if i % 4 == 1 and not lines}
    assert {(100, 0), (101, 1)} <= got and {i for pair in got - {(100, 0), (101, 1)} for i in pair} == same
    assert sum(compared) <= 4 * len(rows)


def test_matching_passages_have_a_run_in_common():
    assert passages.sure_run(46, 75, 5) == 14 and passages.sure_run(46, 100, 5) == 50


def repeats_of(a, b, least):
    """Places of b within runs of ``least`` tokens that a holds, by brute force."""
    runs = {tuple(a[k : k + least]) for k in range(len(a) - least + 1)}
    return {p for k in range(len(b) - least + 1) if tuple(b[k : k + least]) in runs for p in range(k, k + least)}


def similar(a, b, p, q, r, s):
    x, y = set(a[p:q]), set(b[r:s])
    return len(x & y) / len(x | y)


def test_matching_covers_exact_repeats():
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    whole, one, two = fresh(996), fresh(46), fresh(46)
    cases = [(np.concatenate((whole[:498], fresh(200), whole[498:])), whole), (np.concatenate((one, fresh(30), two)), np.concatenate((fresh(9), one, two)))]
    for _ in range(60):  # few kinds, so that tokens recur
        base = rng.integers(0, rng.integers(4, 200), 150).astype(np.uint64)
        cuts = [base[i : i + rng.integers(10, 90)] for i in rng.integers(0, 120, 6)]
        cases.append((base, np.concatenate([x for c in cuts for x in (c, fresh(rng.integers(0, 12)))])))
    for a, b in cases:
        for x, y in ((a, b), (b, a)):
            got = passages.matching(x, y, 46, 75)
            assert repeats_of(x.tolist(), y.tolist(), 46) <= {k for r in got for k in range(r[2], r[3])}
            for p, q, r, s, sim in got:
                assert q - p >= 46 and s - r >= 46 and sim >= 0.75 and abs(similar(x.tolist(), y.tolist(), p, q, r, s) - sim) < 1e-9


def test_matching_of_short_near_passages():
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 1 << 62, n).astype(np.uint64)
    for size in (46, 50, 64):
        for place in range(0, size - 4):
            one, two = fresh(size), fresh(200)
            other, far = one.copy(), two.copy()
            other[place : place + 5] = fresh(5)
            far[100:105] = fresh(5)
            a = np.concatenate((fresh(20), one, fresh(90), two, fresh(20)))
            b = np.concatenate((fresh(33), other, fresh(70), far))
            for x, y in ((a, b), (b, a)):
                got = {t for r in passages.matching(x, y, 46, 75) for t in y[r[2] : r[3]].tolist()}
                for part in (one, two):
                    shared = set(part.tolist()) & set(x.tolist()) & set(y.tolist())
                    assert len(shared & got) >= 41


def test_matching_finds_what_brute_force_finds():
    rng = np.random.default_rng(7)
    for turn in range(60):
        base = rng.integers(0, 1 << 62, 24).astype(np.uint64)
        other = base[int(rng.integers(0, 4)) :].copy()
        for _ in range(int(rng.integers(1, 4))):
            k = int(rng.integers(0, len(other)))
            new = rng.integers(0, 1 << 62, int(rng.integers(1, 4))).astype(np.uint64)
            other = np.concatenate((other[:k], new, other[k + int(rng.integers(0, 3)) :]))
        for x, y in ((base, other), (other, base)):
            got = {k for r in passages.matching(x, y, 10, 75) for k in range(r[2], r[3])}
            a, b = x.tolist(), y.tolist()
            spans = lambda t: [(i, j) for i in range(len(t)) for j in range(i + 10, len(t) + 1)]
            for r, s in spans(b):
                if not got & set(range(r, s)):
                    assert all(similar(a, b, p, q, r, s) < 0.75 for p, q in spans(a)), (turn, r, s)


def test_edited_copies_of_a_common_passage(spark):
    passage = words(50, 90)
    edited = passage[:45] + ["changed"] + passage[46:]
    texts = [words(100 + i, 60 + i) + passage + words(300 + i, 60) for i in range(30)]
    texts += [words(200 + i, 70 + i) + edited[: 45 + i] + [f"new{i}"] + edited[46 + i :] + words(400 + i, 60) for i in range(4)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id for r in passages.repeated(docs).collect()}
    assert found == set(range(1, 34))


def test_texts_before_a_representative_repeat_the_first_of_them(spark):
    """The representative shares more than the passage, with later texts; earlier ones are reported all the same."""
    passage, line = words(50, 60), words(70, 30)
    texts = [words(100 + i, 60 + i) + passage + (line if i >= 10 else []) + words(300 + i, 60) for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = passages.repeated(docs).collect()
    assert {r.doc_id for r in got} == set(range(1, 40)) and all(r.of_doc_id < r.doc_id for r in got)
    assert {r.doc_id for r in got if r.of_doc_id == 0} >= set(range(1, 10)) and len(got) < 200


def test_only_stretches_are_joined_with_pairs(spark):
    """Many hits of a pair are one stretch before the pairs are joined."""
    windows = spark.createDataFrame([(16 * k, i, 10 * k, False) for k in range(200) for i in (1, 2)], "key long, id long, c int, crowded boolean")
    hits = passages._hits(windows, windows)
    spans = passages._spans(hits, passages._gathered(hits, 1), 92)
    assert [tuple(r) for r in spans.collect()] == [(1, 0, 2083, 2, 0, 2083)]
    plan = spans._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    sides = [plan.children().apply(i).toString() for i in range(2)]
    assert any("Aggregate" in side.split("lag(")[0] for side in sides if "lag(" in side)


def test_one_hit_with_a_representative_is_enough(spark, monkeypatch):
    monkeypatch.setattr(passages, "SHORT", 1)
    passage = words(50, 60)
    docs = spark.createDataFrame([(i, " ".join(words(100 + i, 60 + i) + passage + words(300 + i, 60))) for i in range(20)], "doc_id long, text string")
    assert {r.doc_id for r in passages.repeated(docs, hashes=1).collect()} == set(range(1, 20))


@pytest.mark.parametrize("moved", [(31, 32), (0, -1), (5, 60)])
def test_hits_on_moved_diagonals_make_candidates(spark, moved):
    rows = [(16 * k + 2 * k, i, c, False) for k, d in enumerate(moved) for i, c in ((1, 100 + 100 * k), (2, 100 + 100 * k + d))]
    windows = spark.createDataFrame(rows, "key long, id long, c int, crowded boolean")
    hits = passages._hits(windows, windows)
    pairs = passages._gathered(hits, 2)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert [tuple(r) for r in passages._spans(hits, pairs, 92).collect()] == [(1, 8, 285, 2, 100 + moved[0] - 92, 100 + moved[1] - moved[0] + 185)]


def test_every_place_of_a_repeat_is_found(spark):
    passage = words(50, 60)
    long_ = words(1, 40) + passage + words(2, 700) + passage + words(3, 500) + passage
    docs = spark.createDataFrame([(1, " ".join(words(4, 300) + passage)), (2, " ".join(long_))], "doc_id long, text string")
    got = sorted((r.start, r.end) for r in passages.repeated(docs).collect())
    assert got == [(40, 100), (800, 860), (1360, 1420)]


def test_runs_of_blocks_hold_each_stretch(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(5_000)]
    texts = [rng.choices(words, k=n) for n in (3_000, 2_000, 300)]
    places = [(0, 2_900, 1, 0, 90), (0, 700, 2, 240, 60)]
    for x, i, y, j, n in places:
        texts[y][j : j + n] = texts[x][i : i + n]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id long, text string")
    spans = [(x, max(0, i - 92), n + 92 + min(i, 92), y, max(0, j - 92), n + 92 + min(j, 92)) for x, i, y, j, n in places]
    spans = spark.createDataFrame(spans, "a long, a_from int, a_size int, b long, b_from int, b_size int")
    runs = passages._sequences(docs, spans, 5)
    held = runs.selectExpr("id", "low", "size(tokens) n").collect()
    assert sum(r.n for r in held if r.id == 0) < 1_500  # the rest of the long text stays behind
    found = passages._verified(spans, runs, 46, 75, 5).collect()
    for x, i, y, j, n in places:
        assert any((r.a, r.b) == (x, y) and r.a_start <= i and i + n <= r.a_end and r.b_start <= j and j + n <= r.b_end for r in found)
