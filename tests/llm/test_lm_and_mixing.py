import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm_score, mixing
from ledgerlens.llm.lm_score import lm_scores
from ledgerlens.llm.mixing import mix, mixed_documents
from tests.llm.cases import ODD, clashing, docs, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    import re

    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def brute_lm(table, order, leave_out=True, alpha=0.4):
    texts = [words(r[1]) for r in table]
    grams = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    own = [{k: grams(w, k) for k in range(1, order + 1)} for w in texts]
    every = {k: sum((o[k] for o in own), Counter()) for k in range(1, order + 1)}
    total = sum(map(len, texts))
    out = []
    for r, w, o in zip(table, texts, own, strict=True):
        c = lambda g: every[len(g)][g] - (o[len(g)][g] if leave_out else 0)  # noqa: E731, B023
        rest = max(1, total - (len(w) if leave_out else 0))
        score = 0.0
        for i in range(len(w)):
            s, k = None, min(order, i + 1)
            factor = 1.0
            while k > 1 and s is None:
                g = tuple(w[i - k + 1 : i + 1])
                if c(g) > 0:
                    s = factor * c(g) / c(g[:-1])
                factor, k = (factor, k) if s is not None else (factor * alpha, k - 1)
            if s is None:
                n = c((w[i],))
                s = factor * (n / rest if n > 0 else 1 / (rest + 1))
            score += math.log(s)
        out.append((r[0], len(w), round(score, 6) + 0.0))
    return sorted(out, key=str)


def corpus(seed, n=80):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["the", "The", "cat", "sat", "on", "mat", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(40))), "en", "s", 1) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("leave_out", [True, False])
def test_scores_are_brute_force(spark, order, leave_out, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_GRAMS", 500)
    table = corpus(order) + [(900, None, None, None, 1), (None, "the cat", None, None, 1), (901, "the the the unseen", "", "", 1)]
    found = lm_scores(clashing(docs(spark, table)), order=order, leave_out=leave_out).select("doc_id", "n_words", (F.round("log_score", 6) + 0.0).alias("s"))
    assert rows(found) == brute_lm(table, order, leave_out)


def test_odd_rows_and_no_rows(spark):
    found = lm_scores(docs(spark)).select("doc_id", "n_words", (F.round("log_score", 6) + 0.0).alias("s"))
    assert rows(found) == brute_lm(ODD, 3)
    assert lm_scores(docs(spark, [])).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_scores_over_many_chunks(spark, order):
    """Grams known within a chunk, in others, in both and in none."""
    table = corpus(7, 60) + [(700 + i, f"the cat sat on mat{i} w{i} " * 3, "en", "s", 1) for i in range(20)]
    many = docs(spark, table, 40)  # a chunk for each partition, and more
    found = lm_scores(many, order=order).select("doc_id", "n_words", (F.round("log_score", 6) + 0.0).alias("s"))
    assert rows(found) == brute_lm(table, order)


def test_chunks_are_made_once(spark):
    """What needs the chunks reads one shuffle of them, and grams are shuffled once."""
    df = lm_scores(docs(spark, corpus(3)))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow run(doc_id") == 1 and plan.count("MapInArrow run(chunk") == 1 and plan.count("ReusedExchange") >= 2


def test_words_of_long_texts_are_those_of_short_ones(monkeypatch):
    text = "alpha  beta\tgamma " * 500
    whole = lm_score._words(text)
    monkeypatch.setattr(lm_score, "SLICE", 100)
    assert lm_score._words(text).tolist() == whole.tolist() and len(whole) == 1500
    assert len(lm_score._words("")) == len(lm_score._words(" ")) == 0


def test_a_copy_is_told_from_what_occurs_once(spark):
    """A text that occurs twice scores above one that occurs once, word for word, by its long grams."""
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(40)]) for _ in range(60))
    twin = [text() for _ in range(10)]
    table = [(i, text(), "en", "s", 1) for i in range(100)] + [(1000 + i + 100 * j, t, "en", "s", 1) for i, t in enumerate(twin) for j in (0, 1)]
    found = lm_scores(docs(spark, table)).collect()
    mean = {r.doc_id: r.log_score / r.n_words for r in found}
    assert min(v for k, v in mean.items() if k >= 1000) > max(v for k, v in mean.items() if k < 1000)


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        per = left / sum(w[s] for s in open_)
        above = {s for s in open_ if per * w[s] > cap * sizes[s]}
        if not above:
            return target | {s: per * w[s] for s in open_}
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def sources(seed, n=600):
    rng = random.Random(seed)
    names = ["hot", "hot", "a", "b", "𐀀", "￿", None, "c"]
    return [(i, "w " * int(rng.paretovariate(0.8) * 5 % 3000), "en", rng.choice(names), 1) for i in range(n)]


@pytest.mark.parametrize("table", [sources(1), sources(2, 5000), ODD, []])
def test_mix_meets_its_targets(spark, table, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 16)
    found = mix(clashing(docs(spark, table))).collect()
    assert len(found) == len(table)
    sizes, taken, target, top = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    by_key = defaultdict(list)
    for r in table:
        by_key[r[0], len(words(r[1]))].append(r[3])
        sizes[r[3]] += len(words(r[1]))
        top[r[3]] = max(top[r[3]], len(words(r[1])))
    want = brute_targets(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    for r in found:
        source = by_key[r.doc_id, r.size].pop()
        assert r.source_size == sizes[source] and math.isclose(r.target, want[source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source] += r.taken
        target[source] = r.target
    for s in target:
        assert abs(taken[s] - target[s]) <= max(top[s] / 2 + 1e-6, 0.01 * target[s]), (s, taken[s], target[s])


def test_reruns_agree_however_rows_are_dealt(spark):
    table = sources(3, 2000)
    once = rows(mix(docs(spark, table, 3)))
    assert once == rows(mix(docs(spark, table, 7)))
    assert once != rows(mix(docs(spark, table, 3), seed=8))


def test_copies_keep_their_expectation(spark):
    """Over seeds, a document's mean copies are its source's target over size."""
    table = [(i, "w " * (50 + i % 7), "en", "ab"[i % 2], 1) for i in range(40)]
    total, want, n = Counter(), {}, 5
    for seed in range(n):
        for r in mix(docs(spark, table, 1), seed=seed).collect():
            total[r.doc_id % 2] += r.taken / r.size
            want[r.doc_id % 2] = r.target / r.source_size
    assert all(abs(total[parity] / n / 20 - want[parity]) < 0.05 for parity in (0, 1))


def test_rows_that_repeat_do_not_meet_in_a_leaf(spark):
    """2,000 copies of one row: their copies sum up to what they should, and no array has them all."""
    table = [(5, "same words in each", "en", "a", 1)] * 2000 + [(i, "w " * (i % 9 + 1), "en", "ab"[i % 2], 1) for i in range(500)]
    found = mix(docs(spark, table)).collect()
    assert len(found) == len(table)
    for source in "ab":
        own = [r for r, t in zip(sorted(found, key=lambda r: (r.doc_id, r.size)), sorted(table, key=lambda t: (t[0], len(words(t[1])))), strict=True) if t[3] == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 9
    times = Counter(r.taken // r.size for r in found if r.doc_id == 5 and r.size == 4)
    assert len(times) == 2 and max(times) == min(times) + 1


def test_mixed_documents_repeat_rows(spark):
    table = sources(4, 300) + [(7, "same words here", "en", "a", 1)] * 2
    taken = Counter()
    for r in mix(docs(spark, table)).collect():
        taken[r.doc_id] += r.taken
    mixed = mixed_documents(docs(spark, table))
    assert mixed.columns == docs(spark).columns
    got = Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
    assert +got == +taken


def test_runs_of_grams_in_little_memory():
    """One order gives the counts of grams and of each document's grams, in fewer bytes a gram than two sorts with inverses take (some 100)."""
    import tracemalloc

    from ledgerlens.llm.lm_score import _runs

    rng = np.random.default_rng(2)
    h, doc = rng.integers(0, 50_000, 400_000).astype(np.uint64), np.sort(rng.integers(0, 900, 400_000)).astype(np.int32)
    tracemalloc.start()
    by, began, own_began = _runs(h, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak <= 40 * len(h)
    known, n = np.unique(h, return_counts=True)
    assert (h[by][began] == known).all() and (np.diff(began, append=len(by)) == n).all()
    _, own = np.unique(h.astype(np.int64) * 1000 + doc, return_counts=True)
    assert (np.diff(own_began, append=len(by)) == own).all()
    assert [len(x) for x in _runs(h[:0], doc[:0])] == [0, 0, 0]
