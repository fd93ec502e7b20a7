"""Operator 8: base scores against brute force, the model against its definition."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pytest

from candor.llm import lm, store

from .cases import awkward, empty

WORDS = re.compile("[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


def brute(rows):
    count = collections.Counter()
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            count.update(tokens(r.text))
    n, v = sum(count.values()), len(count)
    out = []
    for r in rows:
        t = tokens(r.text)
        out.append((str(r.doc_id), r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)))
    return sorted(out)


def corpus(spark, n=150):
    rng = random.Random(3)
    nouns, verbs = [f"n{k}" for k in range(20)], [f"v{k}" for k in range(20)]
    texts = [" ".join(x for _ in range(rng.randint(5, 40)) for x in ("The", rng.choice(nouns), rng.choice(verbs))) for _ in range(n)]
    return awkward(spark, texts)


def test_base_scores_and_better_model(spark):
    docs = corpus(spark)
    rows = lm.score(docs, classes=40).collect()
    want = brute(docs.collect())
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    held = [r for r in rows if r.held_out and r.n_tokens < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(empty(spark)).collect() == []


def test_small_blocks_change_nothing(spark, monkeypatch):
    docs = corpus(spark, 40)
    want = sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.score(docs, classes=20).collect())
    monkeypatch.setattr(lm, "BLOCK_WORDS", 5)
    assert sorted((str(r.doc_id), r.n_known, round(r.base_score, 6)) for r in lm.score(docs, classes=20).collect()) == want


def test_nothing_to_learn_from(spark):
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    rows = lm.score(spark.createDataFrame([(held, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(held, 3, 0, 0, 0.0, 0.0), (None, 2, 0, 0, 0.0, 0.0)}


def learn(model, text, rng, times):
    state = {k: np.full_like(v, 1e-4) for k, v in model.p.items()}
    for turn in range(times * lm.ROUNDS):
        for words, place in lm.minibatches(text, np.zeros(len(text), np.int64), turn, rng):
            model.train(words, place, state, rng)


def test_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(5)
    n = 30
    chain = rng.dirichlet(np.full(n, 0.05), n)
    text = [0]
    for _ in range(40_000):
        text.append(int(rng.choice(n, p=chain[text[-1]])))
    text = np.array(text)
    prior = np.bincount(text, minlength=n) + 0.5
    model = lm.LogBilinear(prior / prior.sum(), width=16)
    ctx = lm.contexts(text, np.zeros(len(text), np.int64))
    before = model.ready().log_probabilities(ctx, text).mean()
    learn(model, text[:30_000], rng, 2)
    model.ready()
    assert model.log_probabilities(ctx[30_000:], text[30_000:]).mean() > before + 0.3
    some = ctx[:50]
    total = sum(np.exp(model.log_probabilities(some, np.full(50, k))) for k in range(n))
    assert np.allclose(total, 1, atol=1e-4)


@pytest.mark.parametrize("starts, want", [([0, 0, 0], [[0, 0], [5, 0], [6, 5]]), ([0, 1, 1], [[0, 0], [0, 0], [6, 0]])])
def test_contexts_stay_inside_texts(starts, want):
    assert lm.contexts(np.array([5, 6, 7]), np.array(starts)).tolist() == want


def test_every_word_above_the_count_is_learned(spark):
    assert [lm.least_count(n) for n in (0, 1000, 4_000_000, 400_000_000)] == [5, 5, 31, 312]
    words = [f"w{k}" for k in range(1500)] * 10 + ["rare", "seldom", "seldom"]
    random.Random(4).shuffle(words)
    docs = spark.createDataFrame([(k, " ".join(words[k::20])) for k in range(20)], "doc_id long, text string")
    count = collections.Counter(t for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for t in tokens(r.text) if t)
    own = sum(c >= 5 for c in count.values())
    assert 1022 < own < len(count)
    scores = lambda **k: np.array([r.score for r in lm.score(docs, rounds=0, **k).orderBy("doc_id").collect()])
    grown = scores()
    assert np.allclose(grown, scores(classes=own + 2)) and not np.allclose(grown, scores(classes=1024))


def test_grouped_probabilities_sum_to_one_and_training_helps():
    rng = np.random.default_rng(6)
    n = 700
    prior = np.concatenate([[30.0, 9.0], 500 / np.arange(1, n - 1)])
    prior /= prior.sum()
    follows = rng.permutation(n)
    text = [0]
    for _ in range(40_000):
        text.append(int(follows[text[-1]]) if rng.random() < 0.6 else int(rng.choice(n, p=prior)))
    text = np.array(text)
    counts = np.bincount(text[:30_000], minlength=n) + 0.5
    model = lm.LogBilinear(counts / counts.sum(), width=16)
    assert len(model.levels) == 2 and 16 < len(model.starts) - 1 < n and model.group[:3].tolist() == [0, 1, 2]
    ctx = lm.contexts(text, np.zeros(len(text), np.int64))
    before = model.ready().log_probabilities(ctx[30_000:], text[30_000:]).mean()
    learn(model, text[:30_000], rng, 4)
    model.ready()
    assert model.log_probabilities(ctx[30_000:], text[30_000:]).mean() > before + 0.1
    assert np.allclose(sum(np.exp(model.log_probabilities(ctx[:40], np.full(40, k))) for k in range(n)), 1, atol=1e-3)


def test_normalisers_are_the_same_from_the_table_and_directly(monkeypatch):
    rng = np.random.default_rng(8)
    prior = np.concatenate([[30.0, 9.0], 500 / np.arange(1, 600)])
    text = rng.choice(len(prior), 3000, p=prior / prior.sum())
    model = lm.LogBilinear(prior / prior.sum(), width=8)
    model.p["r"] *= 40  # scores far apart
    ctx = lm.contexts(text, np.zeros(len(text), np.int64))
    want = model.ready().log_probabilities(ctx, text)
    h = np.concatenate([sum(model.p["r"][ctx[:, k]] @ model.p["c"][k] for k in range(lm.CONTEXT)), np.ones((len(text), 1))], 1)
    plain = lambda x, k: x[np.arange(len(k)), k] - lm.log_sums(x.copy())
    group = model.group[text]
    direct = plain(h @ model.p["gq"].T, group)
    for k, g in enumerate(group):
        direct[k] += plain(h[k : k + 1] @ model.p["q"][model.starts[g] : model.starts[g + 1]].T, np.array([text[k] - model.starts[g]]))[0]
    assert np.allclose(want, direct, rtol=1e-3, atol=1e-3)
    for most, edge in ((0, 0), (50, 0), (50, 7), (len(prior), 3)):
        monkeypatch.setattr(lm, "FREQUENT", most)
        monkeypatch.setattr(lm, "EDGE", edge)
        assert np.allclose(model.ready().log_probabilities(ctx, text), want, rtol=1e-3, atol=1e-3)


def test_stretches_cover_each_token_once():
    rng = np.random.default_rng(9)
    classes, starts = np.arange(1000) + 2, np.repeat([0, 300, 301], [300, 1, 699])
    seen, ctx = [], lm.contexts(classes, starts)
    for turn in range(lm.ROUNDS):
        for words, place in lm.minibatches(classes, starts, turn, rng):
            assert words.shape == (len(place), place.shape[1] + lm.CONTEXT)
            for w, at in zip(words, place):
                for k, x in enumerate(at):
                    t = w[lm.CONTEXT + k] - 2
                    seen.append(t)
                    assert x == t - starts[t] and all(ctx[t, j] == (w[lm.CONTEXT + k - 1 - j] if x > j else lm.END) for j in range(lm.CONTEXT))
    assert sorted(seen) == list(range(1000))


def test_scores_repeat(spark):
    docs = corpus(spark, 60).repartition(3)
    runs = [sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(docs, classes=30).collect()) for _ in range(2)]
    assert runs[0] == runs[1]


def shuffled(spark, after=-1):
    """(bytes written to shuffles by stages after this one, last stage)"""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    kept = sc.statusStore()
    stages = kept.stageList(None, False, False, getattr(kept, "stageList$default$4")(), None)
    own = [stages.apply(k) for k in range(stages.size())]
    return sum(s.shuffleWriteBytes() for s in own if s.stageId() > after), max((s.stageId() for s in own), default=-1)


def test_less_is_shuffled_than_read_and_tables_go(spark):
    rng = np.random.default_rng(12)
    words = np.array([f"{k * 7919 % 100_003:x}{'aeiou'[k % 5]}{k % 89:x}" for k in range(60_000)])
    p = 1 / np.arange(1, len(words) + 1)
    drawn = rng.choice(words, (1500, 250), p=p / p.sum())
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(drawn)], "doc_id long, text string").repartition(3)
    folder = store.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    docs = store.written(docs, "docs")
    _, last = shuffled(spark)
    rows = lm.score(docs, rounds=0).collect()
    sent, _ = shuffled(spark, last)
    assert len(rows) == 1500
    assert sent < 0.5 * sum(len(w) + 1 for line in drawn for w in line)
    assert {x[: x.rindex("-")] for x in set(os.listdir(folder)) - before if x.startswith("lm-")} == {"lm-classes"}


@pytest.mark.parametrize("values", [[0], [5, 0, 70_000, 2**31 - 1, 3], list(range(1000))])
def test_packed_numbers_come_back(values):
    for kind in (np.int32, np.int64):
        got = lm.unpacked(lm.packed(np.array(values, kind)), kind)
        assert got.dtype == kind and got.tolist() == values


def test_words_in_many_parts_of_many_blocks(spark, monkeypatch):
    docs = corpus(spark, 40).repartition(3)
    own = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, rounds=0, classes=20).collect())
    want = own()
    monkeypatch.setattr(lm, "PARTS", (1, 1))
    assert own() == want
    monkeypatch.setattr(lm, "PARTS", (7, 7))
    monkeypatch.setattr(lm, "BLOCK_WORDS", 5)
    assert own() == want
