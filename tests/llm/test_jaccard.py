"""Operator 9 against all pairs."""

import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from candor.llm import components, jaccard, store

from .cases import awkward, empty

WORDS = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, n):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def closure(edges, nodes):
    parent = {k: k for k in nodes}

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {k: find(k) for k in nodes}


def brute(rows, n, t):
    sets = [(r.doc_id, shingles(r.text, n)) for r in rows]
    edges = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= t * len(x | y):
                edges.append((a, b))
    comp = closure(edges, {a for a, _ in sets if a is not None})
    return sorted((str(a), len(x), str(comp.get(a))) for a, x in sets)


def near_copies(rng, families, size, words, edits):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=words)
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [copy[k], "x"]])
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("n, t", [(3, 90), (5, 80), (1, 50)])
def test_groups_equal_all_pairs(spark, n, t):
    rng = random.Random(n)
    texts = near_copies(rng, 6, 14, 60, 3) + near_copies(rng, 30, 2, 40, 2) + ["a B", "A b", "a", "c d e", "same line here"] * 2
    docs = awkward(spark, texts)
    for paired, block, pivots in ((8, 128, 1), (2, 4, 0), *([(2, 3, 2)] if n == 3 else [])):
        got = jaccard.groups(docs, n, t, sketch_bits=16, paired=paired, block=block, pivots=pivots).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(docs.collect(), n, t)


def test_a_document_with_several_texts_has_the_links_of_each(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(1, b), (2, a), (4, a), (4, b), (5, a + " more"), (6, ""), (6, "own text of six"), (7, None), (7, b), (None, a), (8, "own text of six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.groups(docs, 3, 90, sketch_bits=12).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(docs.collect(), 3, 90)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 4: 1, 5: 1, 6: 6, 7: 1, 8: 6, None: None}


def test_hot_keys(spark):
    """A third of all rows equal, a third blank, and near copies around one text, beyond the number that is salted."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(60)]
    near = [" ".join(base[:k] + [rng.choice("xyz")] + base[k + 1 :]) for k in range(59)]
    texts = near + ["the same text again and again"] * 120 + [""] * 120 + near_copies(rng, 4, 12, 30, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(docs.collect(), 3, 90)
    for parts, pivots in ((1000, 1), (7, 2), (7, 0)):
        store.HOT_PARTS = parts
        try:
            got = jaccard.groups(docs, 3, 90, sketch_bits=12, paired=3, block=8, pivots=pivots).collect()
        finally:
            store.HOT_PARTS = 1000
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_even_joins_are_joins(spark, how):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(100)] + [(None, 100), (99, 101)], "key long, id long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(6)] + [(1, "again")], "key long, value string")
    weighed = table.join(rows.groupBy("key").agg(F.count("*").alias("rows")), "key")
    store.HOT_PARTS = 5
    try:
        got = store.even_join(rows, weighed, ["key"], 102, F.col("id"), how, unique=False)
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.join(table, "key", how).collect()))
    finally:
        store.HOT_PARTS = 1000


def test_a_poor_sketch_loses_nothing(spark):
    docs = spark.createDataFrame(list(enumerate(near_copies(random.Random(9), 5, 20, 50, 4))), "doc_id long, text string")
    want = brute(docs.collect(), 3, 90)
    for bits in (1, 6):
        got = jaccard.groups(docs, 3, 90, sketch_bits=bits).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want


def test_one_of_each(spark):
    docs = awkward(spark, ["one two three four five six seven"] * 3)
    out = jaccard.one_of_each(docs, sketch_bits=12)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(r.text == "one two three four five six seven" for r in rows) == 1
    assert sum(r.doc_id is None for r in rows) == 2
    assert jaccard.groups(empty(spark), sketch_bits=12).collect() == [] and jaccard.one_of_each(empty(spark), sketch_bits=12).collect() == []


def test_components(spark):
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = closure([e for e in edges if e[0] != e[1]], nodes)
    for local in (1000, 40, 0):
        got = components.components(spark.createDataFrame(edges, "u long, v long"), local).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert components.components(spark.createDataFrame([(1, 1)], "u long, v long")).collect() == []


def test_filters_are_bounds():
    rng = np.random.default_rng(1)
    for _ in range(500):
        universe = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = (np.unique(rng.choice(universe, rng.integers(1, 50))) for _ in range(2))
        both = len(set(a) & set(b))
        for t in (50, 80, 90, 100):
            assert jaccard.linked(a, b, t) == (both > 0 and 100 * both >= t * len(set(a) | set(b)))


def test_ranges_change_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    universe = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    sets = [np.unique(rng.choice(universe, 200)) for _ in range(30)]
    want = {k: v for k, v in closure(jaccard.spanning(list(range(30)), [True] * 30, sets, 35, True), range(30)).items()}
    edges = [(a, b) for a in range(30) for b in range(a) if jaccard.linked(sets[a], sets[b], 35)]
    assert want == closure(edges, range(30)) and len(set(want.values())) < 30
    monkeypatch.setattr(jaccard, "RANGE_SHINGLES", 100)
    assert closure(jaccard.spanning(list(range(30)), [True] * 30, sets, 35, True), range(30)) == want
