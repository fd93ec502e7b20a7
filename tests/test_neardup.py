"""Near duplicates among copies: one comparison for each pair of different texts, all pairs of ids in the result."""

import difflib

import random

import numpy as np
from pyspark.sql import functions as F

from candor.functions import ratio
from candor.functions import text as T
from candor.operators import neardup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
A, B = " ".join(WORDS), " ".join([*WORDS[:9], "quiz", *WORDS[10:], "jazz"])


def test_copies_are_compared_once_and_paired_whole(spark, monkeypatch):
    texts = [A, B, A, "other words that are far from any of these", B, A, "tiny", "tiny", "two words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    seen, whole = [], neardup.distinct_pairs
    monkeypatch.setattr(neardup, "distinct_pairs", lambda d, *rest: (seen.append(d.count()), whole(d, *rest))[1])
    sets = [None if t is None else {tuple(t.split(" ")[i : i + 5]) for i in range(len(t.split(" ")) - 4)} for t in texts]
    want = {}
    for i, x in enumerate(sets):
        for j in range(i + 1, len(sets)):
            if x is not None and sets[j] is not None:
                union = len(x | sets[j])
                jaccard = len(x & sets[j]) / union if union else 1.0
                ratio = difflib.SequenceMatcher(None, texts[i], texts[j]).ratio()
                want[i, j] = (jaccard, ratio)
    got = {(r.a, r.b): r.jaccard for r in neardup.shingle_pairs(docs, 0.4).collect()}
    assert got == {k: v[0] for k, v in want.items() if v[0] >= 0.4} and seen == [6]
    got = {(r.a, r.b): (r.jaccard, r.ratio) for r in neardup.document_pairs(docs).collect()}
    assert got == {k: v for k, v in want.items() if v[0] >= 0.4 or (v[0] >= 0.08 and v[1] >= 0.82)}


def test_texts_that_cannot_reach_a_ratio(spark):
    may = spark.createDataFrame([(A, B), (A, A + " x" * 200), ("abc", "xyz")], "a string, b string").select(neardup._may_reach("a", "b", 0.82)).collect()
    assert [r[0] for r in may] == [True, False, False]


def test_ascii_words_as_the_jvm_has_them(spark):
    odd = [None, "", " ", "é", "  a  B\t_c9 ", "ÀB--c İstanbul \u212a9 ǅ ß ſ ﬁ", "x" * 5000, "\n", "a\n\n", "\x00a\x85b\u2003c", "Ünïcode tail é"]
    every = ["".join(chr(c) for c in range(k, k + 512) if not 0xD800 <= c < 0xE000) for k in range(0, 0x20000, 512)]
    rows = spark.createDataFrame([(t,) for t in [*odd, *every]], "t string")
    got = rows.select(T.normalise_ascii_words("t").alias("a"), T.normalise_ascii(F.col("t")).alias("b")).collect()
    assert len(got) == len(odd) + len(every) and all(r.a == r.b for r in got)


def test_packed_integers_come_back():
    for values in ([], [0], [1, 255], [256, 3, 0], [(1 << 59) - 1, 5]):
        assert neardup.unpacked(neardup.packed(np.array(values, np.uint64))).tolist() == values


def edited(count: int, seed: int = 3) -> list[str]:
    """Texts with a common line, some made of others with a few words changed; two families of many near copies."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for k in range(count):
        if texts and rng.random() < 0.6:
            own = texts[rng.randrange(len(texts)) if k % 3 else k % 2].split(" ")
            for _ in range(rng.choice([0, 1, 2, 5, 9])):
                own[rng.randrange(len(own))] = word()
        else:
            own = [word() for _ in range(rng.choice([2, 5, 30, 60, 90]))] + (line.split(" ") if k % 2 else [])
        texts.append(" ".join(own))
    return texts


def test_pairs_by_blocks_are_all_pairs(spark, monkeypatch):
    """Small blocks: components of more than one block, and each document in few groups, not along with each pair."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "RATED_BLOCK", 4)
    moved, whole = [], neardup.by_blocks
    monkeypatch.setattr(neardup, "by_blocks", lambda pairs, docs, *rest: (moved.append(pairs.count()), whole(pairs, docs, *rest))[1])
    texts = edited(90)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, norm string").repartition(3)
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(len(t.split(" ")) - 4)} for t in texts]
    jaccard = lambda x, y: len(x & y) / len(x | y) if x or y else 1.0
    pairs = {(i, j): jaccard(sets[i], sets[j]) for i in range(90) for j in range(i + 1, 90)}
    want = {k: v for k, v in pairs.items() if v >= 0.4}
    assert {(r.a, r.b): r.jaccard for r in neardup.shingle_pairs(docs, 0.4).collect()} == want and len(want) > 100
    # what is verified, of different texts, is hardly more than what links, not all that share an n-gram
    once = [v for (i, j), v in pairs.items() if sets[i] and sets[j] and texts.index(texts[i]) == i and texts.index(texts[j]) == j]
    linked = sum(v >= 0.4 for v in once)
    assert linked <= moved[0] <= 1.2 * linked < sum(v > 0 for v in once), (linked, moved, sum(v > 0 for v in once))
    got = {(r.a, r.b): (r.jaccard, r.ratio) for r in neardup.document_pairs(docs).collect()}
    rated = {k: (v, difflib.SequenceMatcher(None, texts[k[0]], texts[k[1]]).ratio()) for k, v in pairs.items() if v >= 0.08}
    assert got == {k: v for k, v in rated.items() if v[0] >= 0.4 or v[1] >= 0.82}


def test_ratios_are_those_of_difflib(monkeypatch):
    """And find_longest_match, which goes over both texts again for each block, isn't run for long texts."""
    rng = random.Random(5)
    pairs = []
    for n in (0, 1, 199, 200, 300, 700, 700, 700):
        for letters, power in (("ab ", 0), ("abcdefghijklmnopqrstuvwxyz ", 2), ("abcdefghijklmnopqrstuvwxyz 0123456789é]^-\\", 3)):
            weights = [rng.random() ** power + 1e-3 for _ in letters]
            later = rng.choices(letters, weights, k=n)
            own = list(later)
            for _ in range(12):
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.choice([0, 0, 1, 9])] = rng.choices(letters, weights, k=rng.choice([0, 1, 5, 40]))
            pairs += [("".join(own), "".join(later)), ("".join(reversed(own)), "".join(later)), ("", "".join(later))]
    want = [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert [ratio.Later(b).ratio(a) for a, b in pairs] == want
    long = [k for k, (a, b) in enumerate(pairs) if len(b) >= 200]
    monkeypatch.setattr(difflib, "SequenceMatcher", None)
    assert [ratio.Later(pairs[k][1]).ratio(pairs[k][0]) for k in long] == [want[k] for k in long]
