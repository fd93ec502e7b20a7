"""Operator 10 against plain forward-backward and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa

from candor.llm import langid

from .cases import awkward, empty

SAMPLES = {"de": "der die und nicht eine schon werden ging über haus", "en": "the and with that house would going from where thing", "fr": "le la une pas avec était maison dans être où"}


def corpus(spark, n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = ("de", "en", "fr")[k % 3]
        rows.append((k, " ".join(rng.choices(SAMPLES[lang].split(), k=rng.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain(crf, e):
    a = np.exp(crf.trans)
    alpha, beta = [np.exp(crf.start) * np.exp(e[0])], [np.ones(e.shape[1])]
    for k in range(1, len(e)):
        alpha.append((alpha[-1] @ a) * np.exp(e[k]))
        alpha[-1] /= alpha[-1].sum()
    for k in range(len(e) - 2, -1, -1):
        beta.insert(0, a @ (np.exp(e[k + 1]) * beta[0]))
        beta[0] /= beta[0].sum()
    g = np.array(alpha) * np.array(beta)
    return g / g.sum(1, keepdims=True)


def test_segments_are_exact():
    rng = np.random.default_rng(2)
    crf = langid.Crf(["a", "b", "c"], [])
    crf.trans, crf.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [0, 1, 5, 3, 40, 0, 8, 17, 4]
    off = np.concatenate([[0], np.cumsum(lengths)])
    e = rng.normal(size=(off[-1], 3)) * 2
    for segment in (1, 2, 4, 7, 100):
        got = crf.posteriors(e, off, segment)
        for a, b in zip(off, off[1:]):
            if b > a:
                assert np.allclose(got[a:b], plain(crf, e[a:b]))


def test_expected_counts_equal_the_plain_ones():
    rng = np.random.default_rng(3)
    crf = langid.Crf(["a", "b"], [])
    crf.trans = rng.normal(size=(2, 2))
    e = rng.normal(size=(4, 6, 2))
    gamma, edge, start = crf._expected(e)
    assert np.allclose(gamma, [plain(crf, x) for x in e]) and np.isclose(edge.sum(), 4 * 5) and np.allclose(start, gamma[:, 0].sum(0))


def test_held_out_accuracy_and_code_switching(spark):
    docs = corpus(spark)
    model = langid.train(docs)
    rows = {r.doc_id: r for r in langid.predict(docs.drop("lang"), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in held) >= 0.98 * len(held)
    off, e, _ = langid._Tagger(model).words(pa.array([SAMPLES["de"] + " " + SAMPLES["fr"]]))
    labels = [model.labels[k] for k in model.posteriors(e, off).argmax(1)]
    assert labels[:10].count("de") >= 9 and labels[10:].count("fr") >= 9
    mixed = spark.createDataFrame([(1, SAMPLES["de"] + " " + SAMPLES["fr"])], "doc_id long, text string")
    assert 0.4 < langid.predict(mixed, model).first().score < 0.6


def test_two_models_in_one_session(spark):
    """Workers outlive models: each stage labels with its own."""
    docs = corpus(spark, 120)
    other = spark.createDataFrame([(k, " ".join(f"q{j % 7}z" for j in range(k, k + 30)), "xx") for k in range(40)], "doc_id long, text string, lang string")
    models = [langid.train(docs), langid.train(other)]
    mixed = docs.unionByName(other)
    want = [langid.predict(mixed, m).where("score >= 0.9").count() for m in models]
    for _ in range(3):
        for m, n in zip(models, want):
            assert langid.keep_known(mixed, m, 0.9).count() == n
    assert want[0] != want[1]


def test_rare_labels_are_learned_and_long_texts_sampled_throughout(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(SAMPLES["en"].split(), k=20)), "en") for k in range(4000)]
    rows += [(5000 + k, " ".join(rng.choices(SAMPLES["fr"].split(), k=20)), "fr") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, most_docs=100)
    assert model.labels == ["en", "fr"]
    assert langid.predict(spark.createDataFrame([(1, SAMPLES["fr"])], "doc_id long, text string"), model).first().lang_pred == "fr"
    text = " ".join(f"w{k:04d}" for k in range(2000))
    short, cut, solid = (r.t for r in spark.createDataFrame([("a b",), (text,), ("x" * 5000,)], "t string").select(langid.stretches(langid.F.col("t"), 2000).alias("t")).collect())
    got = [int(w[1:]) for w in cut.split()]
    assert short == "a b" and got[0] == 0 and got[-1] == 1999 and got == sorted(got) and len(cut) <= 2003 and all(len(w) == 5 for w in cut.split())
    assert {g // 250 for g in got} >= {0, 2, 5, 7} and set(solid) == {"x", " "}


def test_awkward_rows(spark):
    model = langid.train(corpus(spark))
    docs = awkward(spark, ["12 34 $$", "日本 語"])
    rows = langid.predict(docs, model).collect()
    assert len(rows) == docs.count()
    local = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in rows:
        assert 0 <= r.score <= 1 and r.lang_pred in {"de", "en", "fr", "und"}
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in local[r.doc_id] or ""))
    assert langid.predict(empty(spark), model).collect() == []
    assert langid.train(empty(spark)) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    kept = langid.keep_known(docs, model, 0.0)
    assert kept.columns == docs.columns and kept.count() == sum(r.lang_pred != "und" for r in rows)
