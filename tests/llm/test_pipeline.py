"""The pipeline against brute force on a small table."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from candor.llm import langid

from .cases import awkward, empty
from .test_columns import brute_base, brute_stats
from .test_jaccard import closure, shingles
from .test_tokens import check_packing, library

SAMPLES = {"de": "der die und nicht eine schon werden ging über haus", "en": "the and with that house would going from where thing", "fr": "le la une pas avec était maison dans être où"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(rng, lang, n):
    words = [f"{w}{rng.choice(['', 'a', 'es', 'ing', 'ent'])}" for w in rng.choices(SAMPLES[lang].split(), k=n)]
    return " ".join(w + ("." if k % 9 == 8 or k == n - 1 else "") for k, w in enumerate(words))


def table(spark):
    rng = random.Random(11)
    rows = []
    for k in range(90):
        lang = ("de", "en", "fr")[k % 3]
        rows.append([sentences(rng, lang, rng.randint(12, 80)), lang])
    rows += [[rows[k][0], rows[k][1]] for k in range(6)]  # copies
    for k in range(6, 12):  # near copies
        words = rows[k][0].split()
        words[len(words) // 2] = "changed"
        rows.append([" ".join(words), rows[k][1]])
    rows += [[None, "en"], ["", "en"], ["12 34 56 78 90, 11 12 13 14 15 16 17.", "en"], ["BUY IT NOW " * 5 + "\n" + "a | b | c | d\n" * 9, "en"]]
    rows += [[sentences(rng, "en", 30) + '\ntoken = "0123456789abcdef0123456789", that is all of it, and no more than this.', "en"], [sentences(rng, "en", 30) + "\nALL THIS IS ADVERTISING", "en"]]
    return spark.createDataFrame([(k, t, y, "s", None if t is None else len(t)) for k, (t, y) in enumerate(rows)], COLUMNS)


def stages(spark, docs, sf_dir=""):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        rows = docs.collect()
        out.append(rows)
        if len(out) < 5:
            docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    return out


def test_stages_equal_brute_force(spark):
    docs = table(spark)
    cleaned, known, single, masked, packed = stages(spark, docs)
    shout = re.compile(r"^[^a-zß-ÿ]*[A-Z][^a-zß-ÿ]*$")
    want = {}
    for r in docs.collect():
        lines = (r.text or "").split("\n")
        bad = [shout.match(x) is not None and len(x.split()) > 2 or "|" in x for x in lines]
        size = lambda x: len("".join(x.split()))
        if not brute_stats(r.text)[5] and sum(size(x) for x, b in zip(lines, bad) if b) <= 0.5 * size(r.text):
            want[r.doc_id] = "\n".join(x for x, b in zip(lines, bad) if not b)
    assert {r.doc_id: r.text for r in cleaned} == want and all(r.n_chars == len(r.text) for r in cleaned)
    model = langid.train(spark.createDataFrame([tuple(r) for r in cleaned], COLUMNS))
    judged = langid.predict(spark.createDataFrame([tuple(r) for r in cleaned], COLUMNS), model).collect()
    assert {r.doc_id for r in known} == {r.doc_id for r in judged if r.lang_pred != "und" and r.score >= 0.5} == {r.doc_id for r in cleaned if re.search("[a-z]", r.text)}
    sets = [(r.doc_id, shingles(r.text, 5)) for r in known]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x & y and 100 * len(x & y) >= 80 * len(x | y)]
    comp = closure(edges, [a for a, _ in sets])
    assert sorted(r.doc_id for r in single) == sorted(a for a in comp if comp[a] == a) and len(single) < len(known)
    for r in masked:
        old = next(x.text for x in single if x.doc_id == r.doc_id)
        new, spans = old, brute_base(old)
        merged = []
        for a, b, _ in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in reversed(merged):
            new = new[:a] + "[SECRET]" + new[b:]
        assert r.text == new
    ids, _ = library(public_tokenizers.path("word_bpe_49k.json"), [r.text for r in masked])
    check_packing(packed, [(r.doc_id, i) for r, i in zip(masked, ids)])


def test_run_on_files(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} == set(rows[0].asDict())


@pytest.mark.parametrize("make", [awkward, empty])
def test_awkward_tables_pass_through(spark, make):
    out = stages(spark, make(spark))
    assert make is awkward or not any(out)
