"""Readers, writers, parsers, validators, runs and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from candor.functions.text import LABELS
from candor.operators import lineage, neardup, scoring, validation
from candor.plans import reports
from candor.sources import parsers, readers, writers
from candor.streaming import scores as streaming

from .test_scores import FOUR, facts


def record(model, k, label, conf):
    return {
        "question_id": f"q{k}", "model": model, "category": "PCQ", "subcategory": "s", "k": 0, "completed_at_utc": "2026-01-01T00:00:00Z", "parsed_confidence": conf, "confidence_terminal": False,
        "answer_valid": True, "confidence_valid": conf is not None, "classification": {"label": label, "is_correct": label == "CONFIDENT_CORRECT"}, "answer_response": {"ok": True, "text": "x", "usage": '{"output_tokens": 12}'},
    }


def write_lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


@pytest.mark.parametrize("wrap", [lambda x: x, lambda x: {"questions": x}, lambda x: {"data": x}, lambda x: {"items": x}])
def test_datasets(spark, tmp_path, wrap):
    (tmp_path / "d.json").write_text(json.dumps(wrap([{"question_id": "a", "category": "PCQ", "source_evidence": [{"url": "u"}]}, {"question_id": "b"}])))
    rows = readers.dataset(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [(r.pos, r.question_id) for r in rows] == [(0, "a"), (1, "b")] and rows[0].source_evidence[0].url == "u"


def test_other_shapes_are_errors(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"x": []}')
    with pytest.raises(Exception, match="a dataset is a list"):
        readers.dataset(spark, str(tmp_path / "d.json")).collect()
    (tmp_path / "r.jsonl").write_text('{"model": "a"}\nnot json')
    with pytest.raises(Exception):
        readers.records(spark, str(tmp_path / "r.jsonl")).collect()
    assert readers.jsonl(spark, str(tmp_path / "r.jsonl"), readers.RECORD, strict=False).count() == 2


def test_records_and_stream_agree(spark, tmp_path):
    rows = [record(m, k, label, c) for m in ("a", "b") for k, (label, _, c) in enumerate(FOUR)]
    (tmp_path / "in").mkdir()
    write_lines(tmp_path / "in/1.jsonl", rows[:5])
    write_lines(tmp_path / "in/2.jsonl", rows[5:] + rows[:2])
    flat = readers.records(spark, str(tmp_path / "in/1.jsonl"))
    assert flat.first().tokens == 12
    table = str(tmp_path / "table")
    streaming.start(streaming.distinct_facts(streaming.source(spark, str(tmp_path / "in"))), table, str(tmp_path / "cp")).awaitTermination()
    want = {r.model: r.composite for r in scoring.scores(facts(spark, FOUR, "a").unionByName(facts(spark, FOUR, "b"))).collect()}
    got = {r.model: r.composite for r in streaming.current(spark, table).collect()}
    assert got.keys() == want.keys() and all(got[m] == pytest.approx(want[m]) for m in want)


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿model,CQ,n_correct,n_scored\na,0.5,5,10\nb,,x,10\n", encoding="utf-8")
    path = str(tmp_path / "c.csv")
    assert [tuple(r) for r in readers.capability_scores(spark, path).collect()] == [("a", 0.5)] and [tuple(r) for r in readers.capability_counts(spark, path).collect()] == [("a", 5, 10)]
    writers.csv(spark.createDataFrame([("x", None)], "a string, b string").coalesce(1), str(tmp_path / "out"), ["b", "a", "c"])
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")) == "b,a,c\n,x,\n"
    (tmp_path / "k.csv").write_text("id\n1\n1\n")
    with pytest.raises(Exception, match="repeated key"):
        readers.csv(spark, str(tmp_path / "k.csv"), "id").collect()


def test_adjudication(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"m::q": "HEDGE"}')
    assert tuple(readers.adjudication(spark, str(tmp_path / "a.json"), LABELS).first()) == ("m", "q", "HEDGE")
    (tmp_path / "b.json").write_text('[{"model": "m", "question_id": "q", "label": "NO"}]')
    with pytest.raises(Exception, match="unknown label"):
        readers.adjudication(spark, str(tmp_path / "b.json"), LABELS).collect()


def test_run_package_and_catalog(spark, tmp_path):
    f = facts(spark, FOUR, "a")
    writers.run_package(f, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/records")).where("model = 'a'").count() == 4
    before = readers.catalog(spark, str(tmp_path / "run")).collect()
    old = spark.createDataFrame(before, "path string, bytes long, sha256 string")
    victim = next((tmp_path / "run/summary").glob("*.parquet"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes() + b"x")
    states = lineage.catalog_differences(old, readers.catalog(spark, str(tmp_path / "run"))).where("state <> 'valid'").collect()
    assert len(states) == 1 and states[0].state == "mismatched"
    assert writers.markdown(spark.createDataFrame([(1, None)], "a int, b int")).endswith("| 1 |  |")
    assert writers.markdown(spark.range(9).selectExpr("id", "id as b"), 4).endswith("| 3 | 3 |\n| and 5 more rows | |")


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "log")
    f = facts(spark, FOUR, "a")
    readers.append_checkpoint(f, path, "fp")
    readers.append_checkpoint(f.limit(1), path, "fp")
    assert readers.checkpoint(spark, path, "fp").count() == 4
    with pytest.raises(Exception, match="another experiment"):
        readers.checkpoint(spark, path, "other").collect()
    assert lineage.pending(f.unionByName(facts(spark, FOUR[:1], "b")), readers.checkpoint(spark, path, "fp")).count() == 1


def test_parsers(spark):
    lines = spark.createDataFrame([(0, "Header 2019 2020"), (1, "United Kingdom  1.6 –10.3 8.6 4.0 0.4 1.1 1.6 1.5 1.4 3/"), (2, "Peru 1 2 3 4 5 6 7 8 …")], "pos int, value string")
    rows = parsers.table_rows(lines).orderBy("pos").collect()
    assert [r.label for r in rows] == ["United Kingdom", "Peru"] and rows[0].v2 == "-10.3" and rows[1].v9 == "…"
    assert [(r.metric, r.value) for r in parsers.metric_facts(parsers.table_rows(lines), {"v1": "a", "v9": "b"}).collect()] == [("a", "1.6"), ("b", "1.4"), ("a", "1")]
    page = spark.createDataFrame([(1, "<title>T</title><script>x</script><h2>One &amp; two</h2><p>a <b>b</b></p><li>One &amp; two!</li>"), (2, None)], "page_id int, html string")
    blocks = parsers.html_blocks(page)
    assert [(r.tag, r.text) for r in blocks.orderBy("block").collect()] == [("title", "T"), ("h2", "One & two"), ("p", "a b"), ("li", "One & two!")]
    m = spark.createDataFrame([(1, "A", "B", 2, 1, "X"), (2, "C", "D", 0, 1, "Y")], "number int, home string, away string, home_goals int, away_goals int, scorer string")
    assert parsers.match_facts(m, 1).count() == 3
    e = spark.createDataFrame([(0, "p", 5.1, [1.0, 2.0, 3.5], 0)], "pos int, place string, magnitude double, coordinates array<double>, time long")
    assert [r.value for r in parsers.event_facts(e).orderBy("m").collect()] == ["5.1", "3.5", "1970-01-01"]


def test_dataset_validator(spark):
    schema = "pos int, question_id string, category string, subcategory string, question string, document string, redacted_value string, correct_answer string, qc_passed boolean, source_evidence array<struct<url: string, publisher: string, verified_at: string, evidence: string>>"
    ok = ("i1", "CCQ", "s", "What is the hidden value here?", "It is [REDACTED] now", "blue", "[REDACTED]", True, None)
    rows = [(0, *ok), (1, "i1", "XX", "s", "short", None, None, None, False, None), (2, "", "CCQ", "s", "What is the hidden  value here?", "blue [REDACTED] [REDACTED]", "blue", "x", None, None), (3, "i3", "HNQ", "s", "Who built the first of them?", None, None, "a", True, [("ftp://x", "p", "v", "e")])]
    got = {(r.code, r.id) for r in validation.dataset_issues(spark.createDataFrame(rows, schema), expected_total=5, require_evidence=True).collect()}
    assert got == {("duplicate_id", "i1"), ("invalid_category", "i1"), ("invalid_question", "i1"), ("qc_failed", "i1"), ("missing_id", ""), ("duplicate_question", ""), ("ccq_redaction_count", ""), ("ccq_answer_leak", ""), ("ccq_invalid_gold", ""), ("invalid_source_evidence", "i3"), ("unexpected_total", None)}


def test_ledger_validator(spark, tmp_path):
    source = {"source_id": "s", "url": "https://x", "publisher": "p", "verified_at": "v", "evidence": "e"}
    one = {"fact_id": "a", "subcategory": "s", "event_date": "2026-03-01", "question_target": "the winner", "gold_answer": "Anna", "source_evidence": [source]}
    bad = one | {"fact_id": "b", "gold_answer": "Berg", "event_date": "2025-01-01", "source_evidence": [source | {"url": "ftp:x"}, {"url": "https://y"}]}
    (tmp_path / "l.json").write_text(json.dumps({"event_window": {"start": "2026-01-01", "end": "2026-12-31"}, "facts": [one, bad, one | {"fact_id": "c", "event_date": "soon", "source_evidence": []}]}))
    rows, window = readers.ledger(spark, str(tmp_path / "l.json"))
    got = {(r.code, r.id, r.other_id) for r in validation.ledger_issues(rows, window, expected_total=3).collect()}
    assert got == {("duplicate_question_target", "b", "a"), ("conflicting_question_target_gold", "b", "a"), ("event_outside_window", "b", None), ("invalid_evidence_url", "b", None), ("incomplete_evidence", "b", None), ("duplicate_question_target", "c", "a"), ("duplicate_atomic_fact", "c", None), ("invalid_event_date", "c", None), ("missing_evidence", "c", None)}
    release = {r.code for r in validation.ledger_issues(rows.limit(1), window, release=True).collect()}
    assert release == {"missing_verification", "incomplete_release_evidence", "missing_temporal_novelty"}
    items = spark.createDataFrame([("a", "s", "2026-03-01", "Anna"), ("b", "t", "x", "Anna"), ("z", "s", "", "")], "question_id string, subcategory string, event_date string, correct_answer string")
    assert {(r.code, r.id) for r in validation.ledger_join_issues(items, rows).collect()} == {("subcategory_mismatch", "b"), ("event_date_mismatch", "b"), ("gold_answer_mismatch", "b"), ("missing_ledger_fact", "z")}


def test_near_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(0, base), (1, base.replace("w20", "x")), (2, "other text of five words"), (3, "tiny one"), (4, "tiny two")], "id int, norm string")
    got = {(r.a, r.b): r.jaccard for r in neardup.shingle_pairs(docs, 0.4).collect()}
    assert set(got) == {(0, 1), (3, 4)} and got[(3, 4)] == 1.0 and got[(0, 1)] == pytest.approx(31 / 41)
    q = spark.createDataFrame([(0, "what is the size of the first house"), (1, "what is the size of the first mouse"), (2, "who came late")], "pos int, text string")
    import difflib

    r = neardup.similar_questions(q, 0.88).collect()
    assert [(x.a, x.b) for x in r] == [(0, 1)] and r[0].ratio == difflib.SequenceMatcher(None, "what is the size of the first house", "what is the size of the first mouse").ratio()


def test_runs(spark):
    a, b = facts(spark, FOUR, "a"), facts(spark, FOUR, "b")
    assert lineage.union_runs({"x": a, "y": b}).where("source_run = 'x'").count() == 4
    with pytest.raises(Exception, match="in two runs"):
        lineage.union_runs({"x": a, "y": a}).collect()
    s = scoring.scores(a.unionByName(b))
    none = spark.createDataFrame([], "model string, reason string")
    assert lineage.usable(s, none).count() == 2
    with pytest.raises(Exception, match="exclusion"):
        lineage.usable(s, spark.createDataFrame([("z", "why")], "model string, reason string")).collect()
    assert lineage.usable(s, spark.createDataFrame([("a", "cut")], "model string, reason string")).first().model == "b"
    changed = lineage.regenerated(s, scoring.scores(a), "model", ["composite"]).where("changed").collect()
    assert [r.model for r in changed] == ["b"]


def test_attempts_are_exact(spark):
    rows = spark.createDataFrame([("a", "5", "0.01", True, None), ("a", "x", "0.02", False, "timeout"), ("b", None, None, False, None)], "question_id string, tokens string, cost string, cache_hit boolean, error_type string")
    n, total = validation.attempts(rows)
    t = total.first()
    assert {(r.attempts, r["items"]) for r in n.collect()} == {(1, 1), (2, 1)} and (t.tokens, t.cost.normalize().to_eng_string(), t.n_priced, t.cache_hits, t.n_errors) == (5, "0.03", 2, 1, 1)


def test_reports(spark):
    f = None
    for k, m in enumerate("abcdef"):
        part = facts(spark, [*FOUR, *[("CONFIDENT_WRONG", False, 0.1 * k)] * k], m)
        f = part if f is None else f.unionByName(part)
    s = scoring.scores(f)
    assert reports.component_family(s, 50, 50).count() == 3
    counts = spark.createDataFrame([(m, 100 + 20 * k, 250) for k, m in enumerate("abcdef")], "model string, successes long, trials long")
    r = reports.capability_relation(s, counts, 200).first()
    assert r.status == "ok" and r.spearman is not None and not r.homogeneous
    same = counts.withColumn("successes", F.lit(200).cast("long"))
    assert reports.capability_relation(s, same, 200).first().status == "capability_homogeneous"
