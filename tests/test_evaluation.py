"""Records from replies, spans, provider bodies, review gates, routes and corpus gates."""

import difflib
import json

import pytest
from pyspark.sql import functions as F

from candor.functions import text as T
from candor.operators import evaluation, neardup, scoring
from candor.sources import readers

GRID = "model string, question_id string, category string, subcategory string, k int, correct_answer string, acceptable_answers array<string>"
REPLIES = "model string, question_id string, answer_ok boolean, answer string, confidence_ok boolean, reply string, error_type string"


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_evaluate(spark):
    grid = spark.createDataFrame([("m", f"q{k}", "PCQ", "s", 0, "Ferran Torres", ["Torres"]) for k in range(5)], GRID)
    replies = spark.createDataFrame(
        [("m", "q0", True, "The winning scorer was Ferran Torres.", True, "90", None), ("m", "q1", True, "It was Rodri.", True, "about 80 or 90", None), ("m", "q2", False, None, None, None, "timeout"), ("m", "q3", True, "I do not know.", False, None, "response_format")], REPLIES
    )
    adj = spark.createDataFrame([("m", "q1", "HEDGE")], "model string, question_id string, label string")
    got = {r.question_id: r for r in evaluation.evaluate(grid, replies, adjudication=adj).collect()}
    assert (got["q0"].label, got["q0"].confidence, got["q0"].rated) == ("CONFIDENT_CORRECT", 0.9, True)
    assert (got["q1"].label, got["q1"].is_correct, got["q1"].rated, got["q1"].terminal) == ("HEDGE", False, False, True)
    assert (got["q2"].answered, got["q2"].label, got["q2"].terminal) == (False, None, False) and got["q4"].answered is False
    assert (got["q3"].label, got["q3"].terminal) == ("ABSTAIN", True)
    offline = evaluation.evaluate(grid, evaluation.offline_replies(grid))
    assert scoring.scores(offline).first().restraint_rate == 1.0
    items = grid.select("question_id", "correct_answer", "acceptable_answers")
    again = evaluation.reclassify(offline, items)
    assert again.columns == offline.columns and again.where("label = 'ABSTAIN'").count() == 5
    with pytest.raises(Exception, match="no item"):
        evaluation.reclassify(offline, items.limit(1)).collect()


def test_probe(spark):
    rows = [(0, "CCQ", "What is it?", "The [REDACTED] sea", "black"), (1, "CCQ", "What?", "[REDACTED] [REDACTED]", "x"), (2, "CCQ", "What?", "A [REDACTED]", "one two three four five"), (3, "CCQ", "Is it black?", "The [REDACTED] sea", "Black"), (4, "HNQ", "", "", "")]
    got = {r.pos: (r.skip_reason, r.restored) for r in evaluation.probe_items(spark.createDataFrame(rows, "pos int, category string, question string, document string, redacted_value string")).collect()}
    assert got == {0: (None, "The black sea"), 1: ("redaction_not_unique", None), 2: ("span_not_crisp", None), 3: ("answer_leaks_into_question", None)}
    probe = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, False)], "model string, scored boolean, is_correct boolean")
    r = evaluation.capability_scores(probe).first()
    assert (r.n_items, r.n_scored, r.n_correct, r.n_technical_failures, r.capability_score) == (3, 2, 1, 1, 0.5)


def test_provider_bodies(spark):
    bodies = [
        ({"output_text": "a"}, "a"),
        ({"output": [{"content": [{"type": "output_text", "text": "a"}, {"type": "x", "text": "no"}]}, {"content": [{"type": "output_text", "text": "b"}]}]}, "ab"),
        ({"choices": [{"message": {"content": "c"}}]}, "c"),
        ({"choices": [{"message": {"content": [{"text": "d"}, {"text": "e"}]}}]}, "de"),
        ({"choices": []}, None),
        ({"output_text": " "}, None),
    ]
    for body, want in bodies:
        assert one(spark, T.response_text(F.lit(json.dumps(body)))) == want
    assert one(spark, T.reasoning_tokens(F.lit('{"a": {"reasoning_tokens": 5}, "b": [{"Thinking_Tokens": 7}], "thinking": "no"}'))) == 7
    assert one(spark, T.reasoning_tokens(F.lit("{}"))) is None
    assert one(spark, T.reasoning_tokens(F.lit('{"say": "\\"thinking\\": 9", "thinking": {"thinking": true, "x": [[{"THINKING": 2.7}]]}}'))) == 2
    assert one(spark, T.reasoning_tokens(F.lit("thinking: no JSON"))) is None


def test_review_gates(spark):
    def pending(status, **checks):
        m = F.create_map(*[F.lit(x) for k, v in checks.items() for x in (k, json.dumps(v))]) if checks else F.create_map().cast("map<string,string>")
        return one(spark, T.pending_review(F.lit(status), m))

    ok = {"passed": False, "status": "mandatory_review_pending"}
    assert pending("candidate_requires_human_review", human_source_review=ok, other={"passed": True})
    assert not pending("release_ready", human_source_review=ok) and not pending("candidate_requires_human_review", human_source_review=ok, other={"passed": False})
    assert not pending("candidate_requires_human_review", other={"passed": True})
    first, second = json.dumps({"passed": True, "status": "completed", "reviewer_name": "n"}), json.dumps({"passed": True, "status": "completed", "review_protocol_version": "1", "sample_member": True})
    issues = lambda p, s, c="PCQ": one(spark, T.review_issues(F.lit(c), F.lit("release_ready"), F.lit(p), F.lit(s)))
    assert issues(first, second) == ["release_secondary_sample_attestation_incomplete"] and issues("{}", "{}") == ["release_primary_review_missing", "release_secondary_review_missing"] and issues("{}", "{}", "FEQ") == []


def test_routes(spark):
    def env(route, usage="{}"):
        return {"ok": True, "requested_model": "r", "resolved_model": route, "usage": usage}

    rows = [{"model": m, "question_id": str(k), "answer_valid": True, "confidence_valid": True, "answer_response": env(r, u), "confidence_response": env(r, u)} for m, r, u in (("good", "r", "{}"), ("moved", "s", "{}"), ("thinks", "r", '{"reasoning_tokens": 3}')) for k in range(3)]
    rec = spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", readers.RECORD).alias("r")).select("r.*")
    got = {r.model: (r.verified, r.failures) for r in evaluation.route_assessment(rec).collect()}
    assert got == {"good": (True, []), "moved": (False, ["route_not_exact"]), "thinks": (False, ["reasoning_tokens_reported"])}


def test_corpus_gates(spark):
    item = "pos int, question_id string, category string, subcategory string, question string, document string, redacted_value string, correct_answer string, qc_passed boolean, source_evidence array<struct<url: string, publisher: string, verified_at: string, evidence: string>>"
    docs = ["the first of many rivers runs [REDACTED] to the sea in the north", "a house stood [REDACTED] by the old road for a hundred years or more", "nobody knew why [REDACTED] the lamp went out before the guests had left"]
    asks = ["Where does the river run to in the end?", "Which colour had that house by the road?", "Why did nobody light another lamp that night?"]
    rows = [(k, f"i{k}", "CCQ", "s", q, d, f"v{k}", "[REDACTED]", True, None) for k, (q, d) in enumerate(zip(asks, docs))]
    good = evaluation.corpus_audit(spark.createDataFrame(rows, item), per_subcategory=3).first()
    assert good.passed and good.n_items == 3
    twin = (3, "i3", "CCQ", "s", asks[0] + "?", docs[0] + " coast", "v0", "[REDACTED]", True, None)
    bad = evaluation.corpus_audit(spark.createDataFrame([*rows, twin], item)).first()
    assert not bad.passed and (bad.n_near_documents, bad.n_near_questions, bad.n_repeated_values) == (1, 1, 1)


def test_edited_documents_are_near(spark):
    words = "river stone lamp house road north winter garden bridge letter window market silver morning forest island paper thunder village clock candle harbour meadow tower bell".split()
    edited = [w[:-1] + "z" if k in (6, 12, 18) else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(edited)), (2, " ".join(reversed(words)))], "id int, norm string")
    got = [(r.a, r.b, r.jaccard < 0.4, r.ratio) for r in neardup.document_pairs(docs).collect()]
    assert [g[:3] for g in got] == [(0, 1, True)] and got[0][3] == difflib.SequenceMatcher(None, " ".join(words), " ".join(edited)).ratio() >= 0.82
    assert neardup.shingle_pairs(docs, 0.4).count() == 0 and neardup.document_pairs(docs, 1.0).count() == 0
    item = "pos int, question_id string, category string, subcategory string, question string, document string, redacted_value string, correct_answer string, qc_passed boolean, source_evidence array<struct<url: string, publisher: string, verified_at: string, evidence: string>>"
    rows = [(k, f"i{k}", "CCQ", "s", q, "[REDACTED] " + " ".join(d), f"v{k}", "[REDACTED]", True, None) for k, (q, d) in enumerate([("Which colour had that house by the road?", words), ("Why did nobody light another lamp that night?", edited)])]
    r = evaluation.corpus_audit(spark.createDataFrame(rows, item)).first()
    assert r.n_near_documents == 1 and not r.passed


def test_documents_in_other_scripts_are_told_apart(spark):
    item = "pos int, question_id string, category string, subcategory string, question string, document string, redacted_value string, correct_answer string, qc_passed boolean, source_evidence array<struct<url: string, publisher: string, verified_at: string, evidence: string>>"
    docs = ["река течёт [REDACTED] через город и старый мост к морю", "в доме горела [REDACTED] лампа пока гости не ушли домой"]
    rows = [(k, f"i{k}", "CCQ", "s", q, d, f"v{k}", "[REDACTED]", True, None) for k, (q, d) in enumerate(zip(["Куда течёт эта река в конце?", "Почему никто не зажёг другую лампу?"], docs))]
    r = evaluation.corpus_audit(spark.createDataFrame(rows, item)).first()
    assert (r.n_near_documents, r.n_near_questions) == (0, 0) and r.passed


def test_small_audits(spark):
    u = evaluation.uncertainty_agreement(spark.createDataFrame([("1", "1"), ("0", "1"), (None, "0"), ("0", "0")], "a string, b string")).first()
    assert (u.a_completed, u.either, u["both"], u.n_paired) == (3, 2, 1, 3) and u.observed == pytest.approx(2 / 3)
    v = evaluation.obscurity_screen(spark.createDataFrame([("s", "q", c) for c in (True, False, False)], "subcategory string, question_id string, correct boolean")).first()
    assert v.accepted and v.unknown_rate == 1.0
    legacy = spark.createDataFrame([(0, "q", "feq", None, " What? ", None, "http://x")], "pos int, question_id string, category string, subcategory string, question string, correct_answer string, answer_source string")
    r = evaluation.canonical_items(legacy).first()
    assert (r.category, r.subcategory, r.question, r.correct_answer, r.source_evidence[0].url) == ("FEQ", "FEQ", "What?", "[DOES_NOT_EXIST]", "http://x")
    assert evaluation.prompts(spark.createDataFrame([("CCQ", "d", "q"), ("HNQ", None, "q")], "category string, document string, question string")).where("prompt = 'q'").count() == 1
