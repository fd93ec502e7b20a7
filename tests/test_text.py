"""Text rules on literal cases."""

import pytest
from pyspark.sql import functions as F

from candor.functions import text as T


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in rows.orderBy("k").select(expr(F.col("x")).alias("y")).collect()]


@pytest.mark.parametrize(
    "text, label",
    [
        ("I do not know.", "ABSTAIN"),
        ("I don't have reliable, verified information on this.", "ABSTAIN"),
        ("The document does not state the price.", "ABSTAIN"),
        ("The value is [REDACTED].", "ABSTAIN"),
        ("It happened in May 2026.", "HEDGE"),
        ("Perhaps it was Rodri.", "HEDGE"),
        ("I do not know. The answer is 42 or so.", "HEDGE"),
        ("I cannot verify this. It was led by Anna Berg then.", "HEDGE"),
        ("It was Ferran Torres.", "CONFIDENT_CORRECT"),
        ("It was Rodri.", "CONFIDENT_WRONG"),
    ],
)
def test_labels(spark, text, label):
    rows = spark.createDataFrame([(text,)], "x string")
    correct = T.matches_gold(F.lit("PCQ"), F.col("x"), F.array(F.lit("Ferran Torres"), F.lit("Torres")))
    got = rows.select(T.classification(F.col("x"), correct).alias("c")).first().c
    assert got.label == label == got.automated_label
    human = rows.select(T.classification(F.col("x"), correct, F.lit("HEDGE")).alias("c")).first().c
    assert human.label == "HEDGE" and human.is_correct == got.is_correct and human.reasons[-1] == "human_adjudication_override"


def test_blank_answers_are_errors(spark):
    rows = spark.createDataFrame([("  ",)], "x string")
    with pytest.raises(Exception, match="technical failure"):
        rows.select(T.classification(F.col("x"), F.lit(False))).collect()
    with pytest.raises(Exception, match="unknown label"):
        rows.select(T.is_restraint(F.lit("MAYBE"))).collect()


def test_confidence(spark):
    good = {"0": 0, "73": 0.73, "100%": 1, "Confidence: 80": 0.8, "I'd say around 85%.": 0.85, " 7 % ": 0.07}
    bad = {"8/10": "multiple_numeric_tokens", "between 70 and 80": "multiple_numeric_tokens", "the 85th percentile": "non_standalone_numeric_token", "0.85": "non_integer_numeric_token", "101": "out_of_range", "-1": "non_integer_numeric_token", "": "empty", None: "empty", "none": "no_numeric_token", "Confidence: 80.": "non_standalone_numeric_token"}
    values = [*good, *bad]
    got = column(spark, values, T.confidence)
    assert [round(g.value, 9) for g in got[: len(good)]] == list(good.values()) and not any(g.reason for g in got[: len(good)])
    assert [g.reason for g in got[len(good) :]] == list(bad.values()) and not any(g.value or g.strategy for g in got[len(good) :])
    assert [g.strategy for g in got[:3]] == ["exact_integer", "exact_integer", "exact_percent"]


def test_normalised_text(spark):
    assert T.normalised("İstanbul—Türkiye") == "istanbul turkiye"
    assert column(spark, ["İstanbul—Türkiye", "Straße", None], T.normalise) == ["istanbul turkiye", "strasse", None]
    assert column(spark, ["A-b  c_d!"], T.normalise_ascii) == ["a b c_d"]


@pytest.mark.parametrize("response, gold, tolerance, want", [("100", "100.0", 0.0, True), ("104", "100.0", 0.0, False), ("104", "100.0", 0.05, True), ("it was 1.234", "1,234", 0.0, True), ("on 2026-07-15", "2026", 0.0, True), ("no", "12 or 13", 0.0, False)])
def test_numbers(spark, response, gold, tolerance, want):
    assert spark.range(1).select(T.matches_gold(F.lit("HNQ"), F.lit(response), F.array(F.lit(gold)), tolerance)).first()[0] is want


def test_gold_answers(spark):
    row = spark.sql("select ' a ' as c, array('b', 'a', '') as x, array('z') as y")
    assert row.select(T.gold_answers(F.col("c"), F.col("x"), F.col("y"))).first()[0] == ["a", "b"]
    assert row.select(T.gold_answers(F.lit(None).cast("string"), F.array().cast("array<string>"), F.col("y"))).first()[0] == ["z"]
    assert row.select(T.matches_gold(F.lit("CCQ"), F.lit("a"), F.array(F.lit("a")))).first()[0] is False


def test_truncation(spark):
    cut = ["The first of the numbers was assigned to", "The exhibition of the works opened on", "The name of the new company is", "It was opened by them on March 22,", "The code that they gave is 'US202612"]
    whole = ["The institute was founded in the year 1967", "It was Graham's own idea from the start.", "Short of", "They said (as always) that it was late."]
    assert [r.suspected for r in column(spark, cut, lambda c: T.truncation(c, F.lit(5), 10))] == [True] * 5
    assert [r.suspected for r in column(spark, whole, lambda c: T.truncation(c, F.lit(5), 10))] == [False] * 4
    assert column(spark, ["x"], lambda c: T.truncation(c, F.lit(10), 10))[0].token_limit


def test_question_and_answer_form(spark):
    q = {"What is the size of it?": [], "Tell me the size?": ["not_interrogative"], "Name the size.": [], "What? Why?": ["invalid_question_mark_count"], "What was who in the end?": ["nested_interrogative_template"]}
    assert column(spark, list(q), T.question_issues) == list(q.values())
    a = {"": ["missing_gold_answer"], "since its founding": ["self_referential_duration_answer"], "N/A": ["nonanswer_gold"], "river": ["gold_answer_leaked_in_question"], "42": []}
    assert column(spark, list(a), lambda c: T.answer_issues(F.lit("Which river is it?"), c)) == list(a.values())


def test_small_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.identity(F.lit("GPT-4 o!"))) == "gpt4o" and one(T.file_name(F.lit("..a b/c.-"))) == "a-b-c"
    assert one(T.first_prefix(F.lit("Gemma-7b"), [("gem", "first"), ("gemma", "second")])) == "first"
    assert one(T.fixed(F.lit(0.12345))) == "0.123" and one(T.fixed(F.lit(None).cast("double"))) == "" and one(T.p_value(F.lit(0.00001))) == "< 0.0001"
    assert one(T.knowability(F.lit("PCQ"), F.lit(False), F.lit(0), F.lit(0))) == 1 and one(T.knowability(F.lit("HNQ"), F.lit(False), F.lit(None).cast("int"), F.lit(1))) == 1
    assert one(T.interval(F.lit("2026-01-02/2026-01-01"))) is None and one(T.interval(F.lit("2026-01-02")))["end"].day == 2


def test_temporal_novelty(spark):
    full = dict(status="human-verified-post-cutoff", basis="official_result", claim_became_true_at="2026-03-01/2026-03-05", source_id="s", reviewer_type="r", verified_at="v", evidence="e")
    window = (F.lit("2026-01-01").cast("date"), F.lit("2026-12-31").cast("date"))

    def issues(event="2026-03-04", **change):
        n = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in (full | change).items()])
        return spark.range(1).select(T.novelty_issues(n, F.lit(event), F.array(F.lit("s")), window, True)).first()[0]

    assert issues() == []
    assert issues(status="source-verified-post-cutoff") == ["temporal_novelty_human_review_required"] and issues(status="x") == ["invalid_temporal_novelty_status"]
    assert issues(evidence="") == ["incomplete_temporal_novelty"] and issues(basis="rumour") == ["invalid_temporal_novelty_basis"]
    assert issues(claim_became_true_at="soon") == ["invalid_temporal_novelty_date"] and issues(event="2026-04-01") == ["temporal_novelty_event_date_mismatch"]
    assert issues(claim_became_true_at="2025-12-31/2026-03-05") == ["temporal_novelty_outside_window"] and issues(source_id="t") == ["temporal_novelty_source_mismatch"]
    assert spark.range(1).select(T.novelty_issues(F.lit(None).cast("struct<" + ", ".join(f"{k}: string" for k in full) + ">"), F.lit(""), F.array(F.lit("s")))).first()[0] == ["missing_temporal_novelty"]


def test_gold_and_gates_fold_accents(spark):
    def gold(response, *answers):
        return spark.range(1).select(T.matches_gold(F.lit("HNQ"), F.lit(response), F.array(*map(F.lit, answers)))).first()[0]

    assert gold("It was Muller.", "Müller") and gold("Es war MÜLLER!", "x", "Muller") and gold("в Москве", "Москве") and gold("Hauptstraße 5", "STRASSE", "hauptstrasse")
    assert not gold("Москва", "Берлин") and not gold("日本", "中国") and not gold("M ller", "Müller") and gold("about 7,0", "7.0")
    assert spark.range(1).select(T.answer_issues(F.lit("Who was Müller?"), F.lit("Muller"))).first()[0] == ["gold_answer_leaked_in_question"]
    assert spark.range(1).select(T.answer_issues(F.lit("Where is it?"), F.lit("Москва"))).first()[0] == []


def test_cues_are_tried_where_they_can_match(spark):
    """The words that a cue needs never keep it from matching: against the plain alternation, on texts made of cues' parts."""
    import itertools
    import random

    rng = random.Random(5)
    parts = ["I don't know", "I do not have any", "verified ", "evidence", "I CANNOT", "can't", " tell", "I lack", " enough ", "context", "not enough", "Insufficient", " information", "the answer was", " redacted", "unavailable", "no reliable way", "cannot be inferred", "There is no way to infer", "this passage doesn't explicitly ", "state", "isn't mentioned in the", "was not disclosed", "the price is not available", "[Omitted]", "the name was not stated", "purchase price is not", " provided", "UNKNOWN", "unſnown", "inſufficient evidence", "İ am not sure", "I'm not sure", "perhapſ", "possibly", "may", "maybe", "mighty", "might", "I suspect", "it could be", "appears to", "ſeems to", "as far as I know", "to the best of my knowledge", "it is", ".", " ", "?", "Anna Berg", "7", "Kelvin"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(1, 6))) for _ in range(3000)] + parts + [a + " " + b for a, b in itertools.islice(itertools.product(parts, parts), 1500)]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    t = F.col("t")
    sentence = lambda s: ~s.rlike(T.any_of(T.ABSTENTION_CUES)) & (T.word_count(s) >= 3) & (s.rlike(T.any_of([T.ANSWER_CUE])) | s.rlike(T.NAME_CUE))
    plain = (t.rlike(T.any_of(T.ABSTENTION_CUES)), t.rlike(T.any_of(T.HEDGE_CUES)), F.exists(F.split(t, r"(?U)(?<=[.!?])\s+"), sentence))
    own = (T.abstains(t), T.hedges(t), T.substantive(t))
    assert rows.where(~F.array(*plain).eqNullSafe(F.array(*own))).collect() == []
    assert all(rows.where(p).count() > 50 for p in plain)
