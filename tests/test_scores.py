"""Scores, ranks, statistics and agreement on literal cases and invariants."""

import math
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candor.operators import agreement, ranking, resample, scoring, sensitivity, stats

FACTS = "model string, question_id string, category string, subcategory string, k int, answered boolean, rated boolean, terminal boolean, confidence double, label string, is_correct boolean"
FOUR = [("ABSTAIN", False, 0.0), ("HEDGE", False, 0.2), ("CONFIDENT_CORRECT", True, 0.9), ("CONFIDENT_WRONG", False, 0.8)]


def facts(spark, rows, model="m"):
    return spark.createDataFrame([(model, f"q{k}", "PCQ", "s", 0, True, c is not None, c is None, c, label, ok) for k, (label, ok, c) in enumerate(rows)], FACTS)


def score(spark, rows):
    return scoring.scores(facts(spark, rows)).first()


def test_four_records(spark):
    s = score(spark, FOUR)
    assert (s.restraint_rate, s.error_avoidance, s.n_confidence, s.n_calibration) == (0.5, 0.75, 4, 2)
    assert s.calibration == pytest.approx(0.55) and s.composite == pytest.approx(0.30 * 0.5 + 0.45 * 0.75 + 0.25 * 0.55)


def test_restraint_does_not_change_calibration(spark):
    assert score(spark, [*FOUR, ("ABSTAIN", False, 0.95), ("HEDGE", False, 0.05)]).calibration == pytest.approx(0.55)


def test_undefined_stays_null(spark):
    s = score(spark, [("ABSTAIN", False, 0.1), ("HEDGE", False, 0.2)])
    assert (s.restraint_rate, s.error_avoidance, s.n_calibration, s.calibration, s.composite) == (1.0, 1.0, 0, None, None)
    s = score(spark, [("ABSTAIN", False, None), ("CONFIDENT_WRONG", False, 0.8)])
    assert (s.n_missing_confidence, s.confidence_coverage, s.n_terminal_missing, s.n_retryable) == (1, 0.5, 1, 0)
    failed = spark.createDataFrame([("m", "q", "PCQ", "s", None, None, None, None, None, None, None)], FACTS)
    s = scoring.scores(failed).first()
    assert (s.n_input, s.n_scorable, s.technical_failures, s.n_retryable, s.restraint_rate, s.composite) == (1, 0, 1, 1, None, None)


def test_bins_and_odd_confidences(spark):
    values = [0.0, 0.58, 0.29, 0.7, 1.0, 1.5, -0.1, 0.1 + 0.2]
    for n in (10, 50, 90, 100):
        got = [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, c double").orderBy("k").select(scoring.bin_of(F.col("c"), n)).collect()]
        want = [next((b for b in range(n) if b / n <= v < (b + 1) / n or b == n - 1 and v == 1), -1) for v in values]
        assert got == want
    s = score(spark, [("CONFIDENT_WRONG", False, 0.5), ("CONFIDENT_WRONG", False, 1.5)])
    assert s.n_calibration == 2 and s.ece == pytest.approx(0.25)


def random_facts(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        cat = rng.choice(["FEQ", "PCQ", "HNQ", "CCQ"])
        label = rng.choice(["ABSTAIN", "HEDGE", "CONFIDENT_WRONG"] + ["CONFIDENT_CORRECT"] * (cat in ("PCQ", "HNQ")))
        rows.append((f"m{k % 5}", f"q{k // 5}", cat, f"{cat}{k % 3}", int(rng.random() < 0.05), rng.random() > 0.1, True, False, round(rng.random(), 2), label, label == "CONFIDENT_CORRECT"))
    return spark.createDataFrame(rows, FACTS)


def test_invariants(spark):
    f = random_facts(spark)
    plain = {r.model: r for r in scoring.scores(f).collect()}
    for r in plain.values():
        assert r.error_avoidance - r.restraint_rate == pytest.approx(r.n_confident_correct / r.n_scorable)
    again = {r.model: r for r in scoring.scores(f.repartition(7).orderBy(F.rand(3))).collect()}
    assert all(math.isclose(plain[m].composite, again[m].composite) for m in plain)
    grouped = scoring.grouped_scores(f).collect()
    for m in plain:
        for level in ("category", "subcategory", "model"):
            assert sum(r.n_scorable for r in grouped if r.model == m and r.level == level) == plain[m].n_scorable
        assert next(r for r in grouped if r.model == m and r.level == "model").composite == pytest.approx(plain[m].composite)
    for r in scoring.scores(f, ["model", "category"]).where("category in ('FEQ', 'CCQ')").collect():
        mean = f.where((F.col("model") == r.model) & (F.col("category") == r.category) & scoring.substantive()).agg(F.avg("confidence")).first()[0]
        assert r.calibration == pytest.approx(1 - mean)
    official = {r.model: r.composite for r in sensitivity.scope_scores(f).where("scenario = 'official'").collect()}
    assert all(official[m] == pytest.approx(plain[m].composite) for m in plain)


def test_ranks(spark):
    rows = spark.createDataFrame([("a", 0.5), ("b", 0.7), ("c", 0.7), ("d", None)], "model string, composite double")
    got = {r.model: (r.rank, r.place) for r in ranking.summary_order(rows).collect()}
    assert got == {"b": (1.5, 1), "c": (1.5, 2), "a": (3.0, 3), "d": (None, 4)}


def test_holm(spark):
    rows = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    assert {r.name: round(r.p_adjusted, 9) for r in ranking.holm(rows, ["family"]).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_selection_ignores_order(spark):
    items = [(f"q{c}{s}{k}", c.lower(), s) for c in ("FEQ", "PCQ", "HNQ", "CCQ") for s in ("", "s") for k in range(10)]
    frame = lambda rows: spark.createDataFrame(rows, "question_id string, category string, subcategory string")
    pick = lambda rows, *a: [(r.question_id, r.category, r.subcategory) for r in ranking.select_items(frame(rows), *a).collect()]
    a, b = pick(items, 16), pick(random.Random(1).sample(items, len(items)), 16)
    assert a == b and len(a) == 16 and all([x[1:] for x in a].count(v) == 2 for v in {x[1:] for x in a})
    assert [x[1:] for x in a] == sorted((x[1:] for x in a), key=lambda v: (v[0].upper() + "::" + (v[1] or "UNSPECIFIED")))
    # as the rule says: by hash within a stratum
    own = sorted((x[0] for x in items if x[1:] == ("feq", "")), key=lambda i: hashlib.sha256(f"42\0FEQ::UNSPECIFIED\0{i}".encode()).hexdigest())
    assert {x[0] for x in a if x[1:] == ("feq", "")} == set(own[:2])
    assert len(pick(items)) == len(pick(items, 500)) == 80 and {x[1] for x in pick(items, 9, ["hnq"])} == {"hnq"}
    for bad in ((0, None), (5, ["other"])):
        with pytest.raises(ValueError):
            ranking.select_items(frame(items), *bad)
    m = ranking.selection_manifest(ranking.select_items(frame(items), 16)).first()
    assert m.n_selected == 16 and m.category_counts == {c: 4 for c in ("FEQ", "PCQ", "HNQ", "CCQ")} and m.stratum_counts["FEQ::UNSPECIFIED"] == 2
    assert m.question_ids_sha256 == hashlib.sha256(("[" + ",".join(f'"{x[0]}"' for x in a) + "]").encode()).hexdigest()


def test_exclusions_name_what_they_leave_out(spark):
    schema = "model string, question_id string, category string, subcategory string, k int, answered boolean, rated boolean, terminal boolean, confidence double, label string, is_correct boolean, answer_error string, confidence_error string, parse_reason string, exclusion_reason string"
    rows = [
        ("m", "1", "FEQ", "a", 0, True, True, False, 0.5, "ABSTAIN", False, None, None, None, None),
        ("m", "2", "FEQ", "a", 1, True, False, True, None, "HEDGE", False, None, "late", "empty", "r"),
        ("m", "3", "HNQ", "b", 0, True, False, False, None, "HEDGE", False, None, "late", None, None),
        ("m", "4", "HNQ", "b", 0, False, True, False, 0.4, None, None, None, "late", None, None),
        ("m", "5", "HNQ", "b", 0, False, False, False, None, None, None, None, None, None, None),
        ("m", "6", "HNQ", "b", 1, True, True, False, 0.4, "CONFIDENT_WRONG", False, None, None, None, None),
    ]
    facts = spark.createDataFrame(rows, schema)
    got = {r.question_id: (r.excluded_from, r.reason, r.detail, r.exclusion_reason_recorded) for r in scoring.exclusions(facts).collect()}
    every = "restraint, avoidance, calibration"
    assert got == {
        "2": ("calibration", "terminal_missing_confidence", "empty", "r"), "3": ("calibration", "missing_confidence", "late", None),
        "4": (every, "technical_failure", "late", None), "5": (every, "technical_failure", "invalid_record", None),
    }
    c = scoring.coverage(facts).first()
    assert (c.n_items, c.n_scored, c.n_confidence, c.n_calibration, c.n_excluded, c.n_excluded_calibration_only) == (6, 4, 3, 1, 2, 2)


def test_correlations(spark):
    rows = spark.createDataFrame([(f"m{k}", float(x), float(y), 2.0 * x, 1.0) for k, (x, y) in enumerate(zip((1, 2, 3, 4), (10, 30, 20, 40)))], "model string, x double, y double, z double, c double")
    c = stats.correlations(rows, "x", "y").first()
    assert c.spearman == pytest.approx(0.8) and stats.correlations(rows, "x", "z").first().pearson == pytest.approx(1.0)
    assert stats.correlations(rows, "x", "c").first()[1:] == (None, None, "constant_input")
    method, n, p = resample.permutation_p([1, 2, 3, 4], [2, 4, 6, 8], "pearson", 10, 1)
    assert (method, n, p) == ("exact", 24, pytest.approx(2 / 24))
    low, high = resample.bootstrap_interval([1, 2, 3, 4, 5], [2, 1, 4, 3, 6], "pearson", 300, 5)
    assert (low, high) == resample.bootstrap_interval([1, 2, 3, 4, 5], [2, 1, 4, 3, 6], "pearson", 300, 5) and low <= high


def test_paired(spark):
    one = stats.paired(spark.createDataFrame([(0.432, 0.4338)], "old double, new double")).first()
    assert one.status == "insufficient_pairs" and one.cohens_dz is None and one.p_value is None
    up = stats.paired(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (1.0, 1.0)], "old double, new double")).first()
    assert (up.n_pairs, up.n_up, up.n_down, up.n_unchanged, up.n_permutations, up.n_extreme, up.p_value) == (4, 3, 0, 1, 8, 2, 0.25)
    assert (up.old_mean, up.new_mean) == (0.25, 1.75)
    none = stats.paired(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "old double, new double")).first()
    assert (none.status, none.cohens_dz, none.p_value) == ("zero_difference_variance", None, 1.0)
    many = stats.paired(spark.createDataFrame([(0.0, 1.0)] * 25, "old double, new double")).first()
    assert (many.n_extreme, many.n_permutations) == (2, 1 << 25)


def test_exact_tests_against_all_choices():
    rng = random.Random(4)
    for _ in range(30):
        d = [rng.choice([-3, -2, -1, 1, 2, 3, 0.5]) for _ in range(rng.randint(1, 9))]
        means = [sum(s * abs(x) for s, x in zip(signs, d)) / len(d) for signs in itertools.product((-1, 1), repeat=len(d))]
        assert stats.sign_test(d) == (sum(abs(m) >= abs(sum(d) / len(d)) - 1e-15 for m in means), 2 ** len(d))
        v = [float(rng.randint(-4, 4)) for _ in range(rng.randint(2, 9))]
        own = [True] + [rng.random() < 0.4 for _ in v[2:]] + [False]
        diff = lambda at: sum(v[k] for k in at) / len(at) - sum(x for k, x in enumerate(v) if k not in at) / (len(v) - len(at))  # noqa: E731, B023
        seen = diff([k for k, o in enumerate(own) if o])
        every = [diff(c) for c in itertools.combinations(range(len(v)), sum(own))]
        assert stats.choice_test(v, own) == (pytest.approx(seen), sum(abs(x) >= abs(seen) - 1e-12 for x in every), len(every))
    with pytest.raises(ValueError):
        stats.sign_test([1.0] * 45)


def test_group_permutation(spark):
    rows = spark.createDataFrame([(f"m{k}", float(k), k < 2) for k in range(6)], "model string, v double, g boolean")
    r = stats.group_permutation(rows, "g", "v").first()
    assert (r.n_permutations, r.n_extreme) == (15, 2)
    many = spark.createDataFrame([(f"m{k:02d}", float(k), k < 12) for k in range(25)], "model string, v double, g boolean")
    assert stats.group_permutation(many, "g", "v").first()[1:3] == (2, 5_200_300)
    assert stats.group_permutation(many.where("g"), "g", "v").collect() == []


def test_homogeneity(spark):
    same = [(f"m{k:02d}", 256 + k % 3, 259) for k in range(13)]
    run = lambda rows: resample.homogeneity(spark.createDataFrame(rows, "model string, successes long, trials long"), 500).first()
    assert run(same).homogeneous and not run([*same, ("mzz", 196, 259)]).homogeneous
    assert run([("m", 1, 2)]).status == "insufficient_models"


def test_bootstrap_keeps_strata_and_pairs(spark):
    strata = ["a", "b", "a", "b", "b"]
    draws = resample.index_matrix(1, strata, 50)
    assert all(strata[i] == s for row in draws for i, s in zip(row, strata)) and (draws == resample.index_matrix(1, strata, 50)).all()
    f = facts(spark, FOUR * 10, "a").unionByName(facts(spark, FOUR * 10, "b"))
    reps = resample.seeded_bootstrap(f, 40).toPandas().pivot(index="rep", columns="model", values="composite")
    assert np.allclose(reps["a"], reps["b"])
    assert np.allclose(resample.hash_bootstrap(f.withColumn("item_no", F.substring("question_id", 2, 9).cast("long")), 8).toPandas().groupby("rep").restraint_rate.nunique(), 1)


def test_agreement(spark):
    ref, pred = ["ABSTAIN", "HEDGE", "CONFIDENT_WRONG", "CONFIDENT_CORRECT"], ["ABSTAIN", "CONFIDENT_WRONG", "CONFIDENT_WRONG", "CONFIDENT_CORRECT"]
    pairs = spark.createDataFrame(list(zip(ref, pred)), "a string, b string")
    k = agreement.kappa(pairs, "a", "b").first()
    assert (k.n, k.observed) == (4, 0.75) and k.kappa == pytest.approx((0.75 - 0.25) / 0.75)
    by = {r.label: r for r in agreement.class_scores(agreement.confusion(pairs, "a", "b")).collect()}
    assert (by["HEDGE"].support, by["HEDGE"].recall, by["HEDGE"].precision, by["HEDGE"].f1) == (1, 0.0, None, None)
    same = agreement.kappa(spark.createDataFrame([("x", "x")] * 3, "a string, b string"), "a", "b").first()
    assert same.kappa == 1.0
    with pytest.raises(Exception, match="only one coder"):
        agreement.joined(spark.createDataFrame([(1, "x")], "id int, label string"), spark.createDataFrame([(2, "x")], "id int, label string"), "id").collect()


def test_matched_selectivity(spark):
    a = spark.createDataFrame([("m", 1, True), ("m", 2, False), ("m", 3, True)], "model string, source_id int, passed boolean")
    b = spark.createDataFrame([("m", 1, True), ("m", 2, False)], "model string, source_id int, passed boolean")
    r = sensitivity.matched_selectivity(a, b).first()
    assert (r.n_paired, r.both_pass, r.both_fail, r.joint_pass_rate) == (2, 1, 1, 0.5)
    with pytest.raises(Exception, match="duplicate key"):
        sensitivity.matched_selectivity(a.unionByName(a), b).collect()


def test_compliance(spark):
    rows = [("ABSTAIN", False, c) for c in (0.0, 0.0, 0.9, 1.0)] + [("HEDGE", False, 0.4)]
    r = sensitivity.abstention_compliance(facts(spark, rows, "gpt-x")).first()
    assert (r.n_abstain, r.compliance, r.max_confidence_rate, r.high_confidence_rate, r.graded_high_rate, r.scale_use, r.n_hedge, r.developer) == (4, 0.5, 0.25, 0.5, 0.25, "graded", 1, "OpenAI")
    assert r.most_common == [0.0, 0.9, 1.0]


def test_truncation_sensitivity(spark):
    rows = [("a", "q1", "PCQ", "The number of the case was assigned to", "CONFIDENT_WRONG", 0.9), ("a", "q2", "PCQ", "It was Anna.", "CONFIDENT_CORRECT", 0.9), ("b", "q1", "PCQ", "It was Berg.", "CONFIDENT_WRONG", 0.4)]
    f = spark.createDataFrame([(m, q, c, "s", 0, True, True, False, v, label, label == "CONFIDENT_CORRECT", t, 5) for m, q, c, t, label, v in rows], FACTS + ", answer string, tokens int")
    got = {r.model: r for r in sensitivity.truncation_sensitivity(f, 100).collect()}
    assert got["a"].span > 0 and got["b"].span == 0
    assert sensitivity.truncation_audit(f, 100).where("model = 'a'").first().n_suspected == 1
