"""Registries, configurations, run packages, hashes and sinks on small cases."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candor.operators import lineage, validation
from candor.plans import reports
from candor.sources import readers, registry, writers

GOOD = {
    "protocol_version": "2", "weights": {"w1": 0.3, "w2": 0.45, "w3": 0.25}, "inference": {"temperature": 0.0, "max_tokens": 64, "enable_search": False, "enable_history": False},
    "confidence": {"scale_min": 0, "scale_max": 100, "n_bins": 10, "max_tokens": 8}, "max_workers": 4, "dataset_requirements": {"require_source_evidence": True, "require_pcq_temporal_novelty": True},
}


@pytest.mark.parametrize(
    "change, codes",
    [
        ({}, None),
        ({"protocol_version": "1"}, "protocol"),
        ({"weights": {"w1": 0.5, "w2": 0.45, "w3": 0.25}}, "weights_do_not_sum_to_one"),
        ({"weights": {"w1": -0.1, "w2": 0.85, "w3": 0.25}}, "weights_outside_unit_interval"),
        ({"weights": {"w1": 0.3}}, "incomplete"),
        ({"inference": GOOD["inference"] | {"temperature": 0.5, "enable_search": True}}, "temperature_not_zero, search_or_history_enabled"),
        ({"confidence": GOOD["confidence"] | {"scale_max": 10, "n_bins": 1, "max_tokens": 0}}, "confidence_scale, too_few_bins, confidence_max_tokens_not_positive"),
        ({"max_workers": 0, "dataset_requirements": {"require_source_evidence": False, "require_pcq_temporal_novelty": True, "expected_total": 0}}, "max_workers_not_positive, novelty_without_evidence, expected_total_not_positive"),
    ],
)
def test_configurations(spark, tmp_path, change, codes):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(GOOD | change, indent=1))
    load = lambda: registry.experiment(spark, str(path), "2", ("w1", "w2", "w3"))
    if codes is None:
        assert load()["weights"] == {"restraint": 0.3, "avoidance": 0.45, "calibration": 0.25}
    else:
        with pytest.raises(ValueError, match=codes):
            load()


def test_registry(spark, tmp_path):
    one = {"name": "a", "provider": "openai", "provider_model": "A-1", "pair": "p", "generation": "old", "cutoff": "2024-01-31", "pcq_eligible": True}
    two = {"name": "b", "provider": "openai_compatible", "provider_model": "B", "pair": "p", "generation": "new", "base_url": "https://h/x"}
    path = tmp_path / "models.json"
    path.write_text(json.dumps({"registry_mode": "custom", "models": [one, two]}))
    rows, head = registry.models(spark, str(path))
    assert head == {"registry_mode": "custom"}
    assert [(r.pos, r.pcq_cutoff, r.operational_status, r.requires_api_key, r.pcq_eligible) for r in rows.orderBy("pos").collect()] == [(0, "2024-01-31", "unverified", True, True), (1, None, "unverified", True, False)]
    assert registry.registry_issues(rows).collect() == []
    assert {r.code for r in registry.registry_issues(rows, "reference", "2023-12-31").collect()} == {"cutoff_after_bound", "panel_size", "panel_pairs"}
    assert {r.code for r in registry.registry_issues(rows, "reference", "soon").collect()} == {"panel_size", "panel_pairs", "panel_bound"}
    broken = rows.withColumns({"name": F.lit("x"), "provider_model": F.lit("y"), "provider": F.lit("openai"), "generation": F.lit("old"), "thinking_mode": F.lit("on"), "cutoff_precision": F.lit("week"), "cutoff_definition": F.lit("guess"), "model_identity_policy": F.lit("loose")})
    assert {r.code for r in registry.registry_issues(broken).collect()} == {"duplicate_name", "duplicate_route", "pair_side_taken_twice", "thinking_enabled", "invalid_cutoff_precision", "invalid_cutoff_definition", "invalid_identity_policy"}
    assert {(r.code, r.id) for r in registry.registry_issues(rows.where("false")).collect()} == {("no_models", None)}
    codes = {r.code for r in registry.reference_release_issues(rows, ["a"], None).collect()}
    assert {"panel_not_release_verified", "outside_release_scope", "cutoff_source_url_missing", "thinking_tokens_not_zero"} <= codes and "attestation_incomplete" not in codes
    path.write_text("[]")
    with pytest.raises(ValueError):
        registry.models(spark, str(path))


def test_capability_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"x": 0.5, "y": None}))
    (tmp_path / "b.json").write_text(json.dumps([{"model": "x", "CQ": 0.25}, {"model": "y", "capability_score": 1, "CQ": 0}, {"model": "z"}]))
    scores = lambda f: {r.model: r.capability_score for r in readers.capability_scores(spark, str(tmp_path / f)).collect()}
    assert scores("a.json") == {"x": 0.5} and scores("b.json") == {"x": 0.25, "y": 1.0}
    counts = spark.createDataFrame([("a", 5, 10), ("b", 9, 10)], "model string, successes long, trials long")
    assert [tuple(r) for r in readers.checked_counts(counts).collect()] == [("b", 0.9, 9, 10), ("a", 0.5, 5, 10)]
    for bad in ((11, 10), (0, 0), (-1, 5)):
        with pytest.raises(PySparkException, match="implausible counts of c"):
            readers.checked_counts(counts.unionByName(spark.createDataFrame([("c", *bad)], counts.schema))).collect()


def test_json_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", [1, 2]), (0, "ä", None)], "pos int, q string, a array<int>")
    writers.dataset(rows, str(tmp_path / "d"))
    assert json.loads("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "d").glob("part*"))) == [{"q": "ä"}, {"a": [1, 2], "q": "b"}]
    writers.json_object(rows.where("pos = 0"), str(tmp_path / "o"))
    assert json.loads("".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part*"))) == {"a": None, "pos": 0, "q": "ä"}
    with pytest.raises(PySparkException):
        writers.json_object(rows, str(tmp_path / "p"))


def test_hashes(spark, tmp_path):
    values = [{"b": 1, "a": ["ü", 1.5]}, {"z": None}]
    rows = spark.createDataFrame([(json.dumps(v, indent=2),) for v in values] + [(None,)], "j string")
    want = [hashlib.sha256(t.encode()).hexdigest() for t in ('{"a":["ü",1.5],"b":1}', '{"z":null}')]
    assert [r[0] for r in rows.select(readers.canonical_sha256(F.col("j"))).collect()] == [*want, None]
    for name, text in (("b.py", "x"), ("sub/a.py", "y"), ("c.txt", "z")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    entries = [{"path": p, "sha256": hashlib.sha256(t.encode()).hexdigest()} for p, t in (("b.py", "x"), ("sub/a.py", "y"))]
    assert readers.tree_sha256(spark, str(tmp_path)) == hashlib.sha256(json.dumps(entries, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    answers = lambda rows: spark.createDataFrame(rows, "request_sha256 string, ok boolean, response string")
    readers.cache_answers(answers([("a", True, "1"), ("b", False, "2"), ("a", True, "1")]), path)
    readers.cache_answers(answers([("a", True, "9"), ("b", True, "3")]), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", True, "1"), ("b", True, "3")]
    manifest = spark.createDataFrame([("p", "u1"), ("q", "u2"), ("q", "u3")], "parser string, url string")
    assert readers.manifest_source(manifest, "p").first().url == "u1"
    for parser in ("q", "none"):
        with pytest.raises(PySparkException, match=f"sources of parser {parser}"):
            readers.manifest_source(manifest, parser).collect()


def test_runs_are_put_together_only_if_compatible(spark):
    records = spark.createDataFrame([("r1", "a", "1", True, True), ("r1", "a", "2", True, True), ("r2", "b", "1", True, True), ("r2", "b", "2", True, True)], "source_run string, model string, question_id string, answered boolean, rated boolean")

    def manifest(models, version="1", ids=("1", "2")):
        return json.dumps({
            "framework_version": version, "protocol_version": "2", "dataset": {"sha256": "d"}, "config": {"sha256": "c", "snapshot": {"x": 1}}, "models": [{"name": m} for m in models],
            "run": {"framework_source_sha256": "s", "selection": {"question_ids_sha256": "q", "n_selected": 2, "question_ids": list(ids)}, "answer_prompt_version": "p", "confidence_prompt_version": "p", "dataset_policy": "x"},
        })

    frame = lambda *rows: spark.createDataFrame(rows, "source_run string, manifest string")
    good = frame(("r1", manifest(["a"])), ("r2", manifest(["b"])))
    assert lineage.aggregated(records, good).count() == 4
    with pytest.raises(PySparkException, match="signature_differs"):
        lineage.aggregated(records, frame(("r1", manifest(["a"])), ("r2", manifest(["b"], "0")))).collect()
    codes = lambda r, m: {x.code for x in lineage.run_issues(r, m).collect()}
    assert codes(records.unionByName(records.where("model = 'a'")), good) == {"not_one_record_for_each_question"}
    assert codes(records.withColumn("model", F.lit("a")), frame(("r1", manifest(["a"])), ("r2", manifest(["a"])))) == {"model_in_several_runs"}
    assert codes(records.withColumn("rated", F.col("model") == "a"), good) == {"incomplete_coverage"}
    assert codes(records, frame(("r1", manifest(["a"], ids=("1", "2", "2"))), ("r2", manifest(["b"])))) == {"selection_repeats_questions"}


def test_novelty_and_subcategories(spark):
    rows = [(0, "q1", "PCQ", "s", "What is the name of it?", None, "blue", None, True, None)]
    items = spark.createDataFrame(rows, "pos int, question_id string, category string, subcategory string, question string, document string, correct_answer string, redacted_value string, qc_passed boolean, source_evidence array<struct<source_id: string, url: string, publisher: string, verified_at: string, evidence: string>>")
    assert validation.dataset_issues(items).collect() == []
    assert [r.code for r in validation.dataset_issues(items, require_novelty=True).collect()] == ["missing_temporal_novelty"]
    facts = spark.createDataFrame([(0, "f", "odd", "2024-01-01", "who won it", "someone", [("s", "https://x", "p", "v", "e")])], "pos int, fact_id string, subcategory string, event_date string, question_target string, gold_answer string, source_evidence array<struct<source_id: string, url: string, publisher: string, verified_at: string, evidence: string>>")
    assert [(r.code, r.id) for r in validation.ledger_issues(facts, ("2024-01-01", "2024-12-31"), subcategories=["even"]).collect()] == [("unexpected_subcategory", "odd")]


def test_publication_tables(spark):
    from .test_scores import facts, FOUR

    tables = reports.publication(facts(spark, FOUR, "m"), counts=spark.createDataFrame([("m", 3, 4)], "model string, successes long, trials long"))
    assert tables["summary"].first().capability == 0.75
    assert all(t.columns for t in tables.values()) and tables["exclusions"].columns[-1] == "exclusion_reason_recorded"
