"""Queries of audits: normalised texts, release gates, ledgers, registries, configurations, runs and the family of a classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, lineage, scoring, validation
from ..sources import readers, registry
from . import adapters as A
from . import reports
from .queries import ORACLES, QUERIES, REC, coders, out, query, rank_sql, scores_sql
from .text_queries import ledger


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS norm_md5 FROM documents")
def q_normalise(spark, sf_dir):
    """All documents in the form in which texts are compared, accents folded."""
    return out(A.table(spark, sf_dir, "documents").select("doc_id", F.md5(F.encode(T.normalise(F.col("text")), "UTF-8")).alias("norm_md5")))


# --- release gates

_REVIEWS = """r AS (SELECT p_partkey AS k, 'i' || p_partkey AS id, ['FEQ','PCQ','HNQ','CCQ'][CAST(p_partkey % 4 AS INT) + 1] AS category, 's' || (p_partkey % 10) AS sub, CASE WHEN p_partkey % 3 = 0 THEN 'candidate_requires_human_review' ELSE 'release_ready' END AS status,
 p_partkey % 5 <> 0 AS passed1, CASE WHEN p_partkey % 7 = 0 THEN 'open' ELSE 'completed' END AS status1, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'Ann' END AS name1, p_partkey % 6 <> 0 AS passed2, CASE WHEN p_partkey % 13 = 0 THEN 'required_independent_review_pending' ELSE 'completed' END AS status2,
 CASE WHEN p_partkey % 17 = 0 THEN '' ELSE 'v1' END AS version2, p_partkey % 2 = 0 AS member, CASE WHEN p_partkey % 19 = 0 THEN 'reject' ELSE 'accept' END AS decision, p_partkey % 15 <> 0 AS independent, p_partkey % 23 <> 0 AS ok, CAST(p_partkey % 2 = 0 AS INT) * 300 AS sample FROM part)"""
# a check that failed is excused in a candidate if its own rule holds
_EXCUSED = "status = 'candidate_requires_human_review' AND (NOT passed1 OR NOT passed2) AND (passed1 OR status1 = 'mandatory_review_pending') AND (passed2 OR (status2 = 'required_independent_review_pending' AND independent AND sample = 300))"


def reviewed(spark, sf_dir):
    """Items with the JSON of their two reviews."""
    p = A.table(spark, sf_dir, "part").selectExpr(
        "p_partkey as pos", "concat('i', cast(p_partkey as string)) as question_id", "element_at(array('FEQ', 'PCQ', 'HNQ', 'CCQ'), cast(p_partkey % 4 as int) + 1) as category", "concat('s', cast(p_partkey % 10 as string)) as subcategory",
        "case when p_partkey % 3 = 0 then 'candidate_requires_human_review' else 'release_ready' end as release_status", "concat('What is the number of part ', cast(p_partkey as string), '?') as question", "concat('a [REDACTED] ', cast(p_partkey as string)) as document", "'blue' as redacted_value",
        "if(p_partkey % 4 = 3, '[REDACTED]', 'sixteen') as correct_answer", "true as qc_passed", "cast(null as array<struct<source_id: string, url: string, publisher: string, verified_at: string, evidence: string>>) as source_evidence",
        """to_json(named_struct('passed', p_partkey % 23 <> 0, 'checks', named_struct(
            'human_source_review', named_struct('passed', p_partkey % 5 <> 0, 'status', if(p_partkey % 7 = 0, 'open', 'completed'), 'reviewer_name', if(p_partkey % 11 = 0, '', 'Ann')),
            'independent_secondary_review', named_struct('passed', p_partkey % 6 <> 0, 'status', if(p_partkey % 13 = 0, 'required_independent_review_pending', 'completed'), 'review_protocol_version', if(p_partkey % 17 = 0, '', 'v1'),
                'sample_member', p_partkey % 2 = 0, 'reviewer_identifier', 'x', 'decision', if(p_partkey % 19 = 0, 'reject', 'accept'), 'independent_of_primary', p_partkey % 15 <> 0, 'blinded_to_primary_decision', true,
                'reviewer_must_differ_from_primary', p_partkey % 15 <> 0, 'fixed_stratified_sample_size', if(p_partkey % 2 = 0, 300, 0))))) as qc""",
    )
    return p


@query(
    f"""WITH {_REVIEWS}, q AS (SELECT *, NOT ok AS failed, {_EXCUSED} AS excused, category IN ('PCQ','HNQ') AND status = 'release_ready' AS factual FROM r), s AS (SELECT sub, count(*) AS n, sum(member::INT) AS m FROM q WHERE factual GROUP BY sub)
SELECT 'error' AS severity, code, id FROM (SELECT id, unnest([CASE WHEN failed AND NOT excused THEN 'qc_failed' END, CASE WHEN factual AND NOT (passed1 AND status1 = 'completed' AND name1 <> '') THEN 'release_primary_review_missing' END,
 CASE WHEN factual AND NOT (passed2 AND status2 = 'completed' AND version2 <> '') THEN 'release_secondary_review_missing' END, CASE WHEN factual AND member AND NOT (decision = 'accept' AND independent) THEN 'release_secondary_sample_attestation_incomplete' END]) AS code FROM q) WHERE code IS NOT NULL
UNION ALL SELECT 'warning', 'candidate_human_gate_pending', id FROM q WHERE failed AND excused
UNION ALL SELECT 'error', 'secondary_review_sample_size', NULL WHERE (SELECT sum(n) FROM s) <> 1500 OR (SELECT sum(m) FROM s) <> 300
UNION ALL SELECT 'error', 'secondary_review_stratum_balance', NULL WHERE (SELECT sum(m) FROM s) > 0 AND ((SELECT count(*) FROM s WHERE m > 0) <> 10 OR EXISTS (SELECT 1 FROM s WHERE m > 0 AND m <> 30))"""
)
def q_release_issues(spark, sf_dir):
    return out(validation.dataset_issues(reviewed(spark, sf_dir), allow_pending_review=True).where("code not in ('pcq_unusable_gold', 'pcq_malformed_question')"))


# --- ledgers

_FACTS = "f AS (SELECT 'f' || o_orderkey AS id, 's' || (o_custkey % 5) AS sub, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, 'gold ' || (o_custkey % 3) AS g, o_orderkey AS k FROM orders)"


@query(
    f"""WITH {_FACTS}, i AS (SELECT CASE WHEN k % 31 = 0 THEN 'x' || k ELSE id END AS id, CASE WHEN k % 7 = 0 THEN 'other' ELSE sub END AS sub, CASE WHEN k % 11 = 0 THEN NULL ELSE d END AS d, CASE WHEN k % 13 = 0 THEN 'gold' ELSE g END AS g,
 sha256('{{"event_date":"' || d || '","fact_id":"' || id || CASE WHEN k % 17 = 0 THEN ' ' ELSE '' END || '"}}') AS h FROM f), j AS (SELECT i.*, f.id AS fid, f.sub AS fs, f.d AS fd, f.g AS fg, sha256('{{"event_date":"' || f.d || '","fact_id":"' || f.id || '"}}') AS fh FROM i LEFT JOIN f ON f.id = i.id)
SELECT 'error' AS severity, code, id FROM (SELECT id, unnest(CASE WHEN fid IS NULL THEN ['missing_ledger_fact'] ELSE [CASE WHEN sub <> fs THEN 'subcategory_mismatch' END, CASE WHEN d IS DISTINCT FROM fd THEN 'event_date_mismatch' END, CASE WHEN g <> fg THEN 'gold_answer_mismatch' END, CASE WHEN h <> fh THEN 'ledger_fact_hash_mismatch' END] END) AS code FROM j) WHERE code IS NOT NULL"""
)
def q_ledger_join(spark, sf_dir):
    """Items against the facts they were made from, also by the hash of a fact's canonical JSON."""
    f = ledger(spark, sf_dir)
    form = lambda i: readers.canonical_sha256(F.to_json(F.struct(i.alias("fact_id"), F.col("event_date"))))
    facts = f.withColumn("sha256", form(F.col("fact_id")))
    k = F.col("pos")
    made = f.select(
        F.when(k % 31 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.col("fact_id")).alias("question_id"), F.when(k % 7 == 0, "other").otherwise(F.col("subcategory")).alias("subcategory"), F.when(k % 11 != 0, F.col("event_date")).alias("event_date"),
        F.when(k % 13 == 0, "gold").otherwise(F.col("gold_answer")).alias("correct_answer"), form(F.when(k % 17 == 0, F.concat("fact_id", F.lit(" "))).otherwise(F.col("fact_id"))).alias("ledger_fact_sha256"),
    )
    return out(validation.ledger_join_issues(made, facts))


@query(
    """WITH e AS (SELECT 'i' || doc_id AS id, 's' || (doc_id % 3) AS source_id, 'snap/' || doc_id AS path, upper(sha256(text)) AS want FROM documents), h AS (SELECT 'snap/' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS have FROM documents WHERE doc_id % 11 <> 0)
SELECT 'error' AS severity, CASE WHEN have IS NULL THEN 'snapshot_missing' ELSE 'snapshot_hash_mismatch' END AS code, id, source_id FROM e LEFT JOIN h USING (path) WHERE have IS NULL OR have <> lower(want)"""
)
def q_snapshot_issues(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("snap/"), F.col("doc_id").cast("string")).alias("path"))
    s = F.struct(F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("source_id"), F.col("path").alias("snapshot_path"), F.upper(F.sha2("text", 256)).alias("snapshot_sha256"))
    made = d.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("question_id"), F.array(s).alias("source_evidence"))
    files = d.where("doc_id % 11 <> 0").select("path", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("sha256"))
    return out(validation.snapshot_issues(made, files))


# --- registries and configurations

_MODELS = """m AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 40 = 0 THEN 'same' ELSE 'm' || s_suppkey END AS name, ['openai','huggingface','openai_compatible','local'][CAST(s_suppkey % 4 AS INT) + 1] AS provider, CASE WHEN s_suppkey % 16 = 1 THEN 'one' ELSE 'M-' || s_suppkey END AS route, CASE WHEN s_suppkey % 5 = 0 THEN 'ftp://x' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'https://x/y' END AS url,
 CASE WHEN s_suppkey % 3 = 0 THEN 'strict' ELSE NULL END AS policy, CASE WHEN s_suppkey % 9 < 6 THEN 'p' || (s_suppkey // 3) END AS pair, CASE s_suppkey % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'new' ELSE 'new' END AS side, CASE WHEN s_suppkey % 7 = 0 THEN 'soon' WHEN s_suppkey % 7 = 1 THEN NULL ELSE '2024-0' || (1 + s_suppkey % 9) || '-15' END AS cutoff,
 s_suppkey % 2 = 0 AS eligible, CASE WHEN s_suppkey % 6 = 0 THEN 'guess' WHEN s_suppkey % 6 = 1 THEN NULL ELSE 'verified_primary' END AS evidence, CASE WHEN s_suppkey % 8 = 0 THEN 'on' ELSE NULL END AS reasoning, CASE WHEN s_suppkey % 10 = 0 THEN '9KEY' ELSE 'KEY_1' END AS env, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'm ' || s_suppkey END AS resolved, CASE WHEN s_suppkey % 12 < 6 THEN 'verified' END AS op FROM supplier)"""


def registered(spark, sf_dir):
    """Models of suppliers, with flaws by rule."""
    s = A.table(spark, sf_dir, "supplier").selectExpr(
        "if(s_suppkey % 40 = 0, 'same', concat('m', cast(s_suppkey as string))) as name", "element_at(array('openai', 'huggingface', 'openai_compatible', 'local'), cast(s_suppkey % 4 as int) + 1) as provider", "if(s_suppkey % 16 = 1, 'one', concat('M-', cast(s_suppkey as string))) as provider_model",
        "case s_suppkey % 5 when 0 then 'ftp://x' when 1 then null else 'https://x/y' end as base_url", "if(s_suppkey % 3 = 0, 'strict', null) as model_identity_policy", "if(s_suppkey % 9 < 6, concat('p', cast(s_suppkey div 3 as string)), null) as pair", "if(s_suppkey % 3 = 0, 'old', 'new') as generation",
        "case when s_suppkey % 7 = 0 then 'soon' when s_suppkey % 7 = 1 then null else concat('2024-0', cast(1 + s_suppkey % 9 as string), '-15') end as cutoff", "s_suppkey % 2 = 0 as pcq_eligible", "case s_suppkey % 6 when 0 then 'guess' when 1 then null else 'verified_primary' end as cutoff_evidence_status",
        "if(s_suppkey % 8 = 0, 'on', null) as reasoning_mode", "if(s_suppkey % 10 = 0, '9KEY', 'KEY_1') as api_key_env", "if(s_suppkey % 11 = 0, null, concat('m ', cast(s_suppkey as string))) as endpoint_verified_resolved_model", "if(s_suppkey % 12 < 6, 'verified', null) as operational_status",
    )
    return registry.with_defaults(s)


@query(
    f"""WITH {_MODELS}, c AS (SELECT name AS id, unnest([CASE WHEN provider = 'local' THEN 'unsupported_provider' END, CASE WHEN env = '9KEY' THEN 'invalid_key_variable' END, CASE WHEN provider = 'openai_compatible' AND url IS NULL THEN 'missing_base_url' END, CASE WHEN url LIKE 'ftp%' THEN 'invalid_base_url' END,
 CASE WHEN reasoning = 'on' THEN 'reasoning_enabled' END, CASE WHEN evidence = 'guess' THEN 'invalid_evidence_status' END, CASE WHEN cutoff = 'soon' THEN 'invalid_cutoff' END, CASE WHEN eligible AND cutoff IS NULL THEN 'missing_cutoff' END, CASE WHEN eligible AND TRY_CAST(cutoff AS DATE) > DATE '2024-06-01' THEN 'cutoff_after_bound' END]) AS code FROM m)
SELECT code, id FROM c WHERE code IS NOT NULL UNION ALL SELECT 'duplicate_name', name FROM m GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'duplicate_route', min(name) FROM m GROUP BY provider, route HAVING count(*) > 1
UNION ALL SELECT 'pair_side_taken_twice', min(name) FROM m WHERE pair IS NOT NULL GROUP BY pair, side HAVING count(*) > 1 UNION ALL SELECT 'pair_not_of_two', pair FROM m WHERE pair IS NOT NULL GROUP BY pair HAVING count(*) <> 2
UNION ALL SELECT 'panel_size', NULL WHERE (SELECT count(*) FROM m) <> 21 UNION ALL SELECT 'panel_pairs', NULL WHERE (SELECT count(DISTINCT pair) FROM m) <> 8"""
)
def q_registry_issues(spark, sf_dir):
    return out(registry.registry_issues(registered(spark, sf_dir), "reference", "2024-06-01"))


@query(
    f"""WITH {_MODELS}, c AS (SELECT name AS id, unnest([CASE WHEN op IS NULL THEN 'not_operationally_verified' END, 'endpoint_not_verified', CASE WHEN resolved IS NULL THEN 'resolved_model_missing' WHEN policy IS NULL THEN 'identity_not_strict' WHEN 'm' || k <> replace(lower(route), '-', '') THEN 'resolved_another_model' END,
 CASE WHEN eligible AND cutoff IS NULL THEN 'no_cutoff' END, CASE WHEN eligible AND coalesce(evidence, '') <> 'verified_primary' THEN 'cutoff_not_release_verified' END, CASE WHEN eligible THEN 'cutoff_source_not_authoritative' END]) AS code FROM m) SELECT code, id FROM c WHERE code IS NOT NULL"""
)
def q_registry_release(spark, sf_dir):
    return out(registry.release_issues(registered(spark, sf_dir)))


@query(
    """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN 0.2 ELSE 0.3 END AS a, CASE WHEN c_custkey % 17 = 0 THEN 1.2 ELSE 0.45 END AS b, CASE WHEN c_custkey % 17 = 0 THEN -0.5 ELSE 0.25 END AS d, c_custkey % 5 AS t, c_custkey % 7 AS m, c_custkey % 4 AS bins, c_custkey % 6 AS w, c_custkey % 11 = 0 AS nov, c_custkey % 2 = 0 AS ev, c_custkey % 9 = 0 AS search, c_custkey % 10 AS total FROM customer)
SELECT id, code FROM (SELECT id, unnest([CASE WHEN b > 1 THEN 'weights_outside_unit_interval' END, CASE WHEN abs(a + b + d - 1) > 1e-9 THEN 'weights_do_not_sum_to_one' END, CASE WHEN t <> 0 THEN 'temperature_not_zero' END, CASE WHEN m = 0 THEN 'max_tokens_not_positive' END, CASE WHEN bins < 2 THEN 'too_few_bins' END, CASE WHEN w = 0 THEN 'max_workers_not_positive' END,
 CASE WHEN nov AND NOT ev THEN 'novelty_without_evidence' END, CASE WHEN search THEN 'search_or_history_enabled' END, CASE WHEN total = 0 THEN 'expected_total_not_positive' END]) AS code FROM c) WHERE code IS NOT NULL"""
)
def q_configuration_issues(spark, sf_dir):
    c = A.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "named_struct('restraint', if(c_custkey % 13 = 0, 0.2D, 0.3D), 'avoidance', if(c_custkey % 17 = 0, 1.2D, 0.45D), 'calibration', if(c_custkey % 17 = 0, -0.5D, 0.25D)) as weights",
        "named_struct('temperature', cast(c_custkey % 5 as double), 'max_tokens', cast(c_custkey % 7 as int), 'enable_search', c_custkey % 9 = 0, 'enable_history', false) as inference", "named_struct('scale_min', 0, 'scale_max', 100, 'n_bins', cast(c_custkey % 4 as int), 'max_tokens', 8) as confidence",
        "cast(c_custkey % 6 as int) as max_workers", "named_struct('expected_total', cast(c_custkey % 10 as int), 'expected_per_category', cast(null as int), 'require_source_evidence', c_custkey % 2 = 0, 'require_pcq_temporal_novelty', c_custkey % 11 = 0) as dataset_requirements",
    )
    return out(registry.configuration_issues(c))


# --- runs


def _runs(spark, sf_dir):
    """(records, manifests) of three runs: b lacks a version, lists a model without records and misses one; c has other prompts."""
    r = A.records(spark, sf_dir).where("item_no < 700").withColumn("source_run", F.expr("case when model < 'm04' then 'a' when model < 'm08' then 'b' else 'c' end"))
    ids = r.select("question_id").distinct().agg(F.sort_array(F.collect_list("question_id")).alias("ids"))
    named = r.groupBy("source_run").agg(F.sort_array(F.collect_set("model")).alias("models"))
    x = named.crossJoin(F.broadcast(ids))
    listed = F.when(F.col("source_run") == "b", F.concat(F.slice("models", 1, 3), F.array(F.lit("ghost")))).otherwise(F.col("models"))
    selection = F.struct(F.col("ids").alias("question_ids"), F.size("ids").alias("n_selected"), F.lit("q").alias("question_ids_sha256"))
    run = F.struct(F.lit("s").alias("framework_source_sha256"), selection.alias("selection"), F.when(F.col("source_run") == "c", "p2").otherwise("p1").alias("answer_prompt_version"), F.lit("c1").alias("confidence_prompt_version"), F.lit("d").alias("dataset_policy"))
    config = F.struct(F.lit("c").alias("sha256"), F.struct(F.lit(1).alias("b"), F.lit("x").alias("a")).alias("snapshot"))
    manifest = F.to_json(F.struct(F.when(F.col("source_run") != "b", "1").alias("framework_version"), F.lit("2").alias("protocol_version"), F.struct(F.lit("h").alias("sha256")).alias("dataset"), config.alias("config"), run.alias("run"), F.transform(listed, lambda m: F.struct(m.alias("name"))).alias("models")))
    return r, x.select("source_run", manifest.alias("manifest"))


@query(
    f"""WITH {REC}, r AS (SELECT *, CASE WHEN model < 'm04' THEN 'a' WHEN model < 'm08' THEN 'b' ELSE 'c' END AS run FROM rec WHERE item_no < 700), q AS (SELECT count(DISTINCT question_id) AS n FROM r), m AS (SELECT run, model, count(*) AS n, count(DISTINCT question_id) AS d, count(*) FILTER (NOT (answered AND confidence IS NOT NULL)) AS u FROM r GROUP BY ALL)
SELECT 'signature_field_missing' AS code, 'b' AS source_run, 'framework_version' AS detail UNION ALL SELECT 'signature_differs', NULL, 'framework_version' UNION ALL SELECT 'signature_differs', NULL, 'answer_prompt_version' UNION ALL SELECT 'model_not_in_manifest', 'b', 'm07' UNION ALL SELECT 'model_without_records', 'b', 'ghost'
UNION ALL SELECT 'not_one_record_for_each_question', run, model FROM m, q WHERE m.n <> q.n OR m.d <> m.n UNION ALL SELECT 'incomplete_coverage', run, model FROM m WHERE u > 0"""
)
def q_run_issues(spark, sf_dir):
    return out(lineage.run_issues(*_runs(spark, sf_dir)))


# --- panels

_ROUTES = "(VALUES ('m00', 'east'), ('m03', 'west'), ('m07', NULL)) v(model, route)"


@query(f"WITH {REC} SELECT DISTINCT r.model, coalesce(v.route, 'unknown') AS route FROM rec r LEFT JOIN {_ROUTES} ON v.model = r.model")
def q_routes(spark, sf_dir):
    routes = spark.createDataFrame([("m00", "east"), ("m03", "west"), ("m07", None)], "model string, route string")
    return out(readers.route_of(A.records(spark, sf_dir).select("model").distinct(), routes))


@query(f"WITH {REC}, {scores_sql('model')}, x AS (SELECT model, composite, {rank_sql('composite')} AS rank FROM sc WHERE composite IS NOT NULL) SELECT model, round(composite, 9) AS composite, rank FROM x WHERE rank <= 4")
def q_top_models(spark, sf_dir):
    return out(reports.top_models(scoring.scores(A.records(spark, sf_dir))), "model", "composite", "rank")


@query(
    f"""WITH {REC}, {scores_sql('model')}, e AS (SELECT model, sum((NOT answered OR label IS NULL)::INT)::BIGINT AS n_excluded, sum((answered AND label IS NOT NULL AND confidence IS NULL)::INT)::BIGINT AS n_excluded_calibration_only FROM rec GROUP BY model), p AS (SELECT 'm' || lpad(CAST(range AS VARCHAR), 2, '0') AS model, (200 + (range * 17) % 50) / 259 AS capability FROM range(12))
SELECT sc.model, round(composite, 9) AS composite, {rank_sql('composite')} AS rank, n_excluded, n_excluded_calibration_only, round(capability, 9) AS capability FROM sc JOIN e ON e.model = sc.model LEFT JOIN p ON p.model = sc.model"""
)
def q_summary_table(spark, sf_dir):
    t = reports.summary_table(A.records(spark, sf_dir), counts=A.capability(spark))
    return out(t, "model", "composite", "rank", "n_excluded", "n_excluded_calibration_only", "capability")


_FAMILY = """fam AS (SELECT CASE WHEN doc_id % 8 < 3 THEN 'a' ELSE 'b' END || CAST(doc_id % 8 AS VARCHAR) AS model, CASE WHEN quality = 1 THEN 'CONFIDENT_CORRECT' WHEN doc_id % 3 = 0 THEN 'HEDGE' ELSE 'CONFIDENT_WRONG' END AS a, CASE WHEN toxic = 1 THEN 'CONFIDENT_WRONG' WHEN doc_id % 11 = 0 THEN 'ABSTAIN' WHEN quality = 1 THEN 'CONFIDENT_CORRECT' ELSE 'HEDGE' END AS b FROM labels),
i AS (SELECT model, avg((a IN ('ABSTAIN','HEDGE'))::INT) AS ra, avg((b IN ('ABSTAIN','HEDGE'))::INT) AS rh, 1 - avg((a = 'CONFIDENT_WRONG')::INT) AS aa, 1 - avg((b = 'CONFIDENT_WRONG')::INT) AS ah FROM fam GROUP BY 1)"""


def _impact(spark, sf_dir):
    family = F.concat(F.when(F.col("doc_id") % 8 < 3, "a").otherwise("b"), (F.col("doc_id") % 8).cast("string"))
    return agreement.score_impact(coders(spark, sf_dir).withColumn("model", family), "a", "b")


@query(
    f"""WITH {_FAMILY}, v AS (SELECT 'restraint' AS component, model, ra - rh AS d, rh AS h, (model LIKE 'a%')::INT AS g FROM i UNION ALL SELECT 'avoidance', model, aa - ah, ah, (model LIKE 'a%')::INT FROM i), k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY model) - 1 AS k FROM v),
t AS (SELECT component, sum(d) AS t, sum(d * g) AS own FROM v GROUP BY component), m AS (SELECT component, mask, sum(CASE WHEN (mask >> k) & 1 = 1 THEN d ELSE 0 END) AS s FROM k CROSS JOIN range(256) r(mask) WHERE bit_count(mask) = 3 GROUP BY ALL),
x AS (SELECT component, own / 3 - (t - own) / 5 AS difference, sum((abs(s / 3 - (t - s) / 5) >= abs(own / 3 - (t - own) / 5) - 1e-12)::INT)::BIGINT AS n_extreme, count(*) AS n_permutations FROM m JOIN t USING (component) GROUP BY ALL),
c AS (SELECT component, count(*) AS n_models, sum(g)::BIGINT AS n_family, avg(d) FILTER (g = 1) AS fm, avg(d) FILTER (g = 0) AS om, corr(g, d) AS fb, corr(h, d) AS hb, corr(g, h) AS fh FROM v GROUP BY component)
SELECT component, n_models, n_family, round(fm, 9) AS family_mean_bias, round(om, 9) AS other_mean_bias, round(difference, 9) AS difference, n_extreme, n_permutations, round(n_extreme / n_permutations, 9) AS p_value, round(fb, 9) AS family_bias_r, round(hb, 9) AS human_bias_r, round(fh, 9) AS family_human_r,
 round((fb - fh * hb) / sqrt((1 - fh * fh) * (1 - hb * hb)), 9) AS family_bias_given_human, round((hb - fh * fb) / sqrt((1 - fh * fh) * (1 - fb * fb)), 9) AS human_bias_given_family FROM c JOIN x USING (component)"""
)
def q_family_bias(spark, sf_dir):
    return out(agreement.family_bias(_impact(spark, sf_dir), "a"))


@query(
    f"""WITH {_FAMILY} SELECT model, CASE WHEN model LIKE 'a%' THEN 'family' ELSE 'other' END AS "group", round(ra, 9) AS restraint_auto, round(rh, 9) AS restraint_human, round(aa, 9) AS avoidance_auto, round(ah, 9) AS avoidance_human,
 {rank_sql('ra')} AS restraint_auto_rank, {rank_sql('rh')} AS restraint_human_rank, {rank_sql('aa')} AS avoidance_auto_rank, {rank_sql('ah')} AS avoidance_human_rank FROM i"""
)
def q_family_ranks(spark, sf_dir):
    return out(agreement.family_ranks(_impact(spark, sf_dir), "a"))


__all__ = ["QUERIES", "ORACLES"]
