"""Experiment configurations and model registries: small JSON documents, read whole, with their checks as tables of issues."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

MODEL = (
    "name string, provider string, provider_model string, base_url string, api_key_env string, requires_api_key boolean, model_identity_policy string, model_provider string, pair string, generation string, "
    "reported_model_name string, pcq_cutoff string, cutoff string, training_cutoff string, reliable_knowledge_cutoff string, reported_knowledge_cutoff string, cutoff_precision string, cutoff_definition string, "
    "cutoff_source_url string, cutoff_source_type string, cutoff_evidence_status string, cutoff_verified_at string, cutoff_notes string, pcq_cutoff_is_conservative_upper_bound boolean, "
    "cutoff_attestation_path string, cutoff_attestation_reviewer string, cutoff_attestation_status string, model_reference_url string, pcq_eligible boolean, endpoint_verified_at string, "
    "endpoint_verified_resolved_model string, operational_status string, reasoning_mode string, thinking_mode string, non_reasoning_verified_at string, non_reasoning_observed_thinking_tokens int"
)
# What a registry's fields may say, and what stands where they say nothing.
DEFAULTS = {
    "requires_api_key": True, "model_identity_policy": "record", "cutoff_evidence_status": "unknown", "pcq_cutoff_is_conservative_upper_bound": False, "pcq_eligible": False, "operational_status": "unverified", "reasoning_mode": "disabled",
}
PROVIDERS = ("openai", "huggingface", "openai_compatible")
IDENTITY_POLICIES = ("record", "strict")
EVIDENCE_STATUSES = ("verified_primary", "verified_primary_qualified", "verified_human_adjudicated", "corroborated_secondary", "estimated", "unknown")
PRECISIONS = ("day", "month", "year")
DEFINITIONS = ("training_data_cutoff", "official_knowledge_cutoff", "reliable_knowledge_cutoff", "conservative_common_upper_bound")
RELEASE_EVIDENCE = ("verified_primary", "verified_human_adjudicated")
RELEASE_SOURCES = ("official_model_card", "official_api_documentation", "official_provider_documentation", "official_system_card", "named_human_attestation")
PANEL_MODELS, PANEL_PAIRS = 21, 8


def document(spark: SparkSession, path: str) -> dict:
    """A JSON object at a path that Spark can read, whole; it is a configuration, some kilobytes."""
    value = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if not isinstance(value, dict):
        raise ValueError(f"{path} isn't a JSON object")
    return value


# --- experiment configuration

CONFIG = "weights struct<restraint: double, avoidance: double, calibration: double>, inference struct<temperature: double, max_tokens: int, enable_search: boolean, enable_history: boolean>, confidence struct<scale_min: int, scale_max: int, n_bins: int, max_tokens: int>, max_workers int, dataset_requirements struct<expected_total: int, expected_per_category: int, require_source_evidence: boolean, require_pcq_temporal_novelty: boolean>"


def configuration_issues(configs: DataFrame) -> DataFrame:
    """Codes of what is wrong with configurations (columns of CONFIG and id), one row each."""
    w = [F.col(f"weights.{k}") for k in ("restraint", "avoidance", "calibration")]
    need = "dataset_requirements."
    absent = F.col("weights").isNull() | F.col("inference").isNull() | F.col("confidence").isNull() | F.col("max_workers").isNull() | sum((x.isNull().cast("int") for x in w), F.lit(0)).cast("boolean")
    outside = lambda x: (x < 0) | (x > 1)
    return configs.select(
        "id",
        F.explode(
            T.codes(
                (absent, "incomplete"),
                (outside(w[0]) | outside(w[1]) | outside(w[2]), "weights_outside_unit_interval"),
                (F.abs(w[0] + w[1] + w[2] - 1) > 1e-9, "weights_do_not_sum_to_one"),
                (F.col("inference.temperature") != 0, "temperature_not_zero"),
                (F.col("inference.max_tokens") <= 0, "max_tokens_not_positive"),
                ((F.col("confidence.scale_min") != 0) | (F.col("confidence.scale_max") != 100), "confidence_scale"),
                (F.col("confidence.n_bins") < 2, "too_few_bins"),
                (F.col("confidence.max_tokens") < 1, "confidence_max_tokens_not_positive"),
                (F.col("max_workers") < 1, "max_workers_not_positive"),
                (F.col(need + "require_pcq_temporal_novelty") & ~F.coalesce(F.col(need + "require_source_evidence"), F.lit(False)), "novelty_without_evidence"),
                (F.coalesce(F.col("inference.enable_search"), F.lit(False)) | F.coalesce(F.col("inference.enable_history"), F.lit(False)), "search_or_history_enabled"),
                (F.col(need + "expected_total") < 1, "expected_total_not_positive"),
                (F.col(need + "expected_per_category") < 1, "expected_per_category_not_positive"),
            )
        ).alias("code"),
    )


def experiment(spark: SparkSession, path: str, protocol: str | None = None, weights: tuple[str, str, str] = ("restraint", "avoidance", "calibration")) -> dict:
    """A configuration that passes its checks, else an error that names all codes. weights: the names of the three in the file."""
    raw = document(spark, path)
    if protocol is not None and raw.get("protocol_version") != protocol:
        raise ValueError(f"protocol {raw.get('protocol_version')!r} isn't {protocol!r}")
    named = raw | {"weights": {k: (raw.get("weights") or {}).get(n) for k, n in zip(("restraint", "avoidance", "calibration"), weights)}}
    row = spark.range(1).select(F.lit(path).alias("id"), F.from_json(F.lit(json.dumps(named)), CONFIG).alias("c")).select("id", "c.*")
    if codes := [r.code for r in configuration_issues(row).collect()]:
        raise ValueError(f"{path}: {', '.join(codes)}")
    return named


# --- model registry


def models(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(models with `pos` and defaults filled in, the document without them) of a registry file."""
    raw = document(spark, path)
    if not isinstance(raw.get("models"), list):
        raise ValueError("a registry holds an array of models")
    rows = spark.createDataFrame([(k, json.dumps(m)) for k, m in enumerate(raw["models"])], "pos int, value string").select("pos", F.from_json("value", MODEL).alias("m")).select("pos", "m.*")
    return with_defaults(rows), {k: v for k, v in raw.items() if k != "models"}


def with_defaults(rows: DataFrame) -> DataFrame:
    """Models with all fields of MODEL; an old name of the cutoff counts where the new one is absent."""
    kinds = dict(part.split() for part in MODEL.split(", "))
    have = rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns})
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()}
    return have.withColumns(filled | {"pcq_cutoff": F.coalesce("pcq_cutoff", "cutoff")}).drop("cutoff")


def given(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) != ""


def registry_issues(rows: DataFrame, mode: str = "custom", not_after: str | None = None) -> DataFrame:
    """(code, id) of what keeps a registry from being read: rows of `with_defaults`, small, so counts are joined back.

    A reference panel (mode "reference") has a fixed number of models and pairs and an upper bound of cutoffs.
    """
    if mode not in ("custom", "reference"):
        raise ValueError("mode is custom or reference")
    day = F.when(F.col("pcq_cutoff").rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date("pcq_cutoff"))
    outside = lambda c, values: F.col(c).isNotNull() & ~F.col(c).isin(*values)
    own = rows.select(
        F.col("name").alias("id"),
        F.explode(
            T.codes(
                (~F.col("provider").isin(*PROVIDERS), "unsupported_provider"),
                (~F.col("model_identity_policy").isin(*IDENTITY_POLICIES), "invalid_identity_policy"),
                (given("api_key_env") & ~F.col("api_key_env").rlike("^[A-Za-z_][A-Za-z0-9_]*$"), "invalid_key_variable"),
                ((F.col("provider") == PROVIDERS[2]) & ~given("base_url"), "missing_base_url"),
                (given("base_url") & ~F.col("base_url").rlike("(?i)^https?://[^/]+"), "invalid_base_url"),
                (F.col("reasoning_mode") != "disabled", "reasoning_enabled"),
                (outside("thinking_mode", ("disabled",)), "thinking_enabled"),
                (~F.col("cutoff_evidence_status").isin(*EVIDENCE_STATUSES), "invalid_evidence_status"),
                (outside("cutoff_precision", PRECISIONS), "invalid_cutoff_precision"),
                (outside("cutoff_definition", DEFINITIONS), "invalid_cutoff_definition"),
                (F.col("pcq_cutoff").isNotNull() & day.isNull(), "invalid_cutoff"),
                (F.col("pcq_eligible") & F.col("pcq_cutoff").isNull(), "missing_cutoff"),
                (F.col("pcq_eligible") & (day > F.try_to_date(F.lit(not_after))), "cutoff_after_bound"),
            )
        ).alias("code"),
    )

    def repeated(keys: list[str], code: str, where: Column | None = None) -> DataFrame:
        x = rows if where is None else rows.where(where)
        return x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("name").alias("id")).where("n > 1").select("id", F.lit(code).alias("code"))

    sided = given("pair") & F.col("generation").isin("old", "new")
    out = own.unionByName(repeated(["name"], "duplicate_name")).unionByName(repeated(["provider", "provider_model"], "duplicate_route")).unionByName(repeated(["pair", "generation"], "pair_side_taken_twice", sided))
    pairs = rows.where(given("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    out = out.unionByName(pairs.where("n <> 2").select(F.col("pair").alias("id"), F.lit("pair_not_of_two").alias("code")))
    whole = rows.agg(F.count("*").alias("n"))
    missing = lambda df, cond, code: df.where(cond).select(F.lit(None).cast("string").alias("id"), F.lit(code).alias("code"))
    out = out.unionByName(missing(whole, F.col("n") == 0, "no_models"))
    if mode == "reference":
        out = out.unionByName(missing(whole, F.col("n") != PANEL_MODELS, "panel_size")).unionByName(missing(pairs.agg(F.count("*").alias("n")), F.col("n") != PANEL_PAIRS, "panel_pairs"))
        bound = F.lit(not_after)
        out = out.unionByName(missing(whole, F.coalesce(~bound.rlike(r"^\d{4}-\d\d-\d\d$") | F.try_to_date(bound).isNull(), F.lit(True)), "panel_bound"))
    return out.select("code", "id")


def release_issues(rows: DataFrame) -> DataFrame:
    """(code, id) of the evidence that models of a custom registry lack for a release."""
    resolved = "endpoint_verified_resolved_model"
    strict = F.col("model_identity_policy") == "strict"
    eligible = F.col("pcq_eligible")
    return rows.select(
        F.explode(
            T.codes(
                (F.col("operational_status") != "verified", "not_operationally_verified"),
                (~given("endpoint_verified_at"), "endpoint_not_verified"),
                (~given(resolved), "resolved_model_missing"),
                (given(resolved) & ~strict, "identity_not_strict"),
                (given(resolved) & strict & (T.identity(F.col(resolved)) != T.identity(F.col("provider_model"))), "resolved_another_model"),
                (eligible & ~given("pcq_cutoff"), "no_cutoff"),
                (eligible & ~F.col("cutoff_evidence_status").isin(*RELEASE_EVIDENCE), "cutoff_not_release_verified"),
                (eligible & ~F.coalesce(F.col("cutoff_source_type").isin(*RELEASE_SOURCES), F.lit(False)), "cutoff_source_not_authoritative"),
            )
        ).alias("code"),
        F.col("name").alias("id"),
    )


def reference_release_issues(rows: DataFrame, verified: list[str] | None, status: str | None) -> DataFrame:
    """(code, id) of the evidence that models of a reference panel lack for a release; verified: the names in its scope."""
    attested = F.coalesce(F.col("cutoff_source_type") == "named_human_attestation", F.lit(False))
    inside = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    resolved = F.col("endpoint_verified_resolved_model")
    out = rows.select(
        F.explode(
            T.codes(
                (~F.col("name").isin(*(verified or [])), "outside_release_scope"),
                (~given("pcq_cutoff"), "no_cutoff"),
                (~inside("cutoff_definition", DEFINITIONS), "cutoff_definition_missing"),
                (~inside("cutoff_evidence_status", RELEASE_EVIDENCE), "cutoff_not_release_verified"),
                (~inside("cutoff_source_type", RELEASE_SOURCES), "cutoff_source_not_authoritative"),
                (attested & ~inside("cutoff_attestation_status", ("completed",)), "attestation_incomplete"),
                (attested & ~given("cutoff_attestation_path"), "attestation_path_missing"),
                (attested & ~given("cutoff_attestation_reviewer"), "attestation_reviewer_missing"),
                (attested & ~F.col("pcq_cutoff_is_conservative_upper_bound"), "attested_cutoff_not_upper_bound"),
                (~attested & ~F.coalesce(F.col("cutoff_source_url").rlike("^https?://"), F.lit(False)), "cutoff_source_url_missing"),
                (~inside("cutoff_precision", PRECISIONS), "cutoff_precision_missing"),
                (~given("cutoff_verified_at"), "cutoff_verified_at_missing"),
                (~F.col("pcq_eligible"), "not_eligible"),
                (~given("endpoint_verified_at"), "endpoint_not_verified"),
                (~given("endpoint_verified_resolved_model"), "resolved_model_missing"),
                (given("endpoint_verified_resolved_model") & (T.identity(resolved) != T.identity(F.col("provider_model"))), "resolved_another_model"),
                (F.col("reasoning_mode") != "disabled", "reasoning_enabled"),
                (~given("non_reasoning_verified_at"), "non_reasoning_not_verified"),
                (~F.col("non_reasoning_observed_thinking_tokens").eqNullSafe(0), "thinking_tokens_not_zero"),
                (F.col("operational_status") != "verified", "not_operationally_verified"),
            )
        ).alias("code"),
        F.col("name").alias("id"),
    )
    panel = [c for c, bad in (("panel_not_release_verified", status != "release_verified"), ("release_scope_missing", verified is None)) if bad]
    return out.unionByName(rows.sparkSession.createDataFrame([(c, None) for c in panel], "code string, id string")) if panel else out
