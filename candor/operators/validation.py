"""Validators: tables of issues. Checks of a row are one pass; duplicates and totals are added from small groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import later_occurrence

RELEASE_FIELDS = ("title", "published_at", "retrieved_at", "snapshot_path", "snapshot_sha256")
EVIDENCE_FIELDS = ("source_id", "url", "publisher", "verified_at", "evidence")


def trimmed(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _issues(rows: DataFrame, key: Column, *pairs: tuple[Column, str], severity: str = "error") -> DataFrame:
    return rows.select(key.alias("id"), F.explode(T.codes(*pairs)).alias("code")).withColumn("severity", F.lit(severity))


def _all(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.unionByName(df)
    return first.select("severity", "code", "id")


def content_identity(fields=("category", "subcategory", "question", "document", "correct_answer", "redacted_value")) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(f) for f in fields]), {"ignoreNullFields": "false"}), 256)


# The sizes that a release of factual items has.
RELEASE_ITEMS, RELEASE_SAMPLE, RELEASE_STRATA, RELEASE_STRATUM = 1500, 300, 10, 30


def dataset_issues(
    items: DataFrame, expected_total: int | None = None, expected_per_category: int | None = None, require_evidence: bool = False, norm=T.normalise, require_novelty: bool = False, allow_pending_review: bool = False
) -> DataFrame:
    """Issues (severity, code, id) of benchmark items: pos, question_id, category, question, document, correct_answer,
    redacted_value, qc_passed and source_evidence, an array of structs.

    Where items have them, release_status and qc (a JSON text with passed and checks) are held to the review gates of
    releases and candidates, and with require_novelty temporal_novelty and event_date to the rule of new facts.
    """
    absent = {"release_status": "string", "qc": "string", "temporal_novelty": "struct<status: string, basis: string, claim_became_true_at: string, source_id: string, reviewer_type: string, verified_at: string, evidence: string>", "event_date": "string"}
    items = items.withColumns({c: F.lit(None).cast(t) for c, t in absent.items() if c not in items.columns})
    category = F.upper(trimmed("category"))
    question, document, redacted = trimmed("question"), F.coalesce(F.col("document"), F.lit("")), F.coalesce(F.col("redacted_value"), F.lit(""))
    rows = items.withColumns({"_id": trimmed("question_id"), "_category": category, "_q": norm(question), "_content": content_identity()})
    once = lambda c: later_occurrence([c], "pos")
    rows = rows.withColumns({"_id2": once("_id"), "_q2": once("_q"), "_content2": once("_content")})
    ccq, pcq, known = F.col("_category") == "CCQ", F.col("_category") == "PCQ", F.col("_category").isin(*T.CATEGORIES)
    sourced = F.col("_category").isin("PCQ", "HNQ") & F.lit(require_evidence)
    none = F.coalesce(F.size("source_evidence"), F.lit(0)) <= 0
    good = lambda s: s["url"].rlike("^https?://") & T_given(s["publisher"]) & T_given(s["verified_at"]) & T_given(s["evidence"])
    checks = F.from_json(F.get_json_object("qc", "$.checks"), "map<string,string>")
    failed = ~F.coalesce(F.col("qc_passed"), F.lit(True)) | F.coalesce(F.get_json_object("qc", "$.passed") == "false", F.lit(False))
    pending = T.pending_review(F.col("release_status"), checks) if allow_pending_review else F.lit(False)
    review = T.review_issues(F.col("category"), F.col("release_status"), checks["human_source_review"], checks["independent_secondary_review"])
    evidence_ids = F.transform("source_evidence", lambda x: x["source_id"]) if "source_id" in items.schema["source_evidence"].dataType.elementType.names else F.array().cast("array<string>")
    leak = T.has_phrase(norm(F.replace(document, F.lit(T.REDACTED), F.lit(""))), norm(redacted))
    found = _issues(
        rows,
        F.col("_id"),
        (F.col("_id") == "", "missing_id"),
        ((F.col("_id") != "") & F.col("_id2"), "duplicate_id"),
        (~known, "invalid_category"),
        (T.word_count(question) < 4, "invalid_question"),
        (F.col("_q2"), "duplicate_question"),
        (F.col("_content2"), "duplicate_content"),
        (failed & ~pending, "qc_failed"),
        (ccq & (F.regexp_count(document, F.lit(r"\[REDACTED\]")) != 1), "ccq_redaction_count"),
        (ccq & (redacted == ""), "ccq_missing_redacted_value"),
        (ccq & (redacted != "") & leak, "ccq_answer_leak"),
        (ccq & ~(F.col("correct_answer").eqNullSafe(T.REDACTED)), "ccq_invalid_gold"),
        (pcq & (F.size(T.question_issues(question)) > 0), "pcq_malformed_question"),
        (pcq & (F.size(T.answer_issues(question, F.col("correct_answer"), norm)) > 0), "pcq_unusable_gold"),
        (sourced & none, "missing_source_evidence"),
        (sourced & ~none & ~F.exists("source_evidence", good), "invalid_source_evidence"),
    )
    more = [rows.select(F.explode(review).alias("code"), F.col("_id").alias("id"), F.lit("error").alias("severity")), *_release_sample_issues(rows, checks)]
    if allow_pending_review:
        more.append(_issues(rows, F.col("_id"), (failed & pending, "candidate_human_gate_pending"), severity="warning"))
    if require_novelty:
        novelty = T.novelty_issues(F.col("temporal_novelty"), F.col("event_date"), evidence_ids, None, True)
        more.append(rows.where(pcq).select(F.explode(novelty).alias("code"), F.col("_id").alias("id"), F.lit("error").alias("severity")))
    if expected_total is not None:
        more.append(_issues(items.agg(F.count("*").alias("n")), F.lit(None).cast("string"), (F.col("n") != expected_total, "unexpected_total")))
    if expected_per_category is not None:
        grid = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in T.CATEGORIES])).alias("_category"))
        n = grid.join(rows.groupBy("_category").agg(F.count("*").alias("n")), "_category", "left")
        more.append(_issues(n, F.col("_category"), (F.coalesce(F.col("n"), F.lit(0)) != expected_per_category, "category_imbalance")))
    return _all(found, *more)


def _release_sample_issues(rows: DataFrame, checks: Column) -> list[DataFrame]:
    """The sample that a second reviewer saw, of all factual items that are ready for release: its size and balance."""
    ready = rows.where(F.col("category").isin("PCQ", "HNQ") & (F.col("release_status") == "release_ready"))
    member = F.coalesce(F.get_json_object(checks["independent_secondary_review"], "$.sample_member") == "true", F.lit(False))
    by = ready.groupBy("subcategory").agg(F.count("*").alias("n"), F.sum(F.when(member, 1).otherwise(0)).alias("m"))
    sampled = F.when(F.col("m") > 0, F.col("m"))
    whole = by.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.count(sampled).alias("strata"), F.coalesce(F.bool_and(sampled == RELEASE_STRATUM), F.lit(True)).alias("even"))
    off = F.col("n").isNotNull() & ((F.col("n") != RELEASE_ITEMS) | (F.col("m") != RELEASE_SAMPLE))
    uneven = (F.col("strata") > 0) & ((F.col("strata") != RELEASE_STRATA) | ~F.col("even"))
    return [_issues(whole, F.lit(None).cast("string"), (off, "secondary_review_sample_size"), (uneven, "secondary_review_stratum_balance"))]


def T_given(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) != ""


def ledger_issues(
    facts: DataFrame, window: tuple[str, str] | None, expected_total: int | None = None, expected_per_subcategory: int | None = None, release: bool = False, norm=T.normalise, subcategories: list[str] | None = None
) -> DataFrame:
    """Issues (severity, code, id, other_id) of a fact ledger: pos, fact_id, subcategory, event_date, question_target,
    gold_answer, source_evidence, and for releases temporal_novelty and verification."""
    rows = facts.withColumns({"_id": trimmed("fact_id"), "_sub": trimmed("subcategory"), "_gold": trimmed("gold_answer"), "_target": trimmed("question_target")})
    rows = rows.withColumns({"_t": norm(F.col("_target")), "_g": norm(F.col("_gold")), "_lower": F.lower("_sub")})
    from pyspark.sql import Window

    first = F.first(F.struct("_id", "_g")).over(Window.partitionBy("_t").orderBy("pos"))
    rows = rows.withColumns({"_id2": later_occurrence(["_id"], "pos"), "_atom2": later_occurrence(["_lower", "_t", "_g"], "pos"), "_t2": later_occurrence(["_t"], "pos"), "_first": first})
    start = F.split(F.coalesce(F.col("event_date"), F.lit("")), "/")[0]
    day = F.when(start.rlike(r"^\d{4}-\d\d-\d\d$"), F.try_to_date(start))
    w = (F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")) if window else None
    none = F.coalesce(F.size("source_evidence"), F.lit(0)) <= 0
    again = (F.col("_t") != "") & F.col("_t2")
    pairs = [
        (F.col("_id") == "", "missing_fact_id"),
        ((F.col("_id") != "") & F.col("_id2"), "duplicate_fact_id"),
        (F.col("_sub") == "", "missing_subcategory"),
        ((F.col("_gold") == "") | (F.col("_target") == ""), "missing_gold_or_target"),
        (F.size(T.answer_issues(F.col("_target"), F.col("_gold"), norm)) > 0, "pcq_unusable_gold"),
        (F.col("_atom2"), "duplicate_atomic_fact"),
        (again, "duplicate_question_target"),
        (again & (F.col("_g") != F.col("_first._g")), "conflicting_question_target_gold"),
        (none, "missing_evidence"),
    ]
    if w:
        pairs += [(day.isNotNull() & ~day.between(*w), "event_outside_window"), (day.isNull(), "invalid_event_date")]
    if release:
        v = F.col("verification")
        absent = ~(T_given(v["status"]) & T_given(v["reviewer_type"]) & T_given(v["verified_at"]))
        pairs += [(v.isNull(), "missing_verification"), (v.isNotNull() & absent, "incomplete_verification"), (v.isNotNull() & ~F.coalesce(v["status"].isin("source-verified", "human-verified"), F.lit(False)), "invalid_verification_status")]
    other = F.when(again, F.col("_first._id"))
    out = rows.select(F.lit("error").alias("severity"), F.explode(T.codes(*pairs)).alias("code"), F.col("_id").alias("id"), other.alias("other_id"))
    out = out.withColumn("other_id", F.when(F.col("code").isin("duplicate_question_target", "conflicting_question_target_gold"), F.col("other_id")))
    each = rows.select("_id", F.explode("source_evidence").alias("s"))
    complete = F.lit(True)
    for f in EVIDENCE_FIELDS:
        complete = complete & T_given(F.col(f"s.{f}"))
    marks = [(~complete, "incomplete_evidence"), (complete & ~F.col("s.url").rlike("^https?://"), "invalid_evidence_url")]
    if release:
        full = F.lit(True)
        for f in RELEASE_FIELDS:
            full = full & T_given(F.col(f"s.{f}"))
        marks += [(~full, "incomplete_release_evidence"), (T_given(F.col("s.snapshot_sha256")) & ~F.lower("s.snapshot_sha256").rlike("^[0-9a-f]{64}$"), "invalid_snapshot_sha256")]
    blank = F.lit(None).cast("string").alias("other_id")
    out = out.unionByName(each.select(F.lit("error").alias("severity"), F.explode(T.codes(*marks)).alias("code"), F.col("_id").alias("id"), blank))
    if release:
        ids = F.transform("source_evidence", lambda s: s["source_id"])
        novelty = T.novelty_issues(F.col("temporal_novelty"), F.col("event_date"), ids, w, True)
        out = out.unionByName(rows.select(F.lit("error").alias("severity"), F.explode(novelty).alias("code"), F.col("_id").alias("id"), blank))
    if not w:
        out = out.unionByName(facts.sparkSession.range(1).select(F.lit("error").alias("severity"), F.lit("invalid_event_window").alias("code"), F.lit(None).cast("string").alias("id"), blank))
    if expected_total is not None:
        n = facts.agg(F.count("*").alias("n")).where(F.col("n") != expected_total)
        out = out.unionByName(n.select(F.lit("error").alias("severity"), F.lit("unexpected_total").alias("code"), F.lit(None).cast("string").alias("id"), blank))
    if subcategories is not None:
        n = rows.where((F.col("_sub") != "") & ~F.col("_sub").isin(*subcategories)).select("_sub").distinct()
        out = out.unionByName(n.select(F.lit("error").alias("severity"), F.lit("unexpected_subcategory").alias("code"), F.col("_sub").alias("id"), blank))
    if expected_per_subcategory is not None:
        n = rows.groupBy("_sub").agg(F.count("*").alias("n")).where(F.col("n") != expected_per_subcategory)
        out = out.unionByName(n.select(F.lit("error").alias("severity"), F.lit("subcategory_imbalance").alias("code"), F.col("_sub").alias("id"), blank))
    return out


def snapshot_issues(items: DataFrame, files: DataFrame) -> DataFrame:
    """(severity, code, id, source_id): snapshots of evidence that files (path, sha256) lack or have with other contents."""
    s = items.select(F.col("question_id").alias("id"), F.explode("source_evidence").alias("s")).where(T_given(F.col("s.snapshot_path")))
    x = s.select("id", "s.source_id", F.col("s.snapshot_path").alias("path"), F.lower(F.coalesce("s.snapshot_sha256", F.lit(""))).alias("_want")).join(files.select("path", F.col("sha256").alias("_have")), "path", "left")
    code = F.when(F.col("_have").isNull(), "snapshot_missing").when(F.col("_have") != F.col("_want"), "snapshot_hash_mismatch")
    return x.select(F.lit("error").alias("severity"), code.alias("code"), "id", "source_id").where("code is not null")


def ledger_join_issues(items: DataFrame, facts: DataFrame) -> DataFrame:
    """Items against the ledger's facts: missing ones and fields that differ.

    Where items have ledger_fact_sha256 and facts sha256, the hash of a fact's canonical JSON, these are compared too.
    """
    if "sha256" in facts.columns and "ledger_fact_sha256" in items.columns:
        hashes = items.select("question_id", F.col("ledger_fact_sha256").alias("_own")).join(facts.select(F.col("fact_id").alias("question_id"), F.col("sha256").alias("_of")), "question_id")
        return _all(ledger_join_issues(items.drop("ledger_fact_sha256"), facts), _issues(hashes, F.col("question_id"), (~F.col("_own").eqNullSafe(F.col("_of")), "ledger_fact_hash_mismatch")))
    f = facts.select(F.col("fact_id").alias("question_id"), F.lit(True).alias("_there"), F.col("subcategory").alias("_sub"), F.col("event_date").alias("_date"), F.col("gold_answer").alias("_gold"))
    x = items.join(f, "question_id", "left")
    there = F.col("_there").isNotNull()
    return _all(
        _issues(
            x,
            F.col("question_id"),
            (~there, "missing_ledger_fact"),
            (there & ~F.col("subcategory").eqNullSafe(F.col("_sub")), "subcategory_mismatch"),
            (there & ~F.col("event_date").eqNullSafe(F.col("_date")), "event_date_mismatch"),
            (there & ~F.col("correct_answer").eqNullSafe(F.col("_gold")), "gold_answer_mismatch"),
        )
    )


def attempts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(how many items took how many attempts, totals of tokens, exact cost and errors) of generation attempts."""
    n = rows.groupBy("question_id").agg(F.count("*").alias("attempts")).groupBy("attempts").agg(F.count("*").alias("items"))
    total = rows.agg(
        F.count("*").alias("n_attempts"), F.sum(F.col("tokens").try_cast("long")).alias("tokens"), F.sum(F.col("cost").try_cast("decimal(38,18)")).alias("cost"),
        F.count(F.col("cost").try_cast("decimal(38,18)")).alias("n_priced"), F.sum(F.when(F.col("cache_hit"), 1).otherwise(0)).cast("long").alias("cache_hits"), F.count("error_type").alias("n_errors"),
    )
    return n, total


def first_copies(items: DataFrame, key: list[str], item_id: str, pos: str = "pos") -> DataFrame:
    """Items with `duplicate_of`: the first item with the same key, null for that one itself."""
    from pyspark.sql import Window

    first = F.first(item_id).over(Window.partitionBy(*key).orderBy(pos))
    return items.withColumn("duplicate_of", F.when(later_occurrence(key, pos), first))
