"""Records from recorded replies, probes of capability, checks of a route, and corpus gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import neardup, scoring, validation


def evaluate(grid: DataFrame, replies: DataFrame, tolerance: float = 0.0, adjudication: DataFrame | None = None, norm=T.normalise) -> DataFrame:
    """Facts of items x models (model, question_id, category, correct_answer, ...) and their recorded replies.

    replies: model, question_id, answer_ok, answer, confidence_ok, reply, error_type. An answer that didn't come is
    a technical failure; a confidence that can't be read is final, since it came.
    """
    x = grid.join(replies, ["model", "question_id"], "left")
    human = F.lit(None).cast("string")
    if adjudication is not None:
        x = x.join(adjudication.select("model", "question_id", F.col("label").alias("_human")), ["model", "question_id"], "left")
        human = F.col("_human")
    came = F.coalesce(F.col("answer_ok"), F.lit(False)) & ~T.blank(F.col("answer"))
    answers = T.gold_answers(F.col("correct_answer"), F.col("acceptable_answers"), F.array().cast("array<string>"))
    correct = T.matches_gold(F.col("category"), F.col("answer"), answers, tolerance, norm)
    cls = F.when(came, T.classification(F.col("answer"), correct, human))
    conf = T.confidence(F.col("reply"))
    rated = came & F.coalesce(F.col("confidence_ok"), F.lit(False)) & conf["value"].isNotNull()
    return x.select(
        "model", "question_id", "category", "subcategory", "k", came.alias("answered"), rated.alias("rated"), (came & T.confidence_is_final(F.coalesce(F.col("confidence_ok"), F.lit(False)), conf["value"], F.col("error_type"))).alias("terminal"),
        F.when(rated, conf["value"]).alias("confidence"), cls["label"].alias("label"), cls["is_correct"].alias("is_correct"), "answer",
    )


def offline_replies(grid: DataFrame) -> DataFrame:
    """The fixed replies of a model that never answers."""
    return grid.select("model", "question_id", F.lit(True).alias("answer_ok"), F.lit("I do not know. I cannot answer this question reliably.").alias("answer"), F.lit(True).alias("confidence_ok"), F.lit("0").alias("reply"), F.lit(None).cast("string").alias("error_type"))


def prompts(items: DataFrame) -> DataFrame:
    """The text to send: a document with its question, or the question."""
    whole = F.concat(F.lit("Document:\n"), F.col("document"), F.lit("\n\nQuestion: "), F.col("question"))
    return items.withColumn("prompt", F.when(F.col("category") == "CCQ", whole).otherwise(F.col("question")))


def reclassify(records: DataFrame, items: DataFrame, norm=T.normalise) -> DataFrame:
    """Retained answers under the present rules; a record without its item is an error."""
    known = items.select("question_id", "correct_answer", "acceptable_answers", F.lit(True).alias("_item"))
    x = records.join(known, "question_id", "left")
    checked = F.when(F.col("_item").isNull(), F.raise_error(F.concat(F.lit("no item "), F.col("question_id"))).cast("boolean")).otherwise(F.col("answered"))
    correct = T.matches_gold(F.col("category"), F.col("answer"), T.gold_answers(F.col("correct_answer"), F.col("acceptable_answers"), F.array().cast("array<string>")), norm=norm)
    cls = F.when(checked, T.classification(F.col("answer"), correct))
    return x.withColumn("_c", cls).withColumns({"label": F.col("_c.label"), "is_correct": F.col("_c.is_correct")}).select(records.columns)


def probe_items(items: DataFrame, most_words: int = 4, norm=T.normalise) -> DataFrame:
    """Items with a withheld span, and `skip_reason`, null for those whose span can be put back."""
    ccq = items.where(F.upper("category") == "CCQ")
    skip = T.restore_skip(F.col("document"), F.col("question"), F.col("redacted_value"), most_words, norm)
    return ccq.withColumn("skip_reason", skip).withColumn("restored", F.when(F.col("skip_reason").isNull(), T.restored(F.col("document"), F.col("redacted_value"))))


def capability_scores(probe: DataFrame) -> DataFrame:
    """Share of correct answers among those that came, by model; a model without any is an error."""
    by = probe.groupBy("model").agg(F.count("*").alias("n_items"), scoring.counted(F.col("scored")).alias("n_scored"), scoring.counted(F.col("scored") & F.col("is_correct")).alias("n_correct"))
    score = F.when(F.col("n_scored") > 0, F.round(F.col("n_correct") / F.nullif(F.col("n_scored"), F.lit(0)), 6)).otherwise(F.raise_error(F.concat(F.lit("every probe failed for "), F.col("model"))).cast("double"))
    return by.withColumn("n_technical_failures", F.col("n_items") - F.col("n_scored")).withColumn("capability_score", score)


def route_assessment(recorded: DataFrame, least_valid: float = 0.95, least_confidence: float = 0.95) -> DataFrame:
    """Coverage and identity of each model's route from nested records, and why it fails."""
    each = recorded.select("model", F.explode(F.array("answer_response", "confidence_response")).alias("r")).where("r.ok").withColumn("_tokens", T.reasoning_tokens(F.col("r.usage")))
    routes = each.groupBy("model").agg(F.count("*").alias("n_calls"), F.collect_set("r.requested_model").alias("requested"), F.collect_set("r.resolved_model").alias("resolved"), F.coalesce(F.max("_tokens"), F.lit(0)).alias("max_reasoning_tokens"))
    valid, rated = F.coalesce(F.col("answer_valid"), F.lit(False)), F.coalesce(F.col("confidence_valid"), F.lit(False))
    cover = recorded.groupBy("model").agg(F.count("*").alias("n_records"), F.avg(valid.cast("double")).alias("valid_rate"), F.coalesce(F.avg(F.when(valid, rated.cast("double"))), F.lit(0.0)).alias("confidence_rate"))
    x = cover.join(routes, "model", "left")
    failures = T.codes(
        (F.size("requested") != 1, "several_routes_requested"),
        ((F.size("resolved") != 1) | (F.array_sort("requested") != F.array_sort("resolved")), "route_not_exact"),
        (F.col("valid_rate") < least_valid, "low_valid_coverage"),
        (F.col("confidence_rate") < least_confidence, "low_confidence_coverage"),
        (F.col("max_reasoning_tokens") > 0, "reasoning_tokens_reported"),
    )
    return x.withColumn("failures", failures).withColumn("verified", F.size("failures") == 0)


def uncertainty_agreement(pairs: DataFrame) -> DataFrame:
    """Counts and agreement of two coders' uncertainty flags (a, b of 0, 1 or null)."""
    from .agreement import kappa

    both = pairs.where("a is not null and b is not null")
    flag = lambda c: F.col(c) == "1"
    n = pairs.agg(F.count("a").alias("a_completed"), scoring.counted(flag("a")).alias("a_uncertain"), F.count("b").alias("b_completed"), scoring.counted(flag("b")).alias("b_uncertain"), scoring.counted(F.col("a").isNotNull() & F.col("b").isNotNull() & (flag("a") | flag("b"))).alias("either"), scoring.counted(flag("a") & flag("b")).alias("both"))
    return n.crossJoin(F.broadcast(kappa(both, "a", "b").select(F.col("n").alias("n_paired"), "observed", "kappa")))


def composite_under_labels(facts: DataFrame, human: str) -> DataFrame:
    """Composites with recorded and with human labels, where a human label also says what is correct."""
    keep = facts.where(F.col(human).isNotNull())
    a = scoring.scores(keep).select("model", F.col("composite").alias("recorded"))
    b = scoring.scores(keep.withColumn("label", F.col(human)).withColumn("is_correct", F.col(human) == "CONFIDENT_CORRECT")).select("model", F.col("composite").alias("under_human"))
    return a.join(b, "model").withColumn("difference", F.col("under_human") - F.col("recorded"))


def label_leakage(facts: DataFrame, human: str) -> DataFrame:
    """Records read as restraint that humans read as answers, and their share of each pool."""
    restraint = F.col("label").isin("ABSTAIN", "HEDGE")
    answered = ~F.col(human).isin("ABSTAIN", "HEDGE")
    c = facts.where(F.col(human).isNotNull()).agg(scoring.counted(restraint).alias("n_restraint"), scoring.counted(restraint & answered).alias("n_leaked"), scoring.counted(answered).alias("n_answered"))
    return c.withColumn("leak_rate", scoring.ratio(F.col("n_leaked"), F.col("n_restraint"))).withColumn("pool_share", scoring.ratio(F.col("n_leaked"), F.col("n_answered")))


def corpus_audit(items: DataFrame, question_least: float = 0.88, gram_least: float = 0.40, per_subcategory: int | None = None, document_least: float = 0.82, norm=T.normalise) -> DataFrame:
    """One row: whether a corpus of documents with withheld spans passes, and the counts behind it."""
    issues = validation.dataset_issues(items, norm=norm).where("severity = 'error'")
    docs = items.select(F.col("pos").alias("id"), norm(F.col("document")).alias("norm"))
    near_docs = neardup.document_pairs(docs, document_least, gram_least)
    near_questions = neardup.similar_questions(items.select("pos", norm(F.col("question")).alias("text")), question_least)
    words = T.word_count(F.col("document"))
    stats = items.agg(F.count("*").alias("n_items"), F.min(words).alias("least_words"), F.max(words).alias("most_words"), F.round(F.avg(words), 3).alias("mean_words"), F.median(words).alias("median_words"))
    sizes = items.groupBy("subcategory").agg(F.count("*").alias("n"))
    balanced = sizes.agg(F.coalesce(F.bool_and(F.col("n") == (per_subcategory if per_subcategory is not None else F.col("n"))), F.lit(per_subcategory is None)).alias("balanced"))
    one = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    x = stats.crossJoin(F.broadcast(balanced)).crossJoin(one(issues, "n_issues")).crossJoin(one(neardup.repeated_values(items, "redacted_value", "pos"), "n_repeated_values"))
    x = x.crossJoin(one(near_questions, "n_near_questions")).crossJoin(one(near_docs, "n_near_documents"))
    return x.withColumn("passed", F.col("balanced") & (F.col("n_issues") + F.col("n_repeated_values") + F.col("n_near_questions") + F.col("n_near_documents") == 0))


def ledger_audit(items: DataFrame, facts: DataFrame, window: tuple[str, str], question_least: float = 0.96, per_subcategory: int | None = None, norm=T.normalise) -> DataFrame:
    """One row: whether items agree with their ledger, and the counts behind it."""
    used = facts.join(items.select(F.col("question_id").alias("fact_id")).distinct(), "fact_id", "left_semi")
    count = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))
    span = used.agg(F.count("*").alias("n_facts"), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"))
    x = span.crossJoin(count(validation.ledger_issues(used, window, norm=norm), "n_ledger_issues")).crossJoin(count(validation.ledger_join_issues(items, facts), "n_mismatches"))
    x = x.crossJoin(count(neardup.similar_questions(items.select("pos", norm(F.col("question")).alias("text")), question_least), "n_near_questions"))
    off = items.groupBy("subcategory").agg(F.count("*").alias("n")).where(F.lit(per_subcategory is not None) & (F.col("n") != (per_subcategory or 0)))
    x = x.crossJoin(count(off, "n_unbalanced"))
    return x.withColumn("passed", F.col("n_ledger_issues") + F.col("n_mismatches") + F.col("n_near_questions") + F.col("n_unbalanced") == 0)


def evidence_histograms(facts: DataFrame) -> DataFrame:
    """How many facts each publisher and source supports."""
    s = facts.select("fact_id", F.explode("source_evidence").alias("s"))
    return s.groupBy("s.publisher", "s.source_id").agg(F.countDistinct("fact_id").alias("n_facts"))


def canonical_items(legacy: DataFrame) -> DataFrame:
    """Items of an old layout: category in capitals, an explicit answer for what doesn't exist, evidence structs."""
    source = F.col("answer_source")
    evidence = F.when(~T.blank(source), F.array(F.struct(F.concat(F.lit("legacy::"), "question_id").alias("source_id"), F.when(source.startswith("http"), source).otherwise("").alias("url"), F.lit("legacy-source").alias("publisher"), F.lit("legacy-import").alias("verified_at"), source.alias("evidence"))))
    category = F.upper(F.coalesce("category", F.lit("")))
    answer = F.coalesce("correct_answer", F.lit(""))
    return legacy.select("pos", "question_id", category.alias("category"), F.coalesce(F.nullif("subcategory", F.lit("")), category).alias("subcategory"), F.trim("question").alias("question"), F.when((category == "FEQ") & (answer == ""), "[DOES_NOT_EXIST]").otherwise(answer).alias("correct_answer"), F.lit(0).alias("expected_knowability"), evidence.alias("source_evidence"))


def obscurity_screen(votes: DataFrame) -> DataFrame:
    """Items that at most one of three screeners knows count as unknown; rates by subcategory and what is accepted."""
    item = votes.groupBy("subcategory", "question_id").agg(F.count("*").alias("votes"), scoring.counted(F.col("correct")).alias("knew"))
    by = item.groupBy("subcategory").agg(F.count("*").alias("n"), F.avg((F.col("votes") == 3).cast("double")).alias("complete_rate"), F.avg(F.when(F.col("votes") == 3, (F.col("knew") <= 1).cast("double"))).alias("unknown_rate"))
    return by.withColumn("accepted", (F.col("complete_rate") >= 0.95) & (F.col("unknown_rate") >= 0.70))
