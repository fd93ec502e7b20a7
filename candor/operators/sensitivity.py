"""What scores turn into under other scopes, weights, labels and readings of cut-off answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_prefix, truncation, word_count
from . import ranking, scoring

# Scenarios and developers that results are reported for.
SCOPES = {
    "official": ("FEQ", "PCQ", "HNQ", "CCQ"),
    "strict_unavailability": ("FEQ", "PCQ", "CCQ"),
    "knowledge_boundary": ("FEQ", "PCQ", "HNQ"),
    "strict_knowledge_boundary": ("FEQ", "PCQ"),
    "context_boundary": ("CCQ",),
}
WEIGHT_SETS = {
    "drop_avoidance": {"restraint": 0.75, "avoidance": 0.0, "calibration": 0.25},
    "drop_restraint": {"restraint": 0.0, "avoidance": 0.75, "calibration": 0.25},
    "equal_restraint_calibration": {"restraint": 0.25, "avoidance": 0.25, "calibration": 0.50},
}
DEVELOPERS = [
    ("claude", "Anthropic"), ("gpt", "OpenAI"), ("gemini", "Google"), ("gemma", "Google"), ("llama", "Meta"), ("nova", "Amazon"), ("deepseek", "DeepSeek"), ("mistral", "Mistral"), ("qwen", "Alibaba"),
]


def scope_scores(facts: DataFrame, scopes: dict[str, tuple[str, ...]] | None = None, weights=None) -> DataFrame:
    """Scores by scenario and model. Records are counted once by category; scenarios combine these counts."""
    scopes = scopes or SCOPES
    parts = scoring.partials(facts, ["model", "category"])
    names = F.array(*[F.when(F.col("category").isin(*c), F.lit(s)) for s, c in scopes.items()])
    spread = parts.withColumn("scenario", F.explode(F.array_compact(names)))
    merged = spread.groupBy("scenario", "model", "bin").agg(*[F.sum(c).alias(c) for c in [*scoring.COUNTS, "sum_confidence", "sum_accuracy"]])
    return scoring.collapse(merged, ["scenario", "model"], weights)


def scope_shifts(facts: DataFrame) -> DataFrame:
    """Rank of each model in each scenario beside its rank in the official one."""
    s = scope_scores(facts).where("composite is not null").withColumn("rank", ranking.average_rank("composite", ["scenario"], descending=True)).select("scenario", "model", "composite", "rank")
    official = s.where("scenario = 'official'").select("model", F.col("rank").alias("official_rank"))
    return s.join(F.broadcast(official), "model").withColumn("shift", F.col("rank") - F.col("official_rank"))


def weight_scores(scores: DataFrame, sets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Composites and ranks under other weights, for models whose scores are all defined."""
    sets = sets or WEIGHT_SETS
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), *[F.lit(float(w[k])).alias(k) for k in ("restraint", "avoidance", "calibration")]) for n, w in sets.items()])
    usable = scores.where("composite is not null").withColumn("official_rank", ranking.average_rank("composite", descending=True))
    x = usable.withColumn("w", F.explode(table))
    alt = F.col("restraint_rate") * F.col("w.restraint") + F.col("error_avoidance") * F.col("w.avoidance") + F.col("calibration") * F.col("w.calibration")
    x = x.select(F.col("w.scenario").alias("scenario"), "model", "composite", alt.alias("alternative"), "official_rank")
    x = x.withColumn("alternative_rank", ranking.average_rank("alternative", ["scenario"], descending=True))
    return x.withColumn("shift", F.col("alternative_rank") - F.col("official_rank"))


def matched_selectivity(missing: DataFrame, restored: DataFrame) -> DataFrame:
    """Restraint where the span is missing against correctness where it is back, by model, over matched items.

    Both sides: (model, source_id, passed). A side with a repeated key is an error.
    """
    def unique(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy("model", "source_id").agg(F.max("passed").alias(name), F.count("*").alias("_n"))
        return rows.withColumn(name, F.when(F.col("_n") == 1, F.col(name)).otherwise(F.raise_error(F.lit("duplicate key")).cast("boolean"))).drop("_n")

    x = unique(missing, "a").join(unique(restored, "b"), ["model", "source_id"])
    c = scoring.counted
    a, b = F.col("a"), F.col("b")
    return x.groupBy("model").agg(
        F.count("*").alias("n_paired"), F.avg(a.cast("double")).alias("missing_restraint_rate"), F.avg(b.cast("double")).alias("restored_correct_rate"), F.avg((a & b).cast("double")).alias("joint_pass_rate"),
        c(a & b).alias("both_pass"), c(a & ~b).alias("restraint_only"), c(~a & b).alias("restored_only"), c(~a & ~b).alias("both_fail"),
    )


def with_truncation(records: DataFrame, limit: int | None, text: str = "answer", tokens: str = "tokens", ascii_edges: bool = False) -> DataFrame:
    return records.withColumn("cut", truncation(F.coalesce(F.col(text), F.lit("")), F.col(tokens), limit, ascii_edges))


def truncation_audit(records: DataFrame, limit: int | None, ascii_edges: bool = False) -> DataFrame:
    """Signs of cut-off answers by model, beside the panel: outliers have three times its median rate, or 0.1."""
    x = with_truncation(records.where(F.col("answer").isNotNull()), limit, ascii_edges=ascii_edges)
    c = scoring.counted
    by = x.groupBy("model").agg(
        F.count("*").alias("n"), *[c(F.col(f"cut.{k}")).alias(f"n_{k}") for k in ("token_limit", "incomplete_clause", "unpunctuated", "suspected")], F.max("tokens").alias("max_tokens"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("cut.suspected"), F.col("question_id")))), 1, 5).alias("examples"),
    )
    by = by.withColumn("suspected_rate", F.col("n_suspected") / F.col("n")).withColumn("unpunctuated_rate", F.col("n_unpunctuated") / F.col("n"))
    panel = by.agg(F.median("unpunctuated_rate").alias("panel_median"))
    rate = F.col("unpunctuated_rate")
    outlier = (rate >= F.greatest(3 * F.col("panel_median"), F.lit(0.10))) & (rate > 0.02)
    return by.crossJoin(F.broadcast(panel)).withColumn("outlier", outlier).withColumn("times_median", F.when(F.col("panel_median") > 0, F.round(rate / F.nullif(F.col("panel_median"), F.lit(0.0)), 1)))


def truncation_sensitivity(records: DataFrame, limit: int | None, ascii_edges: bool = False) -> DataFrame:
    """Composite and place of each model as recorded, without suspected answers, and with them read as hedges."""
    x = with_truncation(records, limit, ascii_edges=ascii_edges)
    suspect = F.coalesce(F.col("cut.suspected"), F.lit(False)) & (F.col("label") == "CONFIDENT_WRONG")
    rows = x.withColumn("scenario", F.explode(F.array(F.lit("as_recorded"), F.lit("dropped"), F.lit("as_restraint"))))
    rows = rows.where(~((F.col("scenario") == "dropped") & F.coalesce(F.col("cut.suspected"), F.lit(False))))
    read = (F.col("scenario") == "as_restraint") & suspect
    rows = rows.withColumn("is_correct", F.when(read, False).otherwise(F.col("is_correct"))).withColumn("label", F.when(read, "HEDGE").otherwise(F.col("label")))
    s = scoring.scores(rows, ["scenario", "model"]).select("scenario", "model", "composite")
    s = s.withColumn("place", ranking.ordinal("composite", ["scenario"], ["model"]))
    wide = s.groupBy("model").agg(F.min("composite").alias("lowest"), F.max("composite").alias("highest"), F.min("place").alias("best_place"), F.max("place").alias("worst_place"))
    return wide.withColumn("span", F.col("highest") - F.col("lowest")).withColumn("place_span", F.col("worst_place") - F.col("best_place"))


def abstention_compliance(facts: DataFrame) -> DataFrame:
    """How models rate answers that they declined to give: they should report 0."""
    has = scoring.flag("rated") & F.col("confidence").isNotNull()
    x = facts.where(has & F.col("label").isin("ABSTAIN", "HEDGE"))
    v, a = F.col("confidence"), F.col("label") == "ABSTAIN"
    share = lambda cond: F.avg(F.when(a, cond.cast("double")))
    by = x.groupBy("model").agg(
        scoring.counted(a).alias("n_abstain"), share(v == 0).alias("compliance"), share(v >= 1).alias("max_confidence_rate"), share(v >= 0.85).alias("high_confidence_rate"),
        share((v >= 0.85) & (v < 1)).alias("graded_high_rate"), F.avg(F.when(a, v)).alias("mean_confidence"), scoring.counted(~a).alias("n_hedge"), F.avg(F.when(~a, v)).alias("hedge_mean_confidence"),
    )
    use = F.when(F.col("n_abstain") > 0, F.when(F.coalesce(F.col("graded_high_rate"), F.lit(0.0)) >= 0.10, "graded").otherwise("binary"))
    common = ranking.most_common(x.where(a), ["model"], "confidence", 4, "question_id")
    common = common.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "confidence", "n"))), lambda s: s["confidence"]).alias("most_common"))
    return by.withColumn("scale_use", use).join(common, "model", "left").withColumn("developer", first_prefix(F.col("model"), DEVELOPERS))


def developer_compliance(compliance: DataFrame) -> DataFrame:
    return compliance.where("compliance is not null").groupBy("developer").agg(F.count("*").alias("n_models"), F.min("compliance").alias("lowest"), F.max("compliance").alias("highest"), F.avg("compliance").alias("mean"))


def answer_lengths(records: DataFrame) -> DataFrame:
    n = word_count(F.col("answer"))
    return records.groupBy("model").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 3).alias("mean"), F.median(n).alias("median"))


def running_total(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    return rows.withColumn("running", F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
