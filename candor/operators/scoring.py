"""Component scores of evaluation records, in one shuffle of additive counts.

`facts` has one row for each (model, question): model, question_id, category, subcategory, k (1: out of scope),
answered (the answer came), rated (a usable confidence came), terminal (no confidence, and none to be had),
confidence, label, is_correct. Null flags count as false, a null k as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS

WEIGHTS = {"restraint": 0.30, "avoidance": 0.45, "calibration": 0.25}
SUBSTANTIVE = ("CONFIDENT_CORRECT", "CONFIDENT_WRONG")
RESTRAINT = ("ABSTAIN", "HEDGE")


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def in_scope() -> Column:
    return F.coalesce(F.col("k"), F.lit(0)) == 0


def scorable() -> Column:
    return in_scope() & flag("answered") & F.col("label").isNotNull()


def has_confidence() -> Column:
    return scorable() & flag("rated") & F.col("confidence").isNotNull()


def substantive() -> Column:
    return has_confidence() & F.col("label").isin(*SUBSTANTIVE)


def retryable() -> Column:
    return in_scope() & ~flag("rated") & ~flag("terminal")


def terminal_missing() -> Column:
    return in_scope() & flag("answered") & flag("terminal")


def technical_failure() -> Column:
    return ~flag("answered")


def bin_of(confidence: Column, n_bins: int = 10) -> Column:
    """Number of the interval [b/n, (b+1)/n) that holds a confidence, the last one closed; -1 outside of [0, 1]."""
    b = F.floor(confidence * n_bins).cast("int")
    b = F.when((b + 1) / F.lit(float(n_bins)) <= confidence, b + 1).when(b / F.lit(float(n_bins)) > confidence, b - 1).otherwise(b)
    return F.when((confidence < 0) | (confidence > 1), F.lit(-1)).otherwise(F.least(b, F.lit(n_bins - 1)))


def counted(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def partials(facts: DataFrame, keys: list[str], n_bins: int = 10, mask: Column | None = None) -> DataFrame:
    """Additive counts for each key and confidence bin; all that scores need."""
    sub = substantive() if mask is None else mask
    return (
        facts.withColumn("_bin", F.when(sub, bin_of(F.col("confidence"), n_bins)))
        .groupBy(*keys, F.col("_bin").alias("bin"))
        .agg(
            F.count("*").alias("n_input"),
            counted(scorable()).alias("n_scorable"),
            counted(has_confidence()).alias("n_confidence"),
            counted(sub).alias("n_calibration"),
            counted(terminal_missing()).alias("n_terminal_missing"),
            counted(retryable()).alias("n_retryable"),
            counted(technical_failure()).alias("technical_failures"),
            counted(~in_scope()).alias("n_out_of_scope"),
            *[counted(scorable() & (F.col("label") == x)).alias(f"n_{x.lower()}") for x in LABELS],
            F.sum(F.when(sub, F.col("confidence"))).alias("sum_confidence"),
            F.sum(F.when(sub & F.coalesce(F.col("is_correct"), F.lit(False)), 1.0).when(sub, 0.0)).alias("sum_accuracy"),
        )
    )


COUNTS = ["n_input", "n_scorable", "n_confidence", "n_calibration", "n_terminal_missing", "n_retryable", "technical_failures", "n_out_of_scope", *(f"n_{x.lower()}" for x in LABELS)]


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def collapse(parts: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Scores from partials of these keys and bins. Undefined scores stay null."""
    w = weights or WEIGHTS
    gap = F.when(F.col("bin") >= 0, F.abs(F.col("sum_accuracy") - F.col("sum_confidence")))
    out = parts.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS], F.sum(gap).alias("_gap"))
    n = F.col("n_scorable")
    out = out.withColumn("ece", F.when(F.col("n_calibration") > 0, F.coalesce(F.col("_gap"), F.lit(0.0)) / F.col("n_calibration"))).drop("_gap")
    out = (
        out.withColumn("n_missing_confidence", n - F.col("n_confidence"))
        .withColumn("confidence_coverage", ratio(F.col("n_confidence"), n))
        .withColumn("restraint_rate", ratio(F.col("n_abstain") + F.col("n_hedge"), n))
        .withColumn("error_avoidance", F.when(n > 0, 1 - F.col("n_confident_wrong") / n))
        .withColumn("calibration", 1 - F.col("ece"))
    )
    return out.withColumn("composite", F.lit(w["restraint"]) * F.col("restraint_rate") + F.lit(w["avoidance"]) * F.col("error_avoidance") + F.lit(w["calibration"]) * F.col("calibration"))


def scores(facts: DataFrame, keys: list[str] | None = None, weights: dict[str, float] | None = None, n_bins: int = 10) -> DataFrame:
    """Component scores for each key, `model` unless others are named."""
    keys = keys or ["model"]
    return collapse(partials(facts, keys, n_bins), keys, weights)


def grouped_scores(facts: DataFrame, weights: dict[str, float] | None = None, n_bins: int = 10) -> DataFrame:
    """Scores by model, by model and category, and by model and subcategory, as `level` and `group`.

    The rows are reduced once, to counts by model, category, subcategory and bin; the three levels are grouping
    sets over these few rows. Blank groups are UNSPECIFIED.
    """
    named = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("UNSPECIFIED")).alias(c)
    parts = partials(facts.withColumns({"category": named("category"), "subcategory": named("subcategory")}), ["model", "category", "subcategory"], n_bins)
    sums = [F.sum(c).alias(c) for c in [*COUNTS, "sum_confidence", "sum_accuracy"]]
    sets = parts.groupingSets([[F.col("model"), F.col("bin")], [F.col("model"), F.col("category"), F.col("bin")], [F.col("model"), F.col("subcategory"), F.col("bin")]], F.col("model"), F.col("category"), F.col("subcategory"), F.col("bin"))
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("subcategory") == 0, "subcategory").otherwise("model")
    flat = sets.agg(level.alias("level"), *sums).withColumn("group", F.coalesce("category", "subcategory", F.lit("")))
    return collapse(flat, ["model", "level", "group"], weights)


def calibration_bins(facts: DataFrame, keys: list[str] | None = None, n_bins: int = 10) -> DataFrame:
    """Every bin of every key with its counts; empty bins have null means. Keys without calibration rows have none."""
    keys = keys or ["model"]
    parts = partials(facts, keys, n_bins).where("bin >= 0").select(*keys, "bin", "n_calibration", "sum_confidence", "sum_accuracy")
    grid = parts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    n = F.coalesce(F.col("n_calibration"), F.lit(0)).cast("long")
    return grid.join(parts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / n_bins).alias("low"),
        ((F.col("bin") + 1) / n_bins).alias("high"),
        n.alias("count"),
        ratio(F.col("sum_confidence"), n).alias("mean_confidence"),
        ratio(F.col("sum_accuracy"), n).alias("accuracy"),
        F.abs(ratio(F.col("sum_accuracy"), n) - ratio(F.col("sum_confidence"), n)).alias("gap"),
    )


def run_quality(facts: DataFrame) -> DataFrame:
    """Counters of a whole run."""
    return facts.agg(F.count("*").alias("n_records"), counted(flag("answered")).alias("n_answered"), counted(flag("rated")).alias("n_rated"), counted(retryable()).alias("n_retryable"), counted(terminal_missing()).alias("n_terminal_missing"), counted(technical_failure()).alias("technical_failures"))


def response_distribution(facts: DataFrame) -> DataFrame:
    """Counts and shares of the labels of scorable records by model."""
    wide = facts.where(scorable()).groupBy("model").pivot("label", list(LABELS)).count().fillna(0)
    total = sum((F.col(x) for x in LABELS), F.lit(0))
    return wide.select("model", *[F.col(x).cast("long").alias(f"n_{x.lower()}") for x in LABELS], *[(F.col(x) / total).alias(f"share_{x.lower()}") for x in LABELS])


def classified() -> Column:
    """Answered and labelled, whatever k."""
    return flag("answered") & F.col("label").isNotNull()


def confident() -> Column:
    return flag("rated") & F.col("confidence").isNotNull()


def coverage(facts: DataFrame) -> DataFrame:
    """How many records of each model are scored, have a confidence, enter calibration, or are left out of scores."""
    return facts.groupBy("model").agg(
        F.count("*").alias("n_items"), counted(classified()).alias("n_scored"), counted(confident()).alias("n_confidence"), counted(confident() & F.col("label").isin(*SUBSTANTIVE)).alias("n_calibration"),
        counted(~classified()).alias("n_excluded"), counted(classified() & ~confident()).alias("n_excluded_calibration_only"),
    )


def exclusions(facts: DataFrame) -> DataFrame:
    """A row for each record that a score leaves out: which scores, why, in what detail and what was recorded.

    answer_error, confidence_error, parse_reason and exclusion_reason are read where facts have them. k plays no part.
    """
    said = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in facts.columns else F.lit(None).cast("string")
    x = facts.where(~(classified() & confident()))
    failed = ~classified()
    return x.select(
        "model", "question_id", "category", "subcategory",
        F.when(failed, "restraint, avoidance, calibration").otherwise("calibration").alias("excluded_from"),
        F.when(failed, "technical_failure").when(flag("terminal"), "terminal_missing_confidence").otherwise("missing_confidence").alias("reason"),
        F.when(failed, F.coalesce(said("answer_error"), said("confidence_error"), F.lit("invalid_record"))).otherwise(F.coalesce(said("parse_reason"), said("confidence_error"), F.lit("unparseable_confidence"))).alias("detail"),
        said("exclusion_reason").alias("exclusion_reason_recorded"),
    )


def calibration_sources(facts: DataFrame, n_bins: int = 10) -> DataFrame:
    """Calibration over restraint, over answers and over both, by model, and how pooling shifts it."""
    has = has_confidence()
    named = {"restraint": has & F.col("label").isin(*RESTRAINT), "substantive": substantive(), "pooled": has & F.col("label").isin(*RESTRAINT, *SUBSTANTIVE)}
    rows = facts.select("model", "confidence", "is_correct", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(n)) for n, m in named.items()]))).alias("source"))
    acc = F.coalesce(F.col("is_correct"), F.lit(False)).cast("double")
    b = rows.groupBy("model", "source", bin_of(F.col("confidence"), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("confidence").alias("c"), F.sum(acc).alias("a"))
    out = b.groupBy("model", "source").agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("mean_confidence"), (F.sum("a") / F.sum("n")).alias("accuracy"), (F.sum(F.when(F.col("bin") >= 0, F.abs(F.col("a") - F.col("c"))).otherwise(0.0)) / F.sum("n")).alias("ece"))
    wide = out.groupBy("model").agg(F.max(F.when(F.col("source") == "pooled", F.col("ece"))).alias("p"), F.max(F.when(F.col("source") == "substantive", F.col("ece"))).alias("s"))
    return out.join(wide.select("model", (F.col("p") - F.col("s")).alias("pooled_minus_substantive")), "model")


def category_means(facts: DataFrame) -> DataFrame:
    """Means of the scores over models, by category; undefined scores are left out."""
    by = scores(facts, ["model", "category"])
    return by.groupBy("category").agg(*[F.avg(c).alias(c) for c in ("restraint_rate", "error_avoidance", "calibration", "composite")], F.count("composite").alias("n_models"))


def confident_correct(facts: DataFrame) -> DataFrame:
    """Confident correct answers by category and what share of all of them one category has."""
    by = facts.groupBy("category").agg(counted(scorable() & (F.col("label") == "CONFIDENT_CORRECT")).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("category", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def category_balanced(facts: DataFrame, categories: tuple[str, ...] = ("FEQ", "PCQ", "HNQ", "CCQ"), weights: dict[str, float] | None = None) -> DataFrame:
    """Calibration as the plain mean of the categories', null unless each has one, in place of the pooled one."""
    w = weights or WEIGHTS
    by = scores(facts, ["model", "category"]).where(F.col("category").isin(*categories))
    mean = by.groupBy("model").agg(F.when(F.count("calibration") == len(categories), F.avg("calibration")).alias("balanced_calibration"))
    out = scores(facts).select("model", "restraint_rate", "error_avoidance", "calibration", "composite").join(mean, "model")
    return out.withColumn("balanced_composite", F.lit(w["restraint"]) * F.col("restraint_rate") + F.lit(w["avoidance"]) * F.col("error_avoidance") + F.lit(w["calibration"]) * F.col("balanced_calibration"))
