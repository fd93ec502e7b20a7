"""Reports that combine operators: the panel's correlations, capability and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineage, ranking, resample, scoring, stats

COMPONENTS = [("restraint_rate", "error_avoidance"), ("restraint_rate", "calibration"), ("error_avoidance", "calibration")]


def component_family(scores: DataFrame, resamples: int = 10_000, permutations: int = 20_000, seed: int = 42) -> DataFrame:
    """Tests of the three pairs of components with Fisher intervals and adjusted p values."""
    pairs = scores.select("model", F.explode(F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in COMPONENTS])).alias("s")).select("model", "s.*")
    tests = resample.correlation_tests(pairs, resamples, permutations, seed)
    low, high = stats.fisher_interval(F.col("pearson"), F.col("n"))
    named = tests.withColumns({"fisher_low": low, "fisher_high": high, "family": F.lit("components"), "name": F.col("pair"), "p": F.col("p_pearson")})
    return ranking.holm(named, ["family"]).drop("name", "p", "family")


def category_family(scores: DataFrame, value: str = "composite", resamples: int = 10_000, permutations: int = 20_000, seed: int = 142) -> DataFrame:
    """Tests of the six pairs of categories; scores by model and category."""
    a = scores.select("model", F.col("category").alias("c"), F.col(value).alias("x"))
    b = scores.select("model", F.col("category").alias("d"), F.col(value).alias("y"))
    pairs = a.join(b, "model").where("c < d").select("model", F.concat_ws("~", "c", "d").alias("pair"), "x", "y")
    tests = resample.correlation_tests(pairs, resamples, permutations, seed)
    return ranking.holm(tests.withColumns({"family": F.lit("categories"), "name": F.col("pair"), "p": F.col("p_pearson")}), ["family"]).drop("name", "p", "family")


def capability_relation(scores: DataFrame, counts: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Whether scores follow capability; first whether capability differs between models at all.

    status: insufficient_models, capability_homogeneous (nothing to relate to) or what the correlation says.
    """
    test = resample.homogeneity(counts, resamples, seed).select("homogeneous", F.col("p_value").alias("homogeneity_p"), F.col("sd_ratio"))
    both = scores.where("composite is not null").select("model", "composite").join(counts.where("trials > 0").select("model", (F.col("successes") / F.col("trials")).alias("capability")), "model")
    c = stats.correlations(both, "capability", "composite")
    shifts = ranking.shift_summary(ranking.rank_shift(scores, both.select("model", F.col("capability").alias("composite"))))
    status = F.when(F.col("n") < 3, "insufficient_models").when(F.col("homogeneous"), "capability_homogeneous").otherwise(F.col("status"))
    return c.crossJoin(F.broadcast(test)).crossJoin(F.broadcast(shifts)).withColumn("status", status)


def generations(models: DataFrame, scores: DataFrame) -> DataFrame:
    """Newer against older models of each pair."""
    return stats.paired(lineage.generation_pairs(models, scores))


def scores_table(facts: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    s = scoring.scores(facts)
    return ranking.summary_order(lineage.usable(s, excluded) if excluded is not None else s)


def summary_table(facts: DataFrame, replicates: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Scores of the models with their places, beside intervals of resampled scores (model, rep, composite) and capability."""
    out = scores_table(facts).join(F.broadcast(scoring.coverage(facts).drop("n_items", "n_confidence", "n_calibration", "n_scored")), "model")  # one row a model
    if replicates is not None:
        out = out.join(F.broadcast(resample.percentile_interval(replicates, ["model"], "composite").withColumnsRenamed({"mean": "composite_mean", "low": "composite_low", "high": "composite_high"})), "model", "left")
    if counts is not None:
        out = out.join(F.broadcast(counts.select("model", (F.col("successes") / F.col("trials")).alias("capability"))), "model", "left")
    return out


def publication(facts: DataFrame, replicates: DataFrame | None = None, counts: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a publication by name: all of them regard one panel of records."""
    from ..operators import sensitivity

    scores = scoring.scores(facts)
    grouped = scoring.grouped_scores(facts)
    return {
        "summary": summary_table(facts, replicates, counts),
        "by_category": grouped.where("level = 'category'").drop("level"),
        "by_subcategory": grouped.where("level = 'subcategory'").drop("level"),
        "category_means": scoring.category_means(facts),
        "responses": scoring.response_distribution(facts),
        "coverage": scoring.coverage(facts),
        "exclusions": scoring.exclusions(facts),
        "calibration_bins": scoring.calibration_bins(facts),
        "calibration_sources": scoring.calibration_sources(facts),
        "category_balanced": scoring.category_balanced(facts),
        "scopes": sensitivity.scope_shifts(facts),
        "weights": sensitivity.weight_scores(scores),
        "abstention": sensitivity.abstention_compliance(facts),
    }


def top_models(scores: DataFrame, most: float = 4) -> DataFrame:
    """Models whose rank, shared by ties, is `most` or better."""
    return scores.withColumn("rank", ranking.average_rank("composite", descending=True)).where(F.col("rank") <= most)
