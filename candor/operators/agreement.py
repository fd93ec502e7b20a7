"""Agreement of coders and classifiers: kappa, confusion, precision and recall, and what labels do to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LABELS
from .scoring import ratio
from .ranking import average_rank
from .stats import correlation, group_permutation, partial_correlation


def joined(a: DataFrame, b: DataFrame, key: str, columns: tuple[str, str] = ("label_a", "label_b")) -> DataFrame:
    """Rows of both coders; an id that only one of them has is an error."""
    x = a.select(key, F.col("label").alias(columns[0]), F.lit(True).alias("_a")).join(b.select(key, F.col("label").alias(columns[1]), F.lit(True).alias("_b")), key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return x.withColumn(columns[0], F.when(both, F.col(columns[0])).otherwise(F.raise_error(F.concat(F.lit("only one coder has "), F.col(key).cast("string"))).cast("string"))).drop("_a", "_b")


def kappa(pairs: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Observed and expected agreement and Cohen's kappa of each group."""
    by = by or []
    cells = pairs.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col(a).alias("value")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col(b).alias("value")).agg(F.sum("n").alias("nb"))
    prod = rows.join(cols, [*by, "value"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("prod"))
    x = total.join(prod, by, "left") if by else total.crossJoin(F.broadcast(prod))
    observed, expected = F.col("same") / F.col("n"), F.coalesce(F.col("prod"), F.lit(0)) / (F.col("n") * F.col("n"))
    k = F.when(expected == 1, F.when(observed == 1, 1.0)).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))
    return x.select(*by, F.col("n").cast("long").alias("n"), observed.alias("observed"), expected.alias("expected"), k.alias("kappa"))


def confusion(pairs: DataFrame, reference: str, predicted: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Counts over the whole grid of labels."""
    spark = pairs.sparkSession
    one = lambda name: spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))
    seen = pairs.groupBy(F.col(reference).alias("reference"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    grid = one("reference").crossJoin(one("predicted"))
    return grid.join(seen, ["reference", "predicted"], "left").select("reference", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 of each label; null where a denominator is 0."""
    cell = F.explode(F.array(F.struct(F.col("reference").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"))))
    sums = matrix.select(cell.alias("c")).groupBy("c.label").agg(F.sum("c.support").alias("support"), F.sum("c.called").alias("called"))
    hits = matrix.where("reference = predicted").select(F.col("reference").alias("label"), F.col("n").alias("hits"))
    x = sums.join(hits, "label")
    p, r = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    return x.select("label", "support", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).alias("f1"))


def overall(by_class: DataFrame) -> DataFrame:
    """Macro F1 over defined labels, and F1 weighted by support over all of it."""
    return by_class.agg(F.sum("support").alias("n"), F.avg("f1").alias("macro_f1"), (F.sum(F.coalesce(F.col("support") * F.col("f1"), F.lit(0.0))) / F.nullif(F.sum("support"), F.lit(0))).alias("weighted_f1"))


def score_impact(rows: DataFrame, automated: str, human: str) -> DataFrame:
    """Restraint and error avoidance of each model under both label columns, and the difference."""
    def rate(column: str, labels: tuple[str, ...]):
        return F.avg(F.col(column).isin(*labels).cast("double"))

    restraint, wrong = ("ABSTAIN", "HEDGE"), ("CONFIDENT_WRONG",)
    x = rows.groupBy("model").agg(rate(automated, restraint).alias("restraint_auto"), rate(human, restraint).alias("restraint_human"), (1 - rate(automated, wrong)).alias("avoidance_auto"), (1 - rate(human, wrong)).alias("avoidance_human"))
    return x.withColumn("restraint_bias", F.col("restraint_auto") - F.col("restraint_human")).withColumn("avoidance_bias", F.col("avoidance_auto") - F.col("avoidance_human"))


def impact_summary(impact: DataFrame) -> DataFrame:
    out = []
    for k in ("restraint", "avoidance"):
        out += [F.avg(F.abs(f"{k}_bias")).alias(f"{k}_mae"), F.max(F.abs(f"{k}_bias")).alias(f"{k}_max"), correlation(f"{k}_auto", f"{k}_human", 2).alias(f"{k}_r")]
    return impact.agg(*out)


def checked_labels(rows: DataFrame) -> DataFrame:
    """Rows with a coder's label outside of the domain, or a confident correct one where nothing can be correct."""
    bad = ~F.coalesce(F.col("label").isin(*LABELS), F.lit(False))
    never = (F.col("label") == "CONFIDENT_CORRECT") & F.col("category").isin("FEQ", "CCQ")
    return rows.withColumn("issue", F.when(bad, "invalid_label").when(never, "impossible_label")).where("issue is not null")


def checked_uncertainty(rows: DataFrame) -> DataFrame:
    """Rows whose uncertainty flag isn't 0 or 1, or is 1 without notes."""
    flag, notes = F.trim(F.coalesce(F.col("uncertain").cast("string"), F.lit(""))), F.trim(F.coalesce(F.col("notes"), F.lit("")))
    issue = F.when(flag == "", "missing_flag").when(~flag.isin("0", "1"), "invalid_flag").when((flag == "1") & (notes == ""), "missing_notes")
    return rows.withColumn("issue", issue).where("issue is not null")


def adjudicated(pairs: DataFrame, a: str, b: str, final: str) -> DataFrame:
    """The agreed label, or the adjudicated one; adjudicating what is agreed to another label is an error."""
    given = F.nullif(F.trim(F.col(final)), F.lit(""))
    agreed = F.when(F.col(a) == F.col(b), F.col(a))
    clash = agreed.isNotNull() & given.isNotNull() & (agreed != given)
    missing = agreed.isNull() & given.isNull()
    return pairs.withColumn("label", F.when(clash, F.raise_error(F.lit("adjudication against agreement")).cast("string")).when(missing, F.raise_error(F.lit("a disagreement without adjudication")).cast("string")).otherwise(F.coalesce(agreed, given)))


def family_bias(impact: DataFrame, family: str) -> DataFrame:
    """Whether the classifier's bias (columns of score_impact) goes with a family of models, named by a prefix.

    For restraint and avoidance: means of both groups, an exact test over all choices of as many models, correlations
    of bias with the family and with human scores, and each of them given the other. The models are one panel.
    """
    rows = impact.withColumn("own", F.col("model").startswith(family))
    out = None
    for k in ("restraint", "avoidance"):
        bias, human, own = f"{k}_bias", f"{k}_human", F.col("own").cast("double")
        x = rows.withColumn("own_number", own)
        c = x.agg(
            F.count("*").alias("n_models"), F.sum("own_number").cast("long").alias("n_family"), F.avg(F.when(F.col("own"), F.col(bias))).alias("family_mean_bias"), F.avg(F.when(~F.col("own"), F.col(bias))).alias("other_mean_bias"),
            correlation("own_number", bias).alias("family_bias_r"), correlation(human, bias).alias("human_bias_r"), correlation("own_number", human).alias("family_human_r"),
        )
        test = group_permutation(rows, "own", bias)
        part = c.crossJoin(F.broadcast(test)).withColumns({"component": F.lit(k), "family_bias_given_human": partial_correlation(F.col("family_bias_r"), F.col("family_human_r"), F.col("human_bias_r")), "human_bias_given_family": partial_correlation(F.col("human_bias_r"), F.col("family_human_r"), F.col("family_bias_r"))})
        out = part if out is None else out.unionByName(part)
    return out


def family_ranks(impact: DataFrame, family: str) -> DataFrame:
    """Places of the models by automated and by human scores, with their group."""
    places = {f"{k}_{s}_rank": average_rank(f"{k}_{s}", descending=True) for k in ("restraint", "avoidance") for s in ("auto", "human")}
    return impact.select("model", F.when(F.col("model").startswith(family), "family").otherwise("other").alias("group"), *[f"{k}_{s}" for k in ("restraint", "avoidance") for s in ("auto", "human")]).withColumns(places)
