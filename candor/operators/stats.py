"""Correlations and intervals by built-in functions; exact tests over the few values of a panel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .ranking import average_rank

Z95 = 1.959963984540054


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r of an aggregation over rows where both are known; null for few rows or a constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    ok = (F.count(F.when(both, 1)) >= least) & (F.max(a) != F.min(a)) & (F.max(b) != F.min(b))
    return F.when(ok, F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def correlations(rows: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 3) -> DataFrame:
    """n, Pearson's r and Spearman's rho for each group, with a status."""
    by = by or []
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = known.withColumn("_rx", average_rank(x, by)).withColumn("_ry", average_rank(y, by))
    constant = (F.max(x) == F.min(x)) | (F.max(y) == F.min(y))
    status = F.when(F.count("*") < least, "insufficient_models").when(constant, "constant_input").otherwise("ok")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation(x, y, least).alias("pearson"), correlation("_rx", "_ry", least).alias("spearman"), status.alias("status"))


def fisher_interval(r: Column, n: Column) -> tuple[Column, Column]:
    """95% limits of a correlation; null for n <= 3 or |r| = 1."""
    ok = (n > 3) & (F.abs(r) < 1)
    half = Z95 / F.sqrt(F.when(n > 3, n - 3).cast("double"))
    return F.when(ok, F.tanh(F.atanh(r) - half)), F.when(ok, F.tanh(F.atanh(r) + half))


def partial_correlation(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y given z; null where it isn't defined."""
    rest = (1 - xz * xz) * (1 - yz * yz)
    return F.when(rest > 0, (xy - xz * yz) / F.sqrt(F.when(rest > 0, rest)))


#: Values that an exact test goes over; the subsets of one half of them fit into memory.
MOST_EXACT = 44


def _subset_sums(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All sums that take low or high at each place, from left to right."""
    out = np.zeros(1, np.longdouble)
    for a, b in zip(low, high):
        out = np.concatenate([out + a, out + b])
    return out


def sign_test(differences: np.ndarray) -> tuple[int, int]:
    """(sign assignments whose mean is as far from 0, assignments) of differences that aren't 0; one of one for none.

    Exact for MOST_EXACT at most, an error beyond: the sums of one half are sorted, those of the other look theirs up.
    """
    d = np.abs(np.asarray(differences, np.longdouble))
    m = len(d)
    if m > MOST_EXACT:
        raise ValueError(f"an exact sign test goes over {MOST_EXACT} differences at most")
    if not m:
        return 1, 1
    least = (abs(np.asarray(differences, np.longdouble).sum()) / m - np.longdouble(1e-15)) * m
    if least <= 0:
        return 1 << m, 1 << m
    left, right = _subset_sums(-d[: m // 2], d[: m // 2]), np.sort(_subset_sums(-d[m // 2 :], d[m // 2 :]))
    above = len(right) - np.searchsorted(right, least - left, side="left")
    below = np.searchsorted(right, -least - left, side="right")
    return int(above.sum() + below.sum()), 1 << m


def choice_test(values: np.ndarray, own: np.ndarray) -> tuple[float, int, int]:
    """(difference of means, choices of as many members whose difference is as far from 0, choices), exact like sign_test."""
    v, n, g = np.asarray(values, np.longdouble), len(values), int(np.sum(own))
    if n > MOST_EXACT:
        raise ValueError(f"an exact test of choices goes over {MOST_EXACT} rows at most")
    total, member = v.sum(), np.asarray(own, bool)
    seen = v[member].mean() - v[~member].mean()
    # the difference rises with the members' sum: as far from 0 above one bound or below another
    scale, shift = np.longdouble(1) / g + np.longdouble(1) / (n - g), total / (n - g)
    least = abs(seen) - np.longdouble(1e-15)
    high, low = (least + shift) / scale, (-least + shift) / scale
    halves = []
    for part in (v[: n // 2], v[n // 2 :]):
        sums, size = _subset_sums(np.zeros(len(part)), part), _subset_sums(np.zeros(len(part)), np.ones(len(part))).astype(np.int64)
        halves.append([np.sort(sums[size == k]) for k in range(len(part) + 1)])
    hits = every = 0
    for k, left in enumerate(halves[0]):
        if 0 <= g - k < len(halves[1]):
            right = halves[1][g - k]
            every += len(left) * len(right)
            if least <= 0:
                hits += len(left) * len(right)
            else:
                hits += int((len(right) - np.searchsorted(right, high - left, side="left")).sum() + np.searchsorted(right, low - left, side="right").sum())
    return float(seen), hits, every


@F.pandas_udf(StructType([StructField("n_extreme", LongType()), StructField("n_permutations", LongType())]))
def _sign_test(ds: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sign_test(d) for d in ds], columns=["n_extreme", "n_permutations"])


@F.pandas_udf(StructType([StructField("difference", DoubleType()), StructField("n_extreme", LongType()), StructField("n_permutations", LongType())]))
def _choice_test(v: pd.Series, g: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([choice_test(a, b) for a, b in zip(v, g)], columns=["difference", "n_extreme", "n_permutations"])


def paired(pairs: DataFrame) -> DataFrame:
    """Summary of differences new - old: means, median, directions, spread, Cohen's d and an exact sign permutation test.

    The differences come into one row, since the test needs them all; without any but 0 its p value is 1.
    """
    d = pairs.where("old is not null and new is not null").select("old", "new", (F.col("new") - F.col("old")).alias("d"))
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    base = d.agg(
        F.count("*").alias("n_pairs"), F.avg("old").alias("old_mean"), F.avg("new").alias("new_mean"), F.avg("d").alias("mean_difference"), F.median("d").alias("median_difference"), n(F.col("d") > 0).alias("n_up"),
        n(F.col("d") < 0).alias("n_down"), n(F.col("d") == 0).alias("n_unchanged"), F.when(F.count("*") > 1, F.stddev_samp("d")).alias("sd"), F.sort_array(F.collect_list(F.when(F.col("d") != 0, F.col("d")))).alias("ds"),
    )
    enough = F.col("n_pairs") > 1
    dz = F.when(enough & (F.col("sd") > 0), F.col("mean_difference") / F.nullif(F.col("sd"), F.lit(0.0)))
    status = F.when(~enough, "insufficient_pairs").when(F.col("sd") == 0, "zero_difference_variance").otherwise("ok")
    out = base.withColumn("t", _sign_test(F.when(enough, F.col("ds")).otherwise(F.array().cast("array<double>"))))
    tested = [F.when(enough, F.col(f"t.{c}")).alias(c) for c in ("n_extreme", "n_permutations")]
    p = F.when(enough, F.col("t.n_extreme") / F.col("t.n_permutations"))
    return out.select(*base.columns[:-1], dz.alias("cohens_dz"), status.alias("status"), *tested, p.alias("p_value"))


def group_permutation(rows: DataFrame, member: str, value: str) -> DataFrame:
    """Exact two-sided test of the difference in means between members and others, over all choices of members.

    The values of all rows come into one, since the test needs them all. Without members or others there is no row.
    """
    known = rows.where(F.col(value).isNotNull())
    a = known.agg(F.array_sort(F.collect_list(F.struct(F.col("model").alias("model"), F.col(value).cast("double").alias("v"), F.coalesce(F.col(member), F.lit(False)).cast("boolean").alias("g")))).alias("r"))
    both = F.exists("r", lambda x: x["g"]) & F.exists("r", lambda x: ~x["g"])
    out = a.where(both).select(_choice_test(F.col("r.v"), F.col("r.g")).alias("t")).select("t.*")
    return out.withColumn("p_value", F.col("n_extreme") / F.col("n_permutations"))


def dispersion(counts: DataFrame) -> DataFrame:
    """Pearson's dispersion of successes over trials around their pooled rate, and the spread of the proportions."""
    rows = counts.where("trials > 0")
    pool = rows.agg((F.sum("successes") / F.sum("trials")).alias("rate"), F.sum("trials").alias("all_trials"))
    x = rows.crossJoin(F.broadcast(pool))
    term = lambda seen, expected: F.when(expected > 0, F.pow(seen - expected, 2) / F.nullif(expected, F.lit(0.0))).otherwise(0.0)
    stat = term(F.col("successes"), F.col("trials") * F.col("rate")) + term(F.col("trials") - F.col("successes"), F.col("trials") * (1 - F.col("rate")))
    out = x.groupBy("rate", "all_trials").agg(F.count("*").alias("n_models"), F.sum(stat).alias("dispersion"), F.stddev_samp(F.col("successes") / F.col("trials")).alias("observed_sd"))
    sampling = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("all_trials") / F.col("n_models")))
    return out.select("n_models", F.col("rate").alias("pooled_rate"), "dispersion", "observed_sd", sampling.alias("sampling_sd"), (F.col("observed_sd") / F.nullif(sampling, F.lit(0.0))).alias("sd_ratio"))
