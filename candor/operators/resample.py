"""Resampling: seeded streams inside of grouped Arrow functions, and hash draws that are plain expressions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _ranks(v: np.ndarray) -> np.ndarray:
    """Average ranks within each row."""
    below, equal = (v[:, :, None] > v[:, None, :]).sum(2), (v[:, :, None] == v[:, None, :]).sum(2)
    return below + (equal + 1) / 2.0


def _correlations(x: np.ndarray, y: np.ndarray, kind: str) -> np.ndarray:
    """The correlation of each row of x and y; not-a-number where one is constant."""
    constant = (x.min(1) == x.max(1)) | (y.min(1) == y.max(1))
    if kind == "spearman":
        x, y = _ranks(x), _ranks(y)
    a, b = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(constant, np.nan, (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1)))


def statistic(x: list[float], y: list[float], kind: str) -> float | None:
    r = _correlations(np.array([x], float), np.array([y], float), kind)[0] if len(x) >= 3 else np.nan
    return None if np.isnan(r) else float(r)


def bootstrap_interval(x: list[float], y: list[float], kind: str, resamples: int, seed: int, alpha: float = 0.05, step: int = 2000) -> tuple[float, float] | None:
    """Order statistics of resampled correlations; resamples without variance are left out. The stream of draws is fixed by the seed."""
    rng, n = random.Random(seed), len(x)
    left, right, got = np.array(x, float), np.array(y, float), []
    for k in range(0, resamples, step):
        at = np.array([[rng.randrange(n) for _ in range(n)] for _ in range(min(step, resamples - k))])
        got.append(_correlations(left[at], right[at], kind))
    r = np.concatenate(got) if got else np.zeros(0)
    r = np.sort(r[~np.isnan(r)])
    if not len(r):
        return None
    lo, hi = int(alpha / 2 * len(r)), int((1 - alpha / 2) * len(r)) - 1
    return float(r[lo]), float(r[max(lo, hi)])


def permutation_p(x: list[float], y: list[float], kind: str, resamples: int, seed: int, step: int = 2000) -> tuple[str, int, float]:
    """(method, permutations, p): all orders of y up to eight values, else shuffles that build on each other.

    Sums of floats depend on their order, so a correlation counts as extreme a few roundings below the one that was seen.
    """
    seen = statistic(x, y, kind)
    if seen is None:
        return "undefined", 0, math.nan
    left = np.array([x], float)
    fixed = np.array([y], float)
    if kind == "spearman":
        left, fixed = _ranks(left), _ranks(fixed)
    values = fixed[0].tolist()
    hits = 0

    def extreme(rows: list) -> int:
        z = np.array(rows, float)
        return int((np.abs(_correlations(np.repeat(left, len(z), 0), z, "pearson")) >= abs(seen) - 1e-12).sum())

    if len(x) <= 8:
        every = list(itertools.permutations(values))
        return "exact", len(every), sum(extreme(every[k : k + step]) for k in range(0, len(every), step)) / len(every)
    rng, own = random.Random(seed), list(values)
    for k in range(0, resamples, step):
        rows = []
        for _ in range(min(step, resamples - k)):
            rng.shuffle(own)
            rows.append(list(own))
        hits += extreme(rows)
    return "monte_carlo_plus_one", resamples, (hits + 1) / (resamples + 1)


CORRELATION_TESTS = "pair string, n long, pearson double, pearson_low double, pearson_high double, spearman double, spearman_low double, spearman_high double, method string, p_pearson double, p_spearman double"


def correlation_tests(rows: DataFrame, resamples: int = 10_000, permutations: int = 20_000, seed: int = 42) -> DataFrame:
    """Correlations with bootstrap intervals and permutation tests of (pair, x, y); a pair has one row for each model."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["x", "y"]).sort_values("model")
        x, y = pdf["x"].tolist(), pdf["y"].tolist()
        out = {"pair": pdf["pair"].iloc[0] if len(pdf) else None, "n": len(x)}
        for k, kind in enumerate(("pearson", "spearman")):
            span = bootstrap_interval(x, y, kind, resamples, seed + k) if len(x) >= 3 else None
            method, _, p = permutation_p(x, y, kind, permutations, seed + k) if len(x) >= 3 else ("insufficient", 0, math.nan)
            out |= {kind: statistic(x, y, kind) if len(x) >= 3 else None, f"{kind}_low": span and span[0], f"{kind}_high": span and span[1], "method": method, f"p_{kind}": p}
        return pd.DataFrame([out])[[c.split()[0] for c in CORRELATION_TESTS.split(", ")]]

    return rows.groupBy("pair").applyInPandas(run, CORRELATION_TESTS)


def binomial(rng: random.Random, n: int, p: float) -> int:
    """A binomial draw by jumps from success to success."""
    if n <= 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    log_miss, at, hits = math.log1p(-p), 0, 0
    while (at := at + 1 + int(math.log(rng.random()) / log_miss)) <= n:
        hits += 1
    return hits


HOMOGENEITY = "status string, n_models long, pooled_rate double, dispersion double, p_value double, observed_sd double, sampling_sd double, sd_ratio double, homogeneous boolean"


def homogeneity(counts: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Whether (model, successes, trials) agree with one shared rate, by simulation; models in order of name."""

    def spread(s, n, rate):
        e, f = n * rate, n * (1 - rate)
        return float(np.where(e > 0, (s - e) ** 2 / np.where(e > 0, e, 1), 0).sum() + np.where(f > 0, (n - s - f) ** 2 / np.where(f > 0, f, 1), 0).sum())

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["trials"] > 0].sort_values("model")
        s, n = pdf["successes"].to_numpy(float), pdf["trials"].to_numpy(float)
        names = [c.split()[0] for c in HOMOGENEITY.split(", ")]
        if len(s) < 2:
            return pd.DataFrame([["insufficient_models", len(s), *[None] * 7]], columns=names)
        rate, rng = s.sum() / n.sum(), random.Random(seed)
        seen = spread(s, n, rate)
        hits = sum(spread(np.array([binomial(rng, int(k), rate) for k in n], float), n, rate) >= seen for _ in range(resamples))
        p, sd, want = (hits + 1) / (resamples + 1), float(np.std(s / n, ddof=1)), math.sqrt(rate * (1 - rate) / (n.sum() / len(n)))
        return pd.DataFrame([["ok", len(s), rate, seen, p, sd, want, sd / want if want > 0 else None, p > 0.05]], columns=names)

    return counts.groupBy(F.lit(1).alias("_one")).applyInPandas(run, HOMOGENEITY)  # one row for each model


BOOTSTRAP = "model string, rep int, restraint_rate double, error_avoidance double, calibration double, composite double"


def index_matrix(seed: int, strata: list[str], resamples: int) -> np.ndarray:
    """Rows of item numbers, drawn with replacement inside each stratum, strata in order of first appearance."""
    rng = np.random.default_rng(seed)
    names = np.array(strata, object)
    out = np.empty((resamples, len(strata)), np.int32)
    for s in dict.fromkeys(strata):
        at = np.flatnonzero(names == s)
        out[:, at] = rng.choice(at, size=(resamples, len(at)), replace=True)
    return out


def stratified_sums(seed: int, stratum: np.ndarray, kind: np.ndarray, gap: np.ndarray, kinds: int, resamples: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of gaps by (replicate, kind) over the draws of index_matrix, which is never made: `step` draws at a time are the same stream."""
    rng = np.random.default_rng(seed)
    n, total = np.zeros((resamples, kinds), np.int64), np.zeros((resamples, kinds))
    names, first = np.unique(stratum, return_index=True)
    for s in names[np.argsort(first)]:
        k, g = kind[stratum == s], gap[stratum == s]
        for rep in range(resamples):
            for at in range(0, len(k), step):
                drawn = rng.integers(0, len(k), size=min(step, len(k) - at))
                of = k[drawn]
                n[rep] += np.bincount(of, minlength=kinds)
                total[rep] += np.bincount(of, weights=g[drawn], minlength=kinds)
    return n, total


def seeded_bootstrap(facts: DataFrame, resamples: int = 1000, seed: int = 42, n_bins: int = 10, weights: dict[str, float] | None = None, step: int = 1 << 18) -> DataFrame:
    """Replicates of each model's scores on the same resampled items, strata being categories.

    Each model's task draws the same items from the seed, so replicates pair up over models without being sent. It keeps
    its items as numbers, 14 bytes each, and makes `step` draws at a time.
    """
    from .scoring import RESTRAINT, SUBSTANTIVE, WEIGHTS, flag, scorable

    w = weights or WEIGHTS
    wrong_bins, right_bins, kinds = 4, 4 + n_bins, 4 + 2 * n_bins  # before them: not scored, restraint, wrong, other

    def replicates(model: str, parts: list) -> pa.RecordBatch:
        n, total = stratified_sums(seed, *(np.concatenate(x) for x in zip(*parts, strict=True)), kinds, resamples, step)
        scored, m = n[:, 1:].sum(1), n[:, wrong_bins:].sum(1)
        if (scored == 0).any() or (m == 0).any():
            raise ValueError("a resample without rows to score")
        ece = np.abs(total[:, wrong_bins:right_bins] + total[:, right_bins:]).sum(1) / m
        rates = [n[:, 1] / scored, 1 - (n[:, 2] + n[:, wrong_bins:right_bins].sum(1)) / scored, 1 - ece]
        composite = w["restraint"] * rates[0] + w["avoidance"] * rates[1] + w["calibration"] * rates[2]
        columns = [pa.array([model] * resamples, pa.string()), pa.array(np.arange(resamples, dtype=np.int32)), *map(pa.array, [*rates, composite])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in BOOTSTRAP.split(", ")])

    def run(batches):
        model, parts, codes, seen = None, [], {}, False
        for batch in batches:
            x = {c: batch.column(c) for c in batch.schema.names}
            names = x["model"].to_pylist()
            conf = x["confidence"].to_numpy(zero_copy_only=False).astype(float)
            if np.nanmin(conf, initial=0) < 0 or np.nanmax(conf, initial=0) > 1:
                raise ValueError("a confidence outside of [0, 1]")
            base, right, sub = (x[c].to_numpy(zero_copy_only=False) for c in ("base", "right", "sub"))
            sub = sub & ~np.isnan(conf)
            known = np.nan_to_num(conf)
            bins = np.minimum((known * n_bins).astype(int), n_bins - 1) + np.where(base == 2, wrong_bins, right_bins)
            kind, gap = np.where(sub, bins, base).astype(np.int16), np.where(sub, right.astype(float) - known, 0.0)
            ends = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for i, j in zip(ends, ends[1:]):
                if i == j:
                    continue
                if seen and names[i] != model:
                    yield replicates(model, parts)
                    parts, codes = [], {}
                model, seen = names[i], True
                parts.append((np.array([codes.setdefault(c, len(codes)) for c in x["category"][i:j].to_pylist()], np.int32), kind[i:j], gap[i:j]))
        if seen:
            yield replicates(model, parts)

    # every model over every item: what a model never answered is an item that can't be scored
    grid = facts.groupBy("question_id").agg(F.min("category").alias("category")).crossJoin(F.broadcast(facts.select("model").distinct()))
    facts = grid.join(facts.drop("category"), ["question_id", "model"], "left")
    label = F.col("label")
    base = F.when(~scorable(), 0).when(label.isin(*RESTRAINT), 1).when(label == "CONFIDENT_WRONG", 2).otherwise(3)
    sub = scorable() & flag("rated") & label.isin(*SUBSTANTIVE) & F.col("confidence").isNotNull()
    rows = facts.select("model", "question_id", "category", base.cast("tinyint").alias("base"), F.coalesce(sub, F.lit(False)).alias("sub"), F.col("confidence").cast("double").alias("confidence"), flag("is_correct").alias("right"))
    apart = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "model")
    return apart.sortWithinPartitions("model", F.col("question_id").asc_nulls_last()).drop("question_id").mapInArrow(run, BOOTSTRAP)


#: Draws of one task of the hashed bootstrap, in the mean; there are as many tasks as this takes.
TASK_DRAWS = 1_000_000


def hash_bootstrap(facts: DataFrame, resamples: int) -> DataFrame:
    """Replicates of the restraint rate and error avoidance by draws from a hash of (replicate, item, draw).

    A replicate takes for each of the n items the one that the hash names, the same for every model: built-in
    expressions only. The counts of how often an item is drawn are summed over models once and then joined. Draws go to
    so many tasks that each has TASK_DRAWS of them, whatever the input: a task's memory doesn't grow with it.
    """
    from .scoring import scorable

    items = facts.select("item_no").distinct()
    n = items.count()
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * resamples // TASK_DRAWS))
    draws = items.crossJoin(F.broadcast(items.sparkSession.range(resamples).select(F.col("id").cast("int").alias("rep"))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("rep").cast("string"), F.col("item_no").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = draws.select("rep", F.pmod(h, F.lit(n)).alias("item_no")).repartition(parts, "item_no")
    times = drawn.groupBy("rep", "item_no").agg(F.count("*").alias("times"))
    rows = facts.where(scorable()).select("model", "item_no", F.col("label").isin("ABSTAIN", "HEDGE").cast("int").alias("r"), (F.col("label") == "CONFIDENT_WRONG").cast("int").alias("w"))
    t = F.col("times")
    return rows.repartition(parts, "item_no").hint("merge").join(times, "item_no").groupBy("model", "rep").agg((F.sum(t * F.col("r")) / F.sum(t)).alias("restraint_rate"), (1 - F.sum(t * F.col("w")) / F.sum(t)).alias("error_avoidance"))


def percentile_interval(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    """2.5 and 97.5 percent by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy(*by).agg(p.alias("_p"), F.avg(value).alias("mean")).select(*by, "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def paired_difference(replicates: DataFrame, pairs: DataFrame, value: str) -> DataFrame:
    """new - old of each pair (pair, old, new) over replicates: interval and share above 0."""
    side = lambda name: replicates.select(F.col("model").alias(name), "rep", F.col(value).alias(f"{name}_v"))
    d = F.broadcast(pairs).join(side("old"), "old").join(side("new"), ["new", "rep"]).withColumn("d", F.col("new_v") - F.col("old_v"))
    p = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return d.groupBy("pair").agg(F.avg("d").alias("mean"), p.alias("_p"), F.avg((F.col("d") > 0).cast("double")).alias("share_up")).select("pair", "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "share_up")
