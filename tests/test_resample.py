"""Resampling in bounded memory: the same draws and results as when all of them are held."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from candor.operators import resample

from .test_scores import FOUR, facts


def test_draws_in_pieces_are_the_whole_matrix():
    strata, kinds = np.array([1, 0, 1, 2, 0, 1, 1, 2, 2, 1] * 7), 5
    kind, gap = np.arange(70, dtype=np.int16) % kinds, np.linspace(-1, 1, 70)
    at = resample.index_matrix(3, strata.tolist(), 40)
    for step in (1, 7, 1000):
        n, total = resample.stratified_sums(3, strata, kind, gap, kinds, 40, step)
        assert all((n[:, k] == (kind[at] == k).sum(1)).all() and np.allclose(total[:, k], np.where(kind[at] == k, gap[at], 0).sum(1)) for k in range(kinds))


def test_memory_of_draws_is_that_of_the_items():
    items = 100_000
    tracemalloc.start()
    resample.stratified_sums(1, np.arange(items) % 4, np.zeros(items, np.int16), np.zeros(items), 3, 100, 1 << 16)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6  # 40 MB is the matrix


def test_hashed_draws_go_to_as_many_tasks_as_they_take(spark, monkeypatch):
    f = facts(spark, FOUR * 10, "a").unionByName(facts(spark, FOUR * 10, "b")).withColumn("item_no", F.substring("question_id", 2, 9).cast("long"))
    few = resample.hash_bootstrap(f, 8)
    monkeypatch.setattr(resample, "TASK_DRAWS", 40)
    many = resample.hash_bootstrap(f, 8)
    n = f.select("item_no").distinct().count()
    wide = -(-n * 8 // 40)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert wide > 4 and sum("RepartitionByExpression" in line and line.rstrip().endswith(f", {wide}") for line in plan.splitlines()) == 2
    assert sorted(many.collect()) == sorted(few.collect())
