"""Connected components by contraction, on tables of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, even_join, few_parts, written

#: Edges that one task may finish, 8 MB of ids; more are contracted first.
LOCAL_EDGES = 500_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of the component of each) of edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(jump := label[label], label):
            label = jump


def _finish(batches):
    edges = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if edges:
        nodes, least = labels(*(np.concatenate(x) for x in zip(*edges)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "component"])


def components(edges: DataFrame, local: int | None = None) -> DataFrame:
    """(node, component) for edges (u, v) of long ids; component: the smallest node. Nodes without an edge are left out.

    In each round every node joins the neighbour (or itself) of least hash, hashes being new each round, and the
    edges are rewritten between those; the number of nodes shrinks by a constant factor, so rounds are few. Once
    LOCAL_EDGES or fewer are left, one task finishes them. Nodes with very many edges, and components with very many
    nodes, are salted in the joins.
    """
    local = LOCAL_EDGES if local is None else local
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    n = edges.count()
    few = lambda df: few_parts(df, size)
    size = 2 * n
    names, nodes, turn = None, 0, 0
    while n > local:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("u").agg(F.min(order("v")).alias("m"), F.count("*").alias("rows"))
        best = written(few(best.select("u", F.least(F.col("m"), order("u"))["id"].alias("to"), "rows")), "contraction")
        left = even_join(edges, best, ["u"], 2 * n, F.col("v")).select(F.col("to").alias("a"), "u", "v")
        met = even_join(left, best.select(F.col("u").alias("v"), F.col("to").alias("b"), "rows"), ["v"], 2 * n, F.col("u")).where("a <> b")
        fewer = written(few(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()), "edges")
        if names is None:
            names, first = best.select(F.col("u").alias("node"), F.col("to").alias("rep")), best
            nodes, done = names.count(), [edges]
        else:
            done = [edges, best, first if turn == 1 else names]
            names = written(few(_renamed(names, best.select(F.col("u").alias("rep"), "to"), nodes)), "names")
        discard(*done)
        edges, n, turn = fewer, fewer.count(), turn + 1
    rest = written(edges.coalesce(1).mapInArrow(_finish, "node long, component long"), "components")
    if names is None:
        return rest
    names = written(few(_renamed(names, rest.select(F.col("node").alias("rep"), F.col("component").alias("to")), nodes)), "names")
    least = names.groupBy("rep").agg(F.min("node").alias("component"), F.count("*").alias("rows"))
    return written(few(even_join(names, least, ["rep"], nodes, F.col("node")).select("node", "component")), "components")


def _renamed(names: DataFrame, step: DataFrame, nodes: int) -> DataFrame:
    """names (node, rep) with the representatives that step (rep, to) has replaced."""
    sizes = names.groupBy("rep").agg(F.count("*").alias("rows"))
    step = sizes.join(step, "rep", "left").select("rep", "rows", F.coalesce("to", "rep").alias("to"))
    return even_join(names, step, ["rep"], nodes, F.col("node")).select("node", F.col("to").alias("rep"))
