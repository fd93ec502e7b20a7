"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

A row's key is its text, so copies fall on the same place of the ring. The ring is cut into arcs by the virtual
nodes; all keys of an arc walk clockwise over the same nodes, so counts of rows for each arc (SHARDS * NODES
numbers, whatever the input) decide everything. A shard holds the mean number of rows, rounded up or down, and
the capacities sum to the number of rows: counts differ by one at most (law "rows"). Each arc gives its rows to
its own shard up to the capacity; what overflows continues clockwise, arcs by the length of their walk, until it
finds room. Rows of an arc are in an order of their own that no size decides: by a slice of the hash, the hash, a
hash of doc_id, doc_id. So each border cuts one group of copies at most, and further rows move only what they push.

Which rows of an arc go where is decided by their rank in it, counted in two levels: within a slice of an arc (a
sixteenth of it; a text with more than a HOT_PARTSth of all rows is cut into runs of this order as well), then over
the sums of these, so that neither a hot arc nor a text with a third of all rows is one task's work.

Null texts count as empty; their size is the row's constant. Repeated rows and ties take ranks of their own;
tables without rows give none. Texts are read once: keys and sizes are written, and only they are shuffled.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import HOT_PARTS, written

SHARDS = 40
NODES = 64
ROW_BYTES = 16
#: The ring's places; hashes are cut to so many bits.
RING_BITS = 16
_RING = 1 << RING_BITS
#: Slices of an arc, and runs of a hot text.
SLICES, RUNS = 16, 256


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of the virtual nodes in clockwise order; a further shard only adds its own."""
    if shards * nodes > _RING // 4:
        raise ValueError("too many virtual nodes for the ring's places")
    spots: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            spot = int.from_bytes(hashlib.sha256(f"{s}:{v}".encode()).digest()[:8], "big") % _RING
            while spot in spots:  # taken: the next place
                spot = (spot + 1) % _RING
            spots[spot] = s
    return sorted(spots.items())


def _arcs(spark, points: list[tuple[int, int]]) -> DataFrame:
    """(place, arc) for the 2 ** RING_BITS places: the number of the first virtual node at or after a place."""
    spots = [p for p, _ in points]
    runs = [{"arc": k, "lo": spots[k - 1] + 1 if k else 0, "hi": p} for k, p in enumerate(spots)]
    if spots[-1] + 1 < _RING:
        runs.append({"arc": 0, "lo": spots[-1] + 1, "hi": _RING - 1})
    return _table(spark, runs, "arc: int, lo: int, hi: int").select("arc", F.explode(F.sequence("lo", "hi")).alias("place"))


def walk(counts: list[int], points: list[tuple[int, int]], shards: int) -> list[dict]:
    """Flows (arc, lo, hi, shard, base): ranks lo to hi - 1 of the arc go to the shard, to its slots from base."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, sent = [0] * shards, [0] * len(points)
    flows = []

    def give(arc: int, shard: int) -> None:
        n = min(counts[arc] - sent[arc], room[shard])
        if n > 0:
            flows.append({"arc": arc, "lo": sent[arc], "hi": sent[arc] + n, "shard": shard, "base": filled[shard]})
            sent[arc] += n
            filled[shard] += n
            room[shard] -= n

    at = list(range(len(points)))  # the node that each arc has come to
    waiting = [a for a in at if counts[a]]
    for arc in waiting:
        give(arc, points[arc][1])
    while waiting := [a for a in waiting if sent[a] < counts[a]]:
        for arc in waiting:
            at[arc] = (at[arc] + 1) % len(points)
            give(arc, points[at[arc]][1])
    return flows


def _table(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    spark = docs.sparkSession
    points = ring(shards, nodes)
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.xxhash64(body)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), h.alias("h"), F.shiftrightunsigned(h, 64 - RING_BITS).cast("int").alias("place")
    )
    rows = written(rows.join(F.broadcast(_arcs(spark, points)), "place").drop("place").withColumn("slice", F.pmod(F.xxhash64("h"), F.lit(SLICES)).cast("int")), "ring-keys")
    cells = rows.groupBy("arc", "slice").agg(F.count("*").alias("n")).collect()  # SLICES numbers for each virtual node
    counts = [0] * len(points)
    for r in cells:
        counts[r["arc"]] += r["n"]
    total = sum(counts)
    flows = _table(spark, walk(counts, points, shards), "arc: int, lo: bigint, hi: bigint, shard: int, base: bigint")
    # texts with many rows lie in cells with many: fewer than HOT_PARTS of either
    large = [{"arc": r["arc"], "slice": r["slice"]} for r in cells if r["n"] * HOT_PARTS > total]
    hot = []
    if large:
        within = rows.join(F.broadcast(_table(spark, large, "arc: int, slice: int")), ["arc", "slice"])
        hot = [r.asDict() for r in within.groupBy("arc", "slice", "h").agg(F.count("*").alias("n")).where(F.col("n") * HOT_PARTS > total).select("arc", "slice", "h").collect()]
    texts = _table(spark, hot, "arc: int, slice: int, h: bigint").groupBy("arc", "slice").agg(F.collect_list("h").alias("hot"))
    # a run of the order within a cell: before, in or after a hot text, and there by the hash of doc_id
    rows = rows.join(F.broadcast(texts), ["arc", "slice"], "left").withColumn("by", F.xxhash64("doc_id"))
    below = F.coalesce(F.size(F.filter("hot", lambda x: x < F.col("h"))), F.lit(0))
    is_hot = F.coalesce(F.array_contains("hot", F.col("h")), F.lit(False))
    run = 2 * below * RUNS + F.when(is_hot, RUNS + F.shiftright("by", 56) + RUNS // 2).otherwise(0)
    rows = rows.withColumn("run", run.cast("int")).drop("hot")
    keys = ["arc", "slice", "run"]
    local = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "by", "doc_id")) - 1)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"))  # a few for each cell, RUNS for each hot text
    sums = sums.select(*keys, (F.sum("n").over(Window.partitionBy("arc").orderBy("slice", "run")) - F.col("n")).alias("ahead"))
    ranked = local.join(F.broadcast(sums), keys).withColumn("rank", F.col("rank") + F.col("ahead"))
    placed = ranked.join(F.broadcast(flows), (ranked["arc"] == flows["arc"]) & (ranked["rank"] >= flows["lo"]) & (ranked["rank"] < flows["hi"]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
