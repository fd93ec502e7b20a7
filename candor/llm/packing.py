"""Packing token sequences by non-negative least squares.

Each document (ids and an end id) is cut at multiples of the window; full windows are sequences of their own.
The histogram of what remains, in bins of `grid` tokens, is at most window / grid numbers, whatever the input.
Shallow combinations of up to three bins that fill the window are enumerated, their repeat counts are solved
against the histogram by non-negative least squares and rounded down, and the bins left over are packed
greedily, largest first, with whole patterns repeated at once; patterns come out of the histogram alone, so
this costs the driver the same for any number of documents. Sequences that the greedy step leaves with much
room are cut instead: their pieces are laid end to end and cut where a window ends.

Pieces find their sequence by their rank within their bin. Ranks are counted in two levels (salted groups,
then sums of groups), so that a bin holding most rows isn't one task's work.

Null texts count as empty: one piece of the end id. Equal lengths rank by doc_id, then by row; empty tables
give no rows. Documents are cut wherever needed, so very long ones need no rule.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .units import KEPT_UNITS, encoder, merged, texts, u32_crc

WINDOW = 2048
END_ID = 1
GRID = 8
#: Greedy patterns below this part of a window are cut and laid end to end.
LEAST_FILL = 0.97
#: Rows of a bin that one task ranks, about.
RANKED = 20_000
#: Places of pieces to be cut that are broadcast, 16 bytes each, at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def combinations(bins: int) -> np.ndarray:
    """Rows of bin numbers (1 to bins, 0: none), descending, that sum to `bins`: depth 1, 2 and 3."""
    out = [(bins, 0, 0)] + [(a, bins - a, 0) for a in range(bins - 1, (bins - 1) // 2, -1) if bins - a <= a]
    for a in range(bins - 2, (bins + 2) // 3 - 1, -1):
        rest = bins - a
        out += [(a, b, rest - b) for b in range(min(a, rest - 1), (rest + 1) // 2 - 1, -1)]
    return np.array(out, np.int64)


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method, several columns a step; memory follows a, not its square."""
    right = a.T @ b
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = tolerance * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        slope = a.T @ (b - a @ x)
        slope[passive] = 0
        best = np.argsort(-slope)[:8]
        best = best[slope[best] > scale]
        if not len(best) or passive.sum() >= a.shape[0]:
            break
        passive[best] = True
        while passive.any():
            on = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, on], b, rcond=1e-10)[0]
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-30))
            x[on] += step * (z - x[on])
            drop = on[(x[on] <= 1e-12) & low]
            x[drop] = 0
            passive[drop] = False
            if not len(drop):
                passive[on[low]] = False
                x[on[low]] = 0
    return x


def plan(counts: np.ndarray, bins: int, least: float = LEAST_FILL) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """([(pieces of each bin, repeats)], pieces of each bin to cut and lay end to end) for counts of bins 1 to bins."""
    left = counts.astype(np.int64).copy()
    patterns: list[tuple[dict[int, int], int]] = []
    if left.sum():
        combos = combinations(bins)
        a = np.zeros((bins + 1, len(combos)))
        for d in range(3):
            np.add.at(a, (combos[:, d], np.arange(len(combos))), 1)
        x = np.floor(nnls(a[1:], left[1:].astype(float)) + 1e-9).astype(np.int64)
        for c in np.argsort(-x):
            need = {int(k): int((combos[c] == k).sum()) for k in set(combos[c]) if k}
            times = min(int(x[c]), *(int(left[k]) // n for k, n in need.items()))
            if times > 0:
                patterns.append((need, times))
                for k, n in need.items():
                    left[k] -= n * times
    while left[1:].any():  # greedy: the largest bin, then the largest that still fit, as often as all of them last
        room, need = bins, {}
        while room and (fits := np.flatnonzero(left[1 : room + 1] > np.array([need.get(k, 0) for k in range(1, room + 1)]))).size:
            k = int(fits[-1]) + 1
            n = int(min(room // k, left[k] - need.get(k, 0)))
            need[k] = need.get(k, 0) + n
            room -= k * n
        times = min(int(left[k]) // n for k, n in need.items())
        if (bins - room) < least * bins:
            break
        patterns.append((need, times))
        for k, n in need.items():
            left[k] -= n * times
    return patterns, left


def _pieces(path: str, window: int, end: int, slice_bytes: int, kept: int):
    def run(batches):
        for batch in merged(batches, limit=slice_bytes):
            off, ids = encoder(path, True, kept).encode(texts(batch))
            doc, rows = batch.column("doc_id").to_pylist(), []
            for d, a, b in zip(doc, off.tolist(), off[1:].tolist()):
                n = b - a + 1
                whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                rows += [(d, s, min(window, n - s), u32_crc(whole[s : s + window]), n, whole[s : s + window].tobytes()) for s in range(0, n, window)]
            cols = list(zip(*rows))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols)], names)

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END_ID, slice_bytes: int = 10 << 20, kept: int = KEPT_UNITS) -> DataFrame:
    """The ids of docs (doc_id, text) cut at multiples of the window; ids: little-endian unsigned 32 bit.

    A worker's memory follows slice_bytes (text at once) and kept (cached units); smaller is slower."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, window, end, slice_bytes, kept), PIECE + ", ids binary")


def _cut(window: int):
    def run(batches):
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, at, place = np.frombuffer(r["ids"], "<u4"), 0, r["place"]
                while at < len(ids):
                    n = min(len(ids) - at, window - place % window)
                    rows.append((r["doc_id"], r["start"] + at, n, u32_crc(ids[at : at + n]), r["doc_tokens"], r["first"] + place // window, place % window))
                    at, place = at + n, place + n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    return run


def pack(cut: DataFrame, window: int = WINDOW, grid: int = GRID, least: float = LEAST_FILL) -> DataFrame:
    """Pieces of `pieces` with their sequence_id and offset. They are written once and read by narrow columns."""
    spark = cut.sparkSession
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces", compression="zstd")
    bins = window // grid
    full = F.col("length") == window
    count = {r["bin"]: r["n"] for r in rows.where(~full).groupBy(F.ceil(F.col("length") / grid).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()}  # at most `bins` rows
    n_full = rows.where(full).count()
    counts = np.zeros(bins + 1, np.int64)
    for k, n in count.items():
        counts[k] = n
    patterns, left = plan(counts, bins, least)
    salts = max(64, math.ceil(max(int(counts.max(initial=0)), n_full, int(left.sum())) / RANKED))  # by the largest that is ranked

    def ranked(df: DataFrame, keys: list[str], what) -> DataFrame:
        """df with `before`: the sum of `what` over the rows before it with the same keys, counted in two levels."""
        df = df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row"), F.lit(salts)).cast("int"))
        own = df.withColumn("local", F.sum(what).over(Window.partitionBy(*keys, "salt").orderBy("doc_id", "start", "row").rowsBetween(Window.unboundedPreceding, -1)))
        group = df.groupBy(*keys, "salt").agg(F.sum(what).alias("n"))
        group = group.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        return own.join(group, [*keys, "salt"]).withColumn("before", F.coalesce("local", F.lit(0)) + F.col("ahead")).drop("local", "ahead", "salt")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    narrow = rows.select(*columns, "row")
    place, base = [], n_full  # (bin, from rank, pieces each, first sequence)
    used = np.zeros(bins + 1, np.int64)
    for need, times in patterns:
        for k, n in sorted(need.items()):
            place.append({"bin": k, "lo": int(used[k]), "hi": int(used[k]) + n * times, "each": n, "base": base})
            used[k] += n * times
        base += times
    out = [ranked(narrow.where(full).withColumn("one", F.lit(0)), ["one"], F.lit(1)).select(*columns, F.col("before").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))] if n_full else []
    if count:
        binned = ranked(narrow.where(~full).withColumn("bin", F.ceil(F.col("length") / grid).cast("int")), ["bin"], F.lit(1))
        schema = "array<struct<bin: int, lo: bigint, hi: bigint, each: bigint, base: bigint>>"
        table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(place)), schema)))  # a few rows for each bin
        dealt = binned.join(F.broadcast(table), "bin", "left").where(F.col("lo").isNull() | (F.col("before") >= F.col("lo")) & (F.col("before") < F.col("hi"))) if place else None
        if place:
            seq = (F.col("base") + F.expr("(before - lo) div each")).alias("sequence_id")
            sized = dealt.where(F.col("lo").isNotNull()).select(*columns, "row", seq)
            within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)  # a window's worth of rows at most
            out.append(sized.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).select(*columns, "sequence_id", "offset"))
        if left.any():
            limits = json.dumps([{"bin": k, "hi": int(used[k])} for k in range(1, bins + 1) if left[k]])
            rest = binned.join(F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(limits), "array<struct<bin: int, hi: bigint>>")))), "bin").where(F.col("before") >= F.col("hi"))
            rest = ranked(rest.select(*columns, "row").withColumn("one", F.lit(0)), ["one"], F.col("length")).select("row", F.col("before").alias("place"))
            n_left = int(left.sum())
            mine = rows.join(F.broadcast(rest) if n_left <= BROADCAST_ROWS else rest, "row").withColumn("first", F.lit(base))
            out.append(mine.select("doc_id", "start", "doc_tokens", "ids", "place", "first").mapInArrow(_cut(window), PIECE + ", sequence_id long, offset long"))
    done = out[0] if out else narrow.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in out[1:]:
        done = done.unionByName(part)
    return done
