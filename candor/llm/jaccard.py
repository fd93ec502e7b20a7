"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their groups.

1. Each text gives its set of shingles (64-bit hashes) and a digest of the set. Equal sets are one class, and only
   its smallest doc_id goes on. A count sketch of all shingles (2 ** sketch_bits saturating bytes, fixed size)
   is summed over the tasks and broadcast: it orders shingles, rarest first. Any fixed order gives the same
   links; the sketch only decides how many candidates there are.
2. Two sets of sizes n and m with 100 |A & B| >= t |A | B| share one of their first n - ceil(t n / 100) + 1
   shingles. Those that the sketch has seen once are in no other text; the others are the entries that are joined.
3. Shingles with few entries give pairs, cut by the length filter and the positional filter. Of a shingle with many,
   all entries are paired with one of them, the pivot; PIVOTS times, each time only where the links so far leave
   several components among the entries.
4. Pairs are distinct, and are verified once on the sets themselves, after the suffix filter (the counts of both
   sets in ranges of the hash bound their difference from below).
5. What pivots leave apart is compared by blocks of documents of one size band: each two blocks of adjacent bands
   are compared as matrices in one task, which returns no more links than it takes to connect what it found. Blocks
   are those of the entries of one shingle, or of all documents that such shingles connect (a family), whichever
   is less work; blocks within a component of links aren't compared.
6. Links between classes are contracted to components; every document gets the smallest doc_id of its component.

Null and blank texts have no shingles and are linked with nothing; texts of fewer words than a shingle have one,
the whole sequence. Rows that share a doc_id are one document with the links of each; a null doc_id has no
component. Very long texts give long sets, and empty tables no rows. Only doc_id and text are read. Joins are by
shuffles that salt hot keys: a group of copies of any size, a pivot or a component is never one task's work.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import even_join, few_parts, written
from .units import coded, lower_ascii, resident, slices, split_words, texts

SKETCH_BITS = 26
CHUNK_BITS = 19
#: Shingles with more entries than this are paired with pivots, and compared by blocks where these leave them apart.
PAIRED = 8
PIVOTS = 1
BLOCK = 128
#: Shingles of a pair of blocks that are compared at once, about.
RANGE_SHINGLES = 300_000
#: Ids of documents to be read again go to all tasks up to this number, 16 MB; beyond it they are joined.
BROADCAST_IDS = 2_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def shingle_sets(values: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    import xxhash

    off, words = split_words(lower_ascii(values))
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(values)
    codes, distinct = coded(words)
    w = np.array([xxhash.xxh3_64_intdigest(b) for b in distinct.cast(pa.binary()).to_pylist()], np.uint64)[codes]
    h = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for k in range(n):
        h = _mix((h ^ w[k : len(w) - n + 1 + k]) * _P)
    out = []
    for a, b in zip(off.tolist(), off[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        else:
            x = np.full(min(1, b - a), b - a, np.uint64)
            for k in range(a, b):
                x = _mix((x ^ w[k]) * _P)
            out.append(x)
    return out


# --- first pass: classes and sketch


def _chunks(seen: list[np.ndarray], bits: int):
    """Rows (chunk, blob) with how often each bucket was seen."""
    at, count = np.unique(np.concatenate(seen), return_counts=True)
    per = min(bits, CHUNK_BITS)
    edges = np.searchsorted(at, np.arange(0, (1 << bits) + 1, 1 << per))
    for c, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            bitmap = np.zeros(1 << per, np.uint8)
            bitmap[at[a:b] - (c << per)] = 1
            packed = np.packbits(bitmap).tobytes()
            yield c, zlib.compress(packed + np.minimum(count[a:b], 255).astype(np.uint8).tobytes(), 1)


def _profile(n: int, bits: int):
    def run(batches):
        names = ["doc_id", "n", "s1", "s2", "chunk", "blob"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        resident(None)
        seen, held = [], 0
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in slices(batches):
            rows = []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts(batch), n)):
                one, two = (int(np.add.reduce(_mix(s * p), dtype=np.uint64).astype(np.int64)) for p in (_P, _Q))
                rows.append((doc_id, len(s), one, two, None, None))
                seen.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                held += len(s)
            yield make(rows)
            if held > 3_000_000:
                yield make([(None, None, None, None, *c) for c in _chunks(seen, bits)])
                seen, held = [], 0
        if held:
            yield make([(None, None, None, None, *c) for c in _chunks(seen, bits)])

    return run


def _summed(per: int):
    def run(table):  # without hints, which Spark would try to read
        total = np.zeros(1 << per, np.uint16)
        for blob in table.column("blob").to_pylist():
            raw = zlib.decompress(blob)
            bitmap = np.unpackbits(np.frombuffer(raw, np.uint8, max(1, (1 << per) // 8)))[: 1 << per]
            total[bitmap == 1] += np.frombuffer(raw, np.uint8, offset=max(1, (1 << per) // 8))
            np.minimum(total, 255, out=total)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "blob": pa.array([zlib.compress(total.astype(np.uint8).tobytes(), 1)])})

    return run


def _sketch(broadcast, bits: int) -> np.ndarray:
    """The broadcast sketch, opened once in each worker."""
    key, parts = broadcast.value["key"], broadcast.value["chunks"]

    def opened():
        per = min(bits, CHUNK_BITS)
        out = np.zeros(1 << bits, np.uint8)
        for c, blob in parts.items():
            out[c << per : (c + 1) << per] = np.frombuffer(zlib.decompress(blob), np.uint8)
        return out

    return resident(("sketch", key), opened)


# --- second pass: entries


def needed(n: int, t: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-t * n // 100)


def _entries(n: int, t: int, bits: int, broadcast):
    def run(batches):
        for batch in slices(batches):
            counts, hs, ids, sizes, places = _sketch(broadcast, bits), [], [], [], []
            for doc_id, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(texts(batch), n)):
                if doc_id is None or not len(s):
                    continue
                c = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                p = len(s) - needed(len(s), t) + 1
                order = np.lexsort((s, c))[:p]
                keep = np.flatnonzero(c[order] >= 2)
                hs.append(s[order[keep]].view(np.int64))
                places.append(keep)
                ids.append(np.full(len(keep), doc_id, np.int64))
                sizes.append(np.full(len(keep), len(s), np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, sizes, places)], ["h", "doc_id", "n", "place"])

    return run


# --- verification


def _sets(n: int):
    def run(batches):
        resident(None)
        for batch in slices(batches):
            got = shingle_sets(texts(batch), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in got], pa.binary())], ["doc_id", "set"])

    return run


_RANGES = (np.arange(1, 64, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def linked(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    """100 |a & b| >= t |a | b|, for sorted arrays of distinct hashes."""
    n, m = len(a), len(b)
    most = n + m - 2 * -(-t * (n + m) // (100 + t))  # of elements in one set only
    at = lambda s: np.diff(np.concatenate([[0], np.searchsorted(s, _RANGES), [len(s)]]))
    if np.abs(at(a) - at(b)).sum() > most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= t * (n + m - both)


def _verify(t: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), t) for x, y in zip(a, b)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def spanning(ids: list[int], side: list[bool], sets: list[np.ndarray], t: int, within: bool) -> list[tuple[int, int]]:
    """Links that connect all that is linked among sets (within) or from one side to the other, a forest of them."""
    size = np.array([len(s) for s in sets], np.float64)
    both = np.zeros((len(sets), len(sets)))
    ranges = max(1, int(size.sum()) // RANGE_SHINGLES)  # of hashes, so that memory doesn't follow the texts' length
    cuts = [(k * (1 << 64)) // ranges for k in range(1, ranges)]
    ends = [[0, *np.searchsorted(s, np.array(cuts, np.uint64)).tolist(), len(s)] for s in sets]
    for k in range(ranges):
        parts = [s[e[k] : e[k + 1]] for s, e in zip(sets, ends)]
        row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(p) for p in parts])
        _, code, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        shared = count[code] > 1
        row, code = row[shared], code[shared]
        if not len(row):
            continue
        code = np.unique(code, return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for lo in range(0, int(code[-1]) + 1, 4096):
            a, b = np.searchsorted(code, [lo, lo + 4096])
            x = np.zeros((len(sets), min(4096, int(code[-1]) + 1 - lo)), np.float32)
            x[row[a:b], code[a:b] - lo] = 1
            both += x @ x.T
    hit = (100 * both >= t * (size[:, None] + size[None, :] - both)) & (both > 0)
    first = np.array(side)
    hit &= np.triu(np.ones_like(hit), 1) if within else first[:, None] & ~first[None, :]
    parent = list(range(len(sets)))

    def find(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    out = []
    for a, b in zip(*np.nonzero(hit)):
        x, y = find(int(a)), find(int(b))
        if x != y:
            parent[x] = y
            out.append((ids[a], ids[b]))
    return out


def _blocks(t: int):
    def run(key, table):
        resident(None)
        r = table.to_pylist()
        within = key[1].as_py() == key[2].as_py()
        out = spanning([x["doc_id"] for x in r], [x["first"] for x in r], [np.frombuffer(x["set"], np.uint64) for x in r], t, within)
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return run


def _link_blocks(groups: DataFrame, sets: DataFrame, t: int, block: int) -> DataFrame:
    """Links inside of groups (family, doc_id, n, c: component of the links so far), by blocks."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / t)) + 1e-9).cast("long") if t < 100 else F.col("n")
    docs = written(groups.withColumn("band", band), "block-docs")
    total = docs.count()
    own = docs.groupBy("family", "band", "c").agg(F.count("*").alias("rows"))
    # components beyond a block have blocks of their own (of: their number), the others share some (of: null)
    kinds = own.withColumn("of", F.when(F.col("rows") > block, F.col("c")))
    docs = even_join(docs, kinds, ["family", "band", "c"], total, F.col("doc_id"))
    blocks = kinds.groupBy("family", "band", "of").agg(F.sum("rows").alias("rows")).withColumn("parts", F.ceil(F.col("rows") / block).cast("long"))
    lists = blocks.groupBy("family", "band").agg(F.collect_list(F.struct("of", "parts")).alias("list"), F.sum("rows").alias("rows"))  # one for each component beyond a block
    docs = even_join(docs, lists, ["family", "band"], total, F.col("doc_id"))
    mine = F.filter("list", lambda x: x["of"].eqNullSafe(F.col("of")))[0]["parts"]
    docs = docs.withColumn("part", F.pmod(F.xxhash64(F.coalesce("of", "c"), F.when(F.col("of").isNotNull(), F.col("doc_id"))), mine)).drop("list")
    # each block with those of its own band and of the bands beside it
    beside = docs.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    reached = lists.select("family", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "rows").groupBy("family", "band").agg(F.sum("rows").alias("rows"))
    lists = lists.select("family", "band", "list").join(reached, ["family", "band"]).withColumnRenamed("band", "band2")
    spread = even_join(beside, lists, ["family", "band2"], 3 * total, F.col("doc_id")).select("*", F.explode("list").alias("other"))
    spread = spread.where(F.col("of").isNull() | F.col("other.of").isNull() | (F.col("of") != F.col("other.of")))
    spread = spread.withColumn("part2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other.parts") - 1)))
    name = lambda *c: F.struct(*(F.coalesce(x, F.lit(-1).cast("long")).alias(f"x{k}") for k, x in enumerate(c)), c[1].isNull().alias("x3"))
    x, y = name(F.col("band"), F.col("of"), F.col("part")), name(F.col("band2"), F.col("other.of"), F.col("part2"))
    tasks = spread.select("family", F.least(x, y).alias("one"), F.greatest(x, y).alias("two"), "doc_id", (x <= y).alias("first"))
    return tasks.join(sets, "doc_id").groupBy("family", "one", "two").applyInArrow(_blocks(t), "u long, v long")


# --- the operator


def _apart(entries: DataFrame, found: DataFrame) -> tuple[DataFrame, int]:
    """The entries (h, doc_id, n, place) of shingles whose documents lie in several components found, with these (c)."""
    found = found.select(F.col("node").alias("doc_id"), F.col("component"))
    known = written(entries.select("h", "doc_id", "n", "place").join(found, "doc_id", "left").select("h", "doc_id", "n", "place", F.coalesce("component", "doc_id").alias("c")), "hot")
    total = known.count()
    several = known.groupBy("h").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("rows")).where("x <> y").select("h", "rows")
    left = written(few_parts(even_join(known, several, ["h"], total, F.col("doc_id")), total), "apart")
    return left, left.count()


def _stars(left: DataFrame, rows: int, turn: int, t: int) -> DataFrame:
    """Candidates (u, v) of each shingle's entries with one of them that a hash picks, in another component than they."""
    pick = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("by"), "doc_id", "n", "place", "c")).alias("p")
    pivot = left.groupBy("h").agg(pick, F.count("*").alias("rows")).select("h", F.col("p.doc_id").alias("v"), F.col("p.n").alias("m"), F.col("p.place").alias("q"), F.col("p.c").alias("of"), "rows")
    return _candidates(even_join(left, pivot, ["h"], rows, F.col("doc_id")).where("c <> of"), t)


def _candidates(x: DataFrame, t: int) -> DataFrame:
    """The distinct pairs (u, v) of x (doc_id, n, place, and the same of the other: v, m, q) that the filters leave."""
    least, most = F.least("n", "m"), F.greatest("n", "m")
    bound = F.least("place", "q") + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q"))
    kept = x.where((F.col("doc_id") != F.col("v")) & (100 * least >= t * most) & ((100 + t) * bound >= t * (F.col("n") + F.col("m"))))
    return kept.select(F.least("doc_id", "v").alias("u"), F.greatest("doc_id", "v").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (u, v) of a written table that link, each compared once; a document of very many pairs is salted."""
    total = pairs.count()

    def with_set(rows: DataFrame, side: str, name: str, other: str) -> DataFrame:
        times = pairs.groupBy(side).agg(F.count("*").alias("rows"))
        return even_join(rows, sets.select(F.col("doc_id").alias(side), F.col("set").alias(name)).join(times, side), [side], total, F.col(other), unique=False)

    both = with_set(with_set(pairs, "u", "a", "v"), "v", "b", "u")
    return both.select("u", "v", "a", "b").mapInArrow(_verify(t), "u long, v long")


def groups(docs: DataFrame, n: int = 5, t: int = 80, sketch_bits: int = SKETCH_BITS, paired: int = PAIRED, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): n words a shingle, similarity t percent."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = written(text.mapInArrow(_profile(n, sketch_bits), "doc_id long, n long, s1 long, s2 long, chunk int, blob binary"), "profiles")
    meta = both.where("n is not null").select("doc_id", "n", "s1", "s2")
    total = meta.count()
    per = min(sketch_bits, CHUNK_BITS)
    chunks = {r["chunk"]: bytes(r["blob"]) for r in both.where("chunk is not null").select("chunk", "blob").groupBy("chunk").applyInArrow(_summed(per), "chunk int, blob binary").collect()}  # 2 ** sketch_bits bytes at most
    sketch = sc.broadcast({"key": uuid.uuid4().hex, "chunks": chunks})
    filled = meta.where("n > 0 and doc_id is not null")
    classes = written(few_parts(filled.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), total), "classes")
    # the representative of each row, its own document if it has none
    named = even_join(filled, classes.where("rows > 1"), ["n", "s1", "s2"], total, F.col("doc_id"), "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    named = written(few_parts(named.unionByName(meta.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("rep"))), total), "named")
    many_texts = named.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y"), F.count("*").alias("rows")).where("x <> y").select("doc_id", "rows")
    same = None
    if not many_texts.isEmpty():
        same = even_join(named, many_texts, ["doc_id"], total, F.xxhash64("rep")).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()

    entries = text.mapInArrow(_entries(n, t, sketch_bits, sketch), "h long, doc_id long, n long, place long")
    entries = written(entries.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), "entries")
    sketch.destroy()
    number = entries.count()
    few = lambda df: few_parts(df, number)
    count = written(few(entries.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1")), "counts")
    shared = even_join(entries, count.withColumn("often", F.col("rows") > paired), ["h"], number, F.col("doc_id"))
    shared = written(few(shared.select("h", "doc_id", "n", "place", "often")), "shared")
    x = shared.where("not often").drop("often")
    pairs = _candidates(x.join(x.select("h", F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("place").alias("q")), "h").where("doc_id < v"), t)
    hot = shared.where("often").drop("often")
    rows = hot.count()
    if rows and pivots:
        pairs = pairs.unionByName(_stars(hot.withColumn("c", F.col("doc_id")), rows, 0, t)).distinct()
    pairs = written(few(pairs), "pairs")
    ids = written(few(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).union(hot.select("doc_id")).distinct()), "wanted")
    near = text.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = written(near.mapInArrow(_sets(n), "doc_id long, set binary"), "sets")
    links = _verified(pairs, sets, t)
    links = written(few(links.unionByName(same) if same else links), "links")
    found = components(links)
    left, rows = _apart(hot, found) if rows else (hot, 0)
    for turn in range(1, pivots):
        if not rows:
            break
        star = written(few(_stars(left, rows, turn, t)), "star")
        links = written(few(links.unionByName(_verified(star, sets, t))), "links")
        found = components(links)
        left, rows = _apart(left, found)
    if rows:
        found = components(links.unionByName(_link_blocks(_cheapest(left), sets, t, block)))
    sizes = named.groupBy("rep").agg(F.count("*").alias("rows"))
    found = found.withColumnRenamed("node", "rep").join(sizes, "rep")
    return even_join(named, found, ["rep"], total, F.col("doc_id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _cheapest(left: DataFrame) -> DataFrame:
    """(family, doc_id, n, c): documents to be compared, by shingle or by the family that shingles connect, whichever has fewer pairs."""
    total = left.count()
    hubs = left.groupBy("h").agg(F.min("doc_id").alias("hub"), F.count("*").alias("rows"))
    family = components(even_join(left, hubs, ["h"], total, F.col("doc_id")).select(F.col("doc_id").alias("u"), F.col("hub").alias("v")))
    of = hubs.join(family.withColumnRenamed("node", "hub"), "hub")
    cost = of.groupBy("component").agg(F.sum(F.col("rows").cast("double") * F.col("rows")).alias("by_shingle"))
    cost = cost.join(family.groupBy("component").agg(F.count("*").cast("double").alias("all")), "component")
    way = of.join(cost, "component").select("h", "rows", F.when(F.col("by_shingle") < F.col("all") * F.col("all"), F.col("h")).otherwise(F.col("component")).alias("family"), (F.col("by_shingle") < F.col("all") * F.col("all")).alias("own"))
    dealt = even_join(left, way, ["h"], total, F.col("doc_id"))
    return dealt.select(F.xxhash64("own", "family").alias("family"), "doc_id", "n", "c").distinct()


def one_of_each(docs: DataFrame, n: int = 5, t: int = 80, **options) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, or null, with all columns."""
    gone = written(groups(docs, n, t, **options).where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)
