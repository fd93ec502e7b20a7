"""Language-model scoring: a log-bilinear model trained by noise-contrastive estimation, beside a unigram base.

1. Texts are tokenised in blocks (one task's rows, bounded); a block holds the codes of its tokens and its distinct
   words with their training counts, so that each word is counted and looked up once a block, not once a place.
   Counts are summed over all training documents by word and go back to the blocks. A block's words travel once, as
   one compressed row for each part of all words (by crc32); counts and places in the order of the part come back
   for the block's codes, and codes are compressed by slice of texts. Tables that have been read are deleted.
2. Classes of the neural model: the end, the unknown word and every training word counted `least_count` times or
   more, which is 5 and, beyond 102,400 training tokens, a 64th of the root of their number. So the vocabulary
   grows with the corpus, and has at most 64 times that root of words. A rarer word costs the unknown class and its
   smoothed share among all such words, so the model is a distribution over texts.
3. Each task trains a copy of the model on all its training tokens (ROUNDS parts of them, one after the other);
   after each part the copies are averaged, weighted by their tokens, in two levels. A minibatch is a number of
   stretches of text. Noise comes from the unigram distribution of classes, and is shared by a minibatch, so all of
   it is batched matrix products.
4. Above FLAT classes these lie in groups of about equal mass (neighbours by frequency), with parameters of their own
   that are trained the same way. A class has the probability of its group times its own within the group, which is
   one for a class that has its group alone. Both are normalised exactly, by batched matrix products, so a token costs
   about twice the root of the vocabulary; normalisers of pairs of frequent words are made once.

Blocks, copies and sums go by numbers of partitions, so that the same files give the same scores.

Null and empty texts are one end token. Training leaves out documents whose crc32(doc_id as text) mod 5 is 1, and
those without a doc_id. Without training tokens the base is uniform over nothing (0), and so is the score. Ties
of frequency go to the smaller word. Repeated rows are rows of their own. A text is one row of a block however
long it is; extra columns aren't carried.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, written
from .units import as_utf8, coded, lower_ascii, resident, slices, split_words, texts

WIDTH, CONTEXT, ROUNDS = 32, 2, 2
LEAST, ROOT, FLAT = 5, 64, 256
#: Normalisers are made once for all pairs of so many classes (64 MB) and for pairs of EDGE with any other.
FREQUENT, EDGE = 4096, 32
#: Groups of classes for each root of the vocabulary.
GROUPS = 2
BATCH, STRETCH, NOISE, RATE = 1536, 64, 32, 0.15
BLOCK_WORDS, BLOCK_TOKENS = 500_000, 6_000_000
#: One part of all words for so many bytes of input, between the least and the greatest number of parts.
PART_BYTES, PARTS = 32 << 20, (64, 4096)
END, UNKNOWN = 0, 1
#: Stands for the end token among words; no word holds a blank.
_END_WORD = " "
#: Rows of texts (part is null: the texts of a slice) and rows of words (of a block and a part).
_BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, n_tokens array<long>, codes binary, part int, lengths binary, words binary, counts binary"
#: Rows of a block and a part, rows of words, and a row for each part with its sums.
_COUNTED = "block long, part int, codes binary, counts binary, ranks binary, word string, rank int, c long, distinct long"


def least_count(total: int) -> int:
    """Training count from which a word is a class of its own."""
    return max(LEAST, math.isqrt(total) // ROOT)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


# --- blocks


def packed(values: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, and so on, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of n rows whose other columns are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    return pa.schema([(name, types[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


class _Block:
    def __init__(self, number: int):
        self.id = number
        self.words, self.counts, self.tokens = pa.array([_END_WORD], pa.string()), np.zeros(1, np.int64), 0

    def add(self, values: pa.Array, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, codes) of the texts, each with its end token (code 0)."""
        off, words = split_words(lower_ascii(values))
        codes, distinct = coded(words) if len(words) else (np.zeros(0, np.int64), pa.array([], pa.string()))
        at = pc.index_in(distinct, self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, distinct.take(pa.array(new))])
        n = np.diff(off) + 1
        out_off = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(out_off[-1], np.int32)
        inner = np.ones(len(out), bool)
        inner[out_off[1:] - 1] = False
        out[inner] = at[codes]
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.counts += np.bincount(out[np.repeat(training, n)], minlength=len(self.words))
        self.tokens += len(out)
        return out_off, out

    def dictionary(self, parts: int) -> pa.RecordBatch:
        """One row for each part of all words that the block has words of; codes as their differences."""
        part = np.array([zlib.crc32(w) % parts for w in self.words.cast(pa.binary()).to_pylist()], np.int32)
        order = np.argsort(part, kind="stable")
        off, data = as_utf8(self.words.take(pa.array(order)))
        own, first = np.unique(part[order], return_index=True)
        edges = [*first.tolist(), len(order)]
        runs = [slice(a, b) for a, b in zip(edges, edges[1:])]
        lengths, counts = np.diff(off), self.counts[order]
        return _rows(
            _arrow(_BLOCKS), len(own), block=np.full(len(own), self.id, np.int64), part=own, codes=[packed(np.diff(order[r], prepend=0).astype(np.int32)) for r in runs], lengths=[packed(lengths[r]) for r in runs],
            words=[pa.compress(data[off[r.start] : off[r.stop]].tobytes(), "zstd", asbytes=True) for r in runs], counts=[packed(counts[r]) for r in runs],
        )


def _blocks(parts: int):
    def run(batches):
        from pyspark import TaskContext

        resident(None)
        number = TaskContext.get().partitionId() << 32  # blocks are numbered by the data, so that scores repeat
        block = _Block(number)
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            held = np.array([held_out(i) for i in ids])
            off, codes = block.add(texts(batch), ~held & np.array([i is not None for i in ids]))
            yield _rows(_arrow(_BLOCKS), 1, block=[block.id], doc_ids=[ids], held_out=[held], n_tokens=[np.diff(off)], codes=[packed(codes)])
            if len(block.words) > BLOCK_WORDS or block.tokens > BLOCK_TOKENS:
                yield block.dictionary(parts)
                number += 1
                block = _Block(number)
        if block.tokens:
            yield block.dictionary(parts)

    return run


def _counted(least: int):
    """Of one part of all words: sums, the words counted `least` times or more in order, and for each block the counts
    and places (from 1, 0 for no such word) of its words."""

    def run(table):
        lengths = [unpacked(x.as_py(), np.int64) for x in table.column("lengths")]
        data = b"".join(pa.decompress(x.as_py(), int(n.sum()), "zstd", asbytes=True) for x, n in zip(table.column("words"), lengths))
        edges = np.cumsum([0, *map(len, lengths)])
        off = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int64)
        codes, words = coded(pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(data)))
        c = np.zeros(len(words), np.int64)
        np.add.at(c, codes, np.concatenate([unpacked(x.as_py(), np.int64) for x in table.column("counts")]))
        end = pc.equal(words, _END_WORD).to_numpy(zero_copy_only=False)
        own = np.flatnonzero((c >= least) & ~end)
        own = own[pc.sort_indices(pa.table({"c": c[own], "word": words.take(pa.array(own))}), sort_keys=[("c", "descending"), ("word", "ascending")]).to_numpy()]
        place = np.zeros(len(words), np.int32)
        place[own] = np.arange(len(own)) + 1
        shown = np.concatenate([own, np.flatnonzero(end & (c > 0))])
        part, schema = table.column("part")[0].as_py(), _arrow(_COUNTED)
        runs = [codes[a:b] for a, b in zip(edges, edges[1:])]
        return pa.Table.from_batches(
            [
                _rows(schema, len(runs), block=table.column("block").combine_chunks(), part=np.full(len(runs), part), codes=table.column("codes").combine_chunks(), counts=[packed(c[r]) for r in runs], ranks=[packed(place[r]) for r in runs]),
                _rows(schema, len(shown), part=np.full(len(shown), part), word=words.take(pa.array(shown)).cast(pa.string()), rank=place[shown], c=c[shown]),
                _rows(schema, 1, part=[part], c=[int(c.sum())], distinct=[int((c > 0).sum())]),
            ]
        )

    return run


def _looked_up(total: int, distinct: int, rest: int, rest_distinct: int, vocabulary):
    """Rows of a block with their base score, their classes and what their unknown words cost within the class.

    vocabulary: the classes of the words of each part in their order, one part after the other, and where parts begin.
    """

    def run(left, right):
        own, starts = vocabulary.value["cls"], vocabulary.value["starts"]
        at = [np.cumsum(unpacked(x.as_py(), np.int32)) for x in right.column("codes")]
        size = max((int(x[-1]) for x in at), default=0) + 1
        c, cls = np.zeros(size), np.full(size, UNKNOWN, np.int32)
        for code, part, counts, ranks in zip(at, right.column("part").to_pylist(), right.column("counts"), right.column("ranks")):
            c[code] = unpacked(counts.as_py(), np.int64)
            place = unpacked(ranks.as_py(), np.int32)
            known = np.flatnonzero((place > 0) & (place <= starts[part + 1] - starts[part]))
            cls[code[known]] = own[starts[part] + place[known] - 1]
        cls[END] = END
        inner = np.where(cls == UNKNOWN, np.log10((c + 0.5) / (rest + 0.5 * (rest_distinct + 1))), 0.0)
        base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
        ids, held, n = (left.column(x).combine_chunks().flatten() for x in ("doc_ids", "held_out", "n_tokens"))
        off = np.concatenate([[0], np.cumsum(n.to_numpy())])
        codes = np.concatenate([np.zeros(0, np.int32), *(unpacked(x.as_py(), np.int32) for x in left.column("codes"))])
        at = off[:-1]
        sums = lambda v: np.add.reduceat(v, at) if len(at) else np.zeros(0)  # noqa: E731  every text has its end
        classes = cls[codes]
        return pa.table(
            {
                "doc_id": ids, "held_out": held, "n_tokens": n, "n_known": pa.array(sums((c[codes] > 0).astype(np.int64)).astype(np.int64)),
                "base_score": pa.array(sums(base[codes])), "inner": pa.array(sums(inner[codes])), "classes": pa.array([classes[a:b].tobytes() for a, b in zip(off, off[1:])], pa.binary()),
            }
        )

    return run


# --- the model


def group_starts(prior: np.ndarray, flat: int | None = None) -> np.ndarray:
    """The first class of each group, and the number of classes; END and UNKNOWN are groups of one."""
    n, flat = len(prior), FLAT if flat is None else flat
    if n <= flat:
        return np.arange(n + 1)
    words = prior[2:].astype(np.float64) / prior[2:].sum(dtype=np.float64)
    place = np.floor((np.cumsum(words) - words) * max(flat, GROUPS * math.isqrt(n)) + 1e-9)
    return np.concatenate([[0, 1], 2 + np.flatnonzero(np.diff(place, prepend=-1)), [n]])


def log_sums(s: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exponentials of each row, computed in place."""
    top = s.max(1)
    s -= top[:, None]
    return top + np.log(np.exp(s, out=s) @ np.ones(s.shape[1], s.dtype))


def row_sums(rows: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each)"""
    order = np.argsort(rows.astype(np.uint16) if most <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class LogBilinear:
    """r: representations of context words; c: a matrix for each context place; q, gq: targets (words, groups of
    words) with their bias in the last column."""

    def __init__(self, prior: np.ndarray, width: int = WIDTH, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = len(prior)
        self.starts = group_starts(prior)
        self.group = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        with_bias = lambda d: np.concatenate([rng.normal(0, 0.1, (len(d), width)), np.log(d)[:, None]], 1)
        self.p = {"r": rng.normal(0, 0.1, (n, width)), "q": with_bias(prior), "c": np.stack([np.eye(width)] * CONTEXT)}
        self.levels = [("q", prior)]
        if len(self.starts) <= n:  # a word alone in its group has the group's probability: words of the others are told apart
            mass = np.add.reduceat(prior, self.starts[:-1])
            self.p["gq"] = with_bias(mass)
            self.shared = np.diff(self.starts)[self.group] > 1
            self.levels = [("q", np.where(self.shared, prior, 0)), ("gq", mass)]
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        with np.errstate(divide="ignore"):
            self.log_kn = {q: np.log(NOISE * d / d.sum()).astype(np.float32) for q, d in self.levels}
        self.drawn = [np.cumsum(d) / d.sum() for _, d in self.levels]

    def ready(self) -> LogBilinear:
        """With what scoring needs: the terms of words in contexts, and the normalisers of contexts of frequent words."""
        self.terms = [self.p["r"] @ c for c in self.p["c"]]
        top = self.p[self.levels[-1][0]]
        n = len(self.p["r"])

        def factors(place: int, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            x = self.terms[place][start:end] @ top[:, :-1].T
            if not place:
                x += top[:, -1]
            peak = x.max(1)
            x -= peak[:, None]
            return np.exp(x, out=x), peak

        def sums(one: tuple, two: tuple) -> np.ndarray:
            with np.errstate(divide="ignore"):
                out = np.log(one[0] @ two[0].T)
            out[out < -50] = np.nan  # the factors' peaks lie apart: not from the table
            out += one[1][:, None]
            out += two[1]
            return out

        few, edge = min(n, FREQUENT), min(n, EDGE)  # the first classes are the frequent ones
        first, second = factors(0, 0, few), factors(1, 0, few)
        self.known = sums(first, second)
        self.after, self.before = np.empty((edge, n), np.float32), np.empty((n, edge), np.float32)
        for k in range(0, n, 4096):
            self.after[:, k : k + 4096] = sums([x[:edge] for x in first], factors(1, k, k + 4096))
            self.before[k : k + 4096] = sums(factors(0, k, k + 4096), [x[:edge] for x in second])
        return self

    def _met(self, ctx: np.ndarray) -> np.ndarray:
        """The normalisers that the tables hold, not-a-number for others."""
        x, y, out = ctx[:, 0], ctx[:, 1], np.full(len(ctx), np.nan, np.float32)
        few, edge = len(self.known), len(self.after)
        for rows, table in (((x < few) & (y < few), self.known), ((x < edge) & (y >= few), self.after), ((y < edge) & (x >= few), self.before)):
            at = np.flatnonzero(rows)
            out[at] = table[x[at], y[at]]
        return out

    def log_probabilities(self, ctx: np.ndarray, target: np.ndarray, area: int = 1 << 20) -> np.ndarray:
        """Normalised natural log-probabilities of targets.

        A score is a sum of one term for each context place, so its exponential is a product of two factors, and the
        normalisers of all pairs of frequent words are a matrix product, made once.
        """
        h = np.ones((len(ctx), self.p["r"].shape[1] + 1), np.float32)
        np.take(self.terms[0], ctx[:, 0], axis=0, out=h[:, :-1])
        h[:, :-1] += self.terms[1][ctx[:, 1]]
        top = self.p[self.levels[-1][0]]
        group = self.group[target]
        out = np.einsum("bd,bd->b", h, top[group])
        sums = self._met(ctx)
        rare = np.flatnonzero(np.isnan(sums))
        step = max(1, area // len(top))
        for k in range(0, len(rare), step):
            part = rare[k : k + step]
            sums[part] = log_sums(h[part] @ top.T)
        out -= sums
        if len(self.levels) > 1:
            q, size = self.p["q"], np.diff(self.starts)
            inner = np.flatnonzero(size[group] > 1)
            inner = inner[np.argsort(group[inner].astype(np.uint16) if len(size) <= 1 << 16 else group[inner], kind="stable")]
            h = h[inner]
            got = np.einsum("bd,bd->b", h, q[target[inner]])
            edges = np.concatenate([[0], np.cumsum(np.bincount(group[inner], minlength=len(size)))])
            for g in np.flatnonzero(np.diff(edges)):
                own = q[self.starts[g] : self.starts[g + 1]]
                step = max(1, area // len(own))
                for k in range(edges[g], edges[g + 1], step):
                    part = slice(k, min(k + step, edges[g + 1]))
                    got[part] -= log_sums(h[part] @ own.T)
            out[inner] += got
        return out

    def train(self, words: np.ndarray, place: np.ndarray, state: dict, rng: np.random.Generator) -> None:
        """One step of noise-contrastive estimation on a minibatch of stretches, noise shared by all, of classes and of groups.

        words: stretches x (CONTEXT + length), the first CONTEXT only as contexts; place: the targets' places in their texts.
        """
        p, width, length = self.p, self.p["r"].shape[1], place.shape[1]
        target, m = words[:, CONTEXT:].ravel(), place.size
        vectors = p["r"][words]
        before, outside = [], []
        h = np.ones((m, width + 1), np.float32)
        for k in range(CONTEXT):
            own = vectors[:, CONTEXT - 1 - k : CONTEXT - 1 - k + length].reshape(m, width)  # a copy
            outside.append(np.flatnonzero(place.ravel() <= k))  # before a text's first word: END
            own[outside[k]] = p["r"][END]
            before.append(own)
            if k:
                h[:, :-1] += own @ p["c"][k]
            else:
                np.matmul(own, p["c"][k], out=h[:, :-1])
        if len(self.levels) == 1:
            gh = self._contrast(0, h, target, m, state, rng)
        else:
            gh = self._contrast(1, h, self.group[target], m, state, rng)
            if len(own := np.flatnonzero(self.shared[target])):
                gh[own] += self._contrast(0, h[own], target[own], m, state, rng)
        back, ends = np.zeros_like(vectors), np.zeros((1, width), np.float32)
        for k in range(CONTEXT):
            part = gh @ p["c"][k].T
            ends += part[outside[k]].sum(0)
            part[outside[k]] = 0
            back[:, CONTEXT - 1 - k : CONTEXT - 1 - k + length] += part.reshape(len(words), length, width)
            grad = before[k].T @ gh / m
            state["c"][k] += grad**2
            p["c"][k] += RATE * grad / np.sqrt(state["c"][k] + 1e-6)
        self._add("r", np.append(words.ravel(), END), np.concatenate([back.reshape(-1, width), ends]), m, state)

    def _contrast(self, level: int, h: np.ndarray, want: np.ndarray, m: int, state: dict, rng: np.random.Generator) -> np.ndarray:
        """Tells the wanted rows from noise, moves both; returns the gradient by h without its last column."""
        q, log_kn, drawn, n = self.levels[level][0], self.log_kn[self.levels[level][0]], self.drawn[level], len(want)
        noise = np.minimum(np.searchsorted(drawn, rng.random(NOISE), side="right"), len(drawn) - 1)
        right, wrong = self.p[q][want], self.p[q][noise]
        data = np.einsum("bd,bd->b", h, right)
        data -= log_kn[want]
        g = (1 / (1 + np.exp(data)))[:, None]  # of the log-likelihood by the data scores
        e = h @ wrong.T
        np.subtract(log_kn[noise], e, out=e)
        np.exp(e, out=e)
        e += 1
        np.divide(-1, e, out=e)  # and by the noise scores
        right *= g
        gh = e @ np.ascontiguousarray(wrong[:, :-1])
        gh += right[:, :-1]
        grad = np.empty((n + NOISE, h.shape[1]), np.float32)
        np.multiply(h, g, out=grad[:n])
        np.matmul(e.T, h, out=grad[n:])
        self._add(q, np.concatenate([want, noise]), grad, m, state)
        return gh

    def _add(self, name: str, rows: np.ndarray, grad: np.ndarray, m: int, state: dict) -> None:
        own, g = row_sums(rows, grad, len(self.p[name]))
        g /= m
        square = state[name][own]
        square += g * g
        state[name][own] = square
        g /= np.sqrt(square + np.float32(1e-6))
        g *= np.float32(RATE)
        self.p[name][own] += g

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self


def contexts(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The CONTEXT classes before each token, nearest first; END before a text's first token."""
    out = np.zeros((len(classes), CONTEXT), np.int64)
    place = np.arange(len(classes)) - starts
    for k in range(CONTEXT):
        has = place > k
        out[has, k] = classes[np.flatnonzero(has) - k - 1]
    return out


def minibatches(classes: np.ndarray, starts: np.ndarray, turn: int, rng: np.random.Generator):
    """(words, places) of stretches of STRETCH tokens, one in ROUNDS of them, in random order; the last one is shorter."""
    filled = np.concatenate([np.full(CONTEXT, END), classes])
    place = np.arange(len(classes)) - starts
    full = len(classes) // STRETCH
    own = rng.permutation(np.arange(turn % ROUNDS, full, ROUNDS)) * STRETCH
    for part in np.array_split(own, max(1, len(own) * STRETCH // BATCH)) if len(own) else ():
        yield filled[part[:, None] + np.arange(CONTEXT + STRETCH)], place[part[:, None] + np.arange(STRETCH)]
    if full * STRETCH < len(classes) and full % ROUNDS == turn % ROUNDS:
        yield filled[None, full * STRETCH :], place[None, full * STRETCH :]


def _tokens(batch, only_training: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes, start of the own text for each token, offsets)"""
    if only_training:
        batch = batch.filter(pc.and_(pc.invert(batch.column("held_out")), pc.is_valid(batch.column("doc_id"))))
    classes = np.frombuffer(b"".join(x.as_py() for x in batch.column("classes")), np.int32).astype(np.int64)
    n = batch.column("n_tokens").to_numpy()
    off = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    return classes, np.repeat(off[:-1], n), off


def _train_part(model, turn: int, piece: int):
    def run(batches):
        from pyspark import TaskContext

        own = LogBilinear(model.value["prior"]).load(model.value["flat"])
        state = {k: np.full_like(v, 1e-4) for k, v in own.p.items()}
        rng, seen = np.random.default_rng(turn), 0
        for batch in batches:
            classes, starts, _ = _tokens(batch, True)
            if not len(classes):
                continue
            for words, place in minibatches(classes, starts, turn, rng):
                own.train(words, place, state, rng)
                seen += place.size
        if seen:
            flat = (own.flat() - model.value["flat"]).astype(np.float16)  # half the bytes; a mean of many doesn't need more
            k = -(-len(flat) // piece)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), pa.array(np.full(k, part & 3, np.int32)), pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, float(seen))), pa.array([flat[i * piece : (i + 1) * piece].tobytes() for i in range(k)], pa.binary())],
                ["piece", "salt", "part", "weight", "values"],
            )

    return run


_PIECES = "piece int, salt int, part int, weight double, values binary"


def _mean(table):
    table = table.sort_by("part")  # sums of floats depend on their order
    weight = table.column("weight").to_numpy()
    total = sum(w * np.frombuffer(v.as_py(), np.float16).astype(np.float64) for w, v in zip(weight, table.column("values")))
    one = table.slice(0, 1)
    return pa.table({"piece": one.column("piece"), "salt": one.column("salt"), "part": one.column("salt"), "weight": pa.array([float(weight.sum())]), "values": pa.array([(total / weight.sum()).astype(np.float16).tobytes()], pa.binary())})


def _scored(model, key: str):
    def run(batches):
        lb = resident(("lm", key), lambda: LogBilinear(model.value["prior"]).load(model.value["flat"]).ready())
        for batch in batches:
            if not batch.num_rows:
                continue
            classes, starts, off = _tokens(batch, False)
            ctx = contexts(classes, starts)
            s = np.zeros(len(classes))
            for k in range(0, len(s), 1 << 17):
                part = slice(k, k + (1 << 17))
                s[part] = lb.log_probabilities(ctx[part], classes[part])
            score = np.add.reduceat(s, off[:-1]) / np.log(10) + batch.column("inner").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, classes: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    classes: so many classes at most, instead of all words from least_count on.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n_parts = min(max(size // PART_BYTES, PARTS[0]), PARTS[1])
    blocks = written(rows.mapInArrow(_blocks(n_parts), _BLOCKS), "lm-blocks", compression="zstd")
    texts_of = blocks.where("part is null").select("block", "doc_ids", "held_out", "n_tokens", "codes")
    words = blocks.where("part is not null").select("block", "part", "codes", "lengths", "words", "counts")
    counts = written(words.groupBy("part").applyInArrow(_counted(LEAST if classes is None else 1), _COUNTED), "lm-counts", compression="zstd")
    total, distinct = counts.where("distinct is not null").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    if not total:
        discard(counts)
        each = texts_of.select(F.explode(F.arrays_zip("doc_ids", "held_out", "n_tokens")).alias("x")).select("x.*").withColumnRenamed("doc_ids", "doc_id")
        return each.select("doc_id", "held_out", "n_tokens", F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    own = counts.where("rank > 0")
    own = own.where(F.col("c") >= least_count(total)).orderBy(F.desc("c"), "word") if classes is None else own.orderBy(F.desc("c"), "word").limit(classes - 2)
    top = own.select("part", "rank", "c").toArrow()  # 64 times the root of the training tokens at most
    c = top.column("c").to_numpy()
    end = counts.where(F.col("word") == _END_WORD).first()
    rest, rest_distinct = total - int(c.sum()) - (end.c if end else 0), distinct - len(c) - (end is not None)
    prior = np.concatenate([[end.c if end else 0, rest], c]).astype(np.float64) + 0.5
    prior /= prior.sum()
    part, rank = (top.column(x).to_numpy() for x in ("part", "rank"))
    order = np.lexsort((rank, part))  # a part's words of the vocabulary are the first ones of its order
    vocabulary = sc.broadcast({"cls": (order + 2).astype(np.int32), "starts": np.searchsorted(part[order], np.arange(n_parts + 1))})
    found = counts.where("block is not null").select(F.col("block").alias("of"), "part", "codes", "counts", "ranks")
    looked = texts_of.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        _looked_up(total, distinct, rest, rest_distinct, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"
    )
    looked = written(looked, "lm-classes", compression="zstd")
    vocabulary.destroy()
    discard(blocks, counts)
    model = LogBilinear(prior)
    flat = model.flat()
    train = looked.select("doc_id", "held_out", "n_tokens", "classes")
    copies = max(2 * sc.defaultParallelism, total // len(flat))  # a copy sees as many tokens as it sends parameters, or more
    train = train.coalesce(copies)
    for turn in range(rounds):
        given = sc.broadcast({"prior": prior, "flat": flat})
        parts = train.mapInArrow(_train_part(given, turn, 1 << 14), _PIECES)
        mean = parts.groupBy("piece", "salt").applyInArrow(_mean, _PIECES).groupBy("piece").applyInArrow(_mean, _PIECES)
        got = {r["piece"]: np.frombuffer(bytes(r["values"]), np.float16) for r in mean.collect()}  # the model's parameters
        given.destroy()
        flat = flat + np.concatenate([got[k] for k in sorted(got)]).astype(np.float32)
    final = sc.broadcast({"prior": prior, "flat": flat})
    out = looked.mapInArrow(_scored(final, uuid.uuid4().hex), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
