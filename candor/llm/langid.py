"""Language identification by a linear-chain conditional random field over words.

Each word is a position; its label is the language it is written in. A word's score for a label sums learned
weights of its features: byte n-grams of two and three with word ends, affixes of three and four bytes, and the
word itself if it is in the lexicon (words met often in training). Transitions between neighbours are learned as
well, from chains that join stretches of different documents, so that text which switches language is labelled
word by word. Posteriors come from forward-backward over the whole text, however long: the chain is cut into
segments whose transfer matrices are multiplied first, which is exact and needs segments' length in steps, not
the text's. A document's language has the largest mean posterior over its letters, and that mean is the score.

Training reads a bounded sample of labelled rows, chosen by hash of doc_id: TRAIN_DOCS in equal parts for each label
(LEAST_DOCS to MOST_DOCS), so that rare labels are learned too. Of a text longer than TRAIN_CHARS, PARTS stretches spread
evenly over all of it are read, as long together. Prediction reads whole texts and nothing else. Null texts and texts without a letter are `und` with score 0, and so is all
text if nothing is labelled. Repeated rows repeat their result; ties go to the first label in sorted order.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .units import as_utf8, coded, resident, slices, split_words, texts

TRAIN_DOCS, TRAIN_CHARS, LEAST_DOCS, MOST_DOCS, PARTS = 2000, 2000, 50, 1000, 4
FEATURES = 1 << 15
LEXICON = 20_000
SEGMENT = 128
KEPT_WORDS = 100_000
#: Text that is tagged at once; its words' scores and posteriors take some fifty times as much memory.
SLICE_BYTES = 2 << 20


def features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature number) of n-grams and affixes of distinct lower-case words."""
    marked = pc.binary_join_element_wise("\x02", words, "\x03", "").cast(pa.large_string())
    off, raw = as_utf8(marked)
    raw = raw.astype(np.uint32)
    word = np.repeat(np.arange(len(words)), np.diff(off))
    at, out = [], []

    def add(where: np.ndarray, length: int, salt: int) -> None:
        h = np.full(len(where), salt, np.uint32)
        for k in range(length):
            h = (h ^ raw[where + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        at.append(word[where])
        out.append(h & np.uint32(FEATURES - 1))

    n = len(raw)
    for k in (2, 3):
        if n >= k:
            add(np.flatnonzero(word[: n - k + 1] == word[k - 1 :]), k, 0x811C9DC5 + k)
    size = np.diff(off)
    for k in (4, 5):  # a mark and three or four bytes
        enough = np.flatnonzero(size >= k)
        add(off[enough], k, 7 + k)
        add(off[enough + 1] - k, k, 77 + k)
    return np.concatenate(at), np.concatenate(out).astype(np.int64)


class Crf:
    """Weights: features x labels, lexicon x labels, transitions, start."""

    def __init__(self, labels: list[str], lexicon: list[str]):
        n = len(labels)
        self.labels, self.lexicon = labels, pa.array(lexicon, pa.string())
        self.theta, self.lex = np.zeros((FEATURES, n)), np.zeros((len(lexicon) + 1, n))
        self.trans, self.start = np.zeros((n, n)), np.zeros(n)

    def emissions(self, words: pa.Array) -> np.ndarray:
        """Scores of distinct lower-case words, words x labels."""
        word, feature = features(words)
        out = self.lex[pc.index_in(words, self.lexicon).fill_null(len(self.lexicon)).to_numpy(zero_copy_only=False)]
        sums = [np.bincount(word, self.theta[feature, k], len(words)) for k in range(len(self.labels))]
        return np.clip(out + np.stack(sums, 1), -30, 30)

    def train(self, docs: list[tuple[str, str]], epochs: int = 4, length: int = 32, batch: int = 256, rate: float = 0.2, seed: int = 7) -> Crf:
        """docs: (text, label). Chains of `length` words; a third join two stretches of different documents."""
        rng = np.random.default_rng(seed)
        off, words = split_words(pc.utf8_lower(pa.array([t for t, _ in docs], pa.string())))
        codes, distinct = coded(words)
        gold = np.repeat([self.labels.index(y) for _, y in docs], np.diff(off))
        half = length // 2
        starts = np.concatenate([np.arange(a, b - half + 1, half) for a, b in zip(off, off[1:])] or [np.zeros(0, np.int64)]).astype(np.int64)
        if not len(starts):
            return self
        word, feature = features(distinct)
        order = np.argsort(word, kind="stable")
        word, feature = word[order], feature[order]
        first = np.searchsorted(word, np.arange(len(distinct) + 1))
        in_lexicon = pc.index_in(distinct, self.lexicon).fill_null(len(self.lexicon)).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(self.labels)
        squares = [np.full_like(p, 1e-8) for p in (self.theta, self.lex, self.trans, self.start)]
        for _ in range(epochs):
            pair = np.stack([starts, np.where(rng.random(len(starts)) < 1 / 3, rng.permutation(starts), starts)], 1)
            for part in np.array_split(rng.permutation(pair), max(1, len(pair) // batch)):
                at = (part[:, :, None] + np.arange(half)).reshape(len(part), -1)
                y, own, inverse = gold[at], *np.unique(codes[at], return_inverse=True)
                inverse = inverse.reshape(at.shape)
                size = first[own + 1] - first[own]
                ends = np.cumsum(size)
                run = np.repeat(first[own] - (ends - size), size) + np.arange(ends[-1])
                f, who = feature[run], np.repeat(np.arange(len(own)), size)
                e = self.lex[in_lexicon[own]] + np.stack([np.bincount(who, self.theta[f, k], len(own)) for k in range(n)], 1)
                gamma, edge, s = self._expected(np.clip(e, -30, 30)[inverse])
                g = -gamma
                np.put_along_axis(g, y[:, :, None], np.take_along_axis(g, y[:, :, None], 2) + 1, 2)
                g_word = np.stack([np.bincount(inverse.ravel(), g[:, :, k].ravel(), len(own)) for k in range(n)], 1)
                g_theta = np.stack([np.bincount(f, g_word[who, k], FEATURES) for k in range(n)], 1)
                g_lex = np.stack([np.bincount(in_lexicon[own], g_word[:, k], len(self.lexicon) + 1) for k in range(n)], 1)
                g_lex[-1] = 0
                g_trans = np.bincount((y[:, :-1] * n + y[:, 1:]).ravel(), minlength=n * n).reshape(n, n) - edge
                g_start = np.bincount(y[:, 0], minlength=n) - s
                for p, grad, sq in zip((self.theta, self.lex, self.trans, self.start), (g_theta, g_lex, g_trans, g_start), squares):
                    grad = grad / len(part) - 1e-5 * p
                    sq += grad**2
                    p += rate * grad / np.sqrt(sq)
        return self

    def _expected(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors, expected transitions, expected starts) of chains of equal length."""
        b = np.exp(e - e.max(2, keepdims=True))
        a, t = np.exp(self.trans), e.shape[1]
        alpha, beta = np.zeros_like(b), np.ones_like(b)
        alpha[:, 0] = np.exp(self.start) * b[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for k in range(1, t):
            alpha[:, k] = (alpha[:, k - 1] @ a) * b[:, k]
            alpha[:, k] /= alpha[:, k].sum(1, keepdims=True)
        for k in range(t - 2, -1, -1):
            beta[:, k] = (b[:, k + 1] * beta[:, k + 1]) @ a.T
            beta[:, k] /= beta[:, k].sum(1, keepdims=True)
        gamma = alpha * beta
        gamma /= gamma.sum(2, keepdims=True)
        edge = alpha[:, :-1, :, None] * a * (b * beta)[:, 1:, None, :]
        return gamma, (edge / edge.sum((2, 3), keepdims=True)).sum((0, 1)), gamma[:, 0].sum(0)

    def posteriors(self, e: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Posteriors of the words of texts with scores e, exact for each whole text."""
        n, words = len(self.labels), np.diff(offsets)
        out = np.zeros((len(e), n))
        parts = -(-words // segment)
        seg_off = np.concatenate([[0], np.cumsum(parts)])
        if not seg_off[-1]:
            return out
        begin = np.concatenate([np.arange(a, b, segment) for a, b in zip(offsets, offsets[1:])]).astype(np.int64)
        doc = np.repeat(np.arange(len(words)), parts)
        size = np.minimum(segment, offsets[doc + 1] - begin)
        order = np.argsort(-size, kind="stable")  # full segments first: those that end drop out of the steps
        b = np.exp(e - e.max(1, keepdims=True))
        a = np.exp(self.trans - self.trans.max())
        first = seg_off[:-1][parts > 0]
        # transfer matrices: rows are the label before the segment; a text's first word has no transition before it
        x = np.broadcast_to(np.eye(n), (len(begin), n, n)).copy()
        is_first = np.zeros(len(begin), bool)
        is_first[first] = True
        for k in range(segment):
            on = order[: np.searchsorted(-size[order], -k, side="left")] if k else order
            if not len(on):
                break
            step = x[on] @ a
            if k == 0:
                step[is_first[on]] = np.diag(np.exp(self.start - self.start.max()))
            step *= b[begin[on] + k][:, None, :]
            x[on] = step / step.sum((1, 2), keepdims=True)
        enter, leave = np.zeros((len(begin), n)), np.ones((len(begin), n))
        enter[first] = 1.0
        for k in range(1, int(parts.max())):
            now = seg_off[:-1][parts > k] + k
            v = np.einsum("si,sij->sj", enter[now - 1], x[now - 1])
            enter[now] = v / v.sum(1, keepdims=True)
        for k in range(2, int(parts.max()) + 1):
            now = seg_off[1:][parts >= k] - k
            v = np.einsum("sij,sj->si", x[now + 1], leave[now + 1])
            leave[now] = v / v.sum(1, keepdims=True)
        alpha = enter
        for k in range(segment):
            on = order[: np.searchsorted(-size[order], -k, side="left")] if k else order
            if not len(on):
                break
            step = alpha[on] @ a
            if k == 0:
                step[is_first[on]] = np.exp(self.start - self.start.max())
            step *= b[begin[on] + k]
            alpha[on] = step / step.sum(1, keepdims=True)
            out[begin[on] + k] = alpha[on]
        beta = leave
        for k in range(segment - 1, -1, -1):
            on = order[: np.searchsorted(-size[order], -k, side="left")] if k else order
            if not len(on):
                continue
            out[begin[on] + k] *= beta[on]
            step = (b[begin[on] + k] * beta[on]) @ a.T
            beta[on] = step / step.sum(1, keepdims=True)
        return out / out.sum(1, keepdims=True)


def stretches(text: Column, most: int, parts: int = PARTS) -> Column:
    """Whole texts up to `most` characters; of longer ones, so many stretches from start to end, without the words they cut."""
    size, room = most // parts, F.length(text) - most // parts
    cut = lambda k: "|".join([r"^\S{1,40}(?=\s)"] * (k > 0) + [r"(?<=\s)\S{1,40}$"] * (k < parts - 1))
    each = [F.regexp_replace(F.substr(text, (room * k / (parts - 1)).cast("int") + 1, F.lit(size)), cut(k), "") for k in range(parts)]
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws(" ", *each))


def train(docs: DataFrame, most_docs: int = TRAIN_DOCS, most_chars: int = TRAIN_CHARS) -> Crf | None:
    """A model of docs (doc_id, text, lang) whose crc32(doc_id) mod 3 isn't 1, or None if none is labelled."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    known = known.select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.shiftrightunsigned(F.xxhash64("doc_id"), 12).alias("h"))
    count = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one for each label
    each = min(MOST_DOCS, max(LEAST_DOCS, -(-most_docs // max(1, len(count)))))  # of a label; each task sends so many at most
    # the smallest hashes of a label lie below its bound, so tasks send few rows beside those that are taken
    bound = F.create_map(*(F.lit(x) for lang, n in count.items() for x in (lang, int(min(1.0, 2 * each / n) * (1 << 52))))) if count else F.create_map(F.lit(""), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))
    rows = known.where(F.col("h") < bound[F.col("lang")]).select("doc_id", stretches(F.col("text"), most_chars).alias("text"), "lang", "h").withColumn("rank", rank).where(F.col("rank") <= each).orderBy("h", "doc_id", "text", "lang").collect()
    if not rows:
        return None
    labels = sorted({r.lang for r in rows})
    met: dict[str, int] = {}
    for r in rows:
        for w in (r.text or "").lower().split():
            met[w] = met.get(w, 0) + 1
    lexicon = [w for w, c in sorted(met.items(), key=lambda x: (-x[1], x[0])) if c >= 5][:LEXICON]
    return Crf(labels, lexicon).train([(r.text, r.lang) for r in rows])


class _Tagger:
    """A model with the scores of words met before in this worker."""

    def __init__(self, crf: Crf):
        self.crf, self.known, self.scores, self.letters = crf, pa.array([], pa.string()), np.zeros((0, len(crf.labels))), np.zeros(0, np.int64)

    def words(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, scores of each word, its letters)."""
        off, words = split_words(pc.utf8_lower(values))
        if not len(words):
            return off, np.zeros((0, len(self.crf.labels))), np.zeros(0, np.int64)
        codes, distinct = coded(words)
        at = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        scores, letters = self.scores, self.letters
        if len(new):
            fresh = distinct.take(pa.array(new))
            count = pc.count_substring_regex(fresh, r"\p{L}").to_numpy(zero_copy_only=False).astype(np.int64)
            e = self.crf.emissions(fresh)
            e[count == 0] = 0
            at[new] = len(letters) + np.arange(len(new))
            scores, letters = np.concatenate([scores, e]), np.concatenate([letters, count])
            room = KEPT_WORDS - len(self.known)
            if room > 0:
                self.known = pa.concat_arrays([self.known, fresh.slice(0, room)])
                self.scores, self.letters = scores[: len(self.known)], letters[: len(self.known)]
        return off, scores[at[codes]], letters[at[codes]]


def _predict(model, key: str):
    def run(batches):
        tagger = resident(("tagger", key), lambda: _Tagger(model.value))
        labels = np.array([*tagger.crf.labels, "und"], object)
        for batch in slices(batches, limit=SLICE_BYTES):
            off, e, letters = tagger.words(texts(batch))
            post = tagger.crf.posteriors(e, off) * letters[:, None]
            total = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, 0)])
            sums = total[off[1:]] - total[off[:-1]]
            n = np.diff(np.concatenate([[0], np.cumsum(letters)])[off])
            share = sums / np.maximum(n, 1)[:, None]
            best = np.where(n > 0, share.argmax(1), len(labels) - 1)
            score = np.where(n > 0, np.clip(share.max(1), 0, 1), 0.0)
            ids = batch.column("doc_id").to_pylist()
            held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(labels[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; nothing is shuffled."""
    if model is None:
        held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.select("doc_id", "text").mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex), SCHEMA)


def _kept(model, least: float, names: list[str]):
    judge = _predict(model, uuid.uuid4().hex)  # a key of its own: workers outlive models

    def run(batches):
        for batch in slices(batches, limit=SLICE_BYTES):
            got = next(judge(iter([batch.select(["doc_id", "text"])])))
            keep = pc.and_(pc.not_equal(got.column("lang_pred"), "und"), pc.greater_equal(got.column("score"), least))
            yield batch.select(names).filter(keep)

    return run


def keep_known(docs: DataFrame, model: Crf | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, whose language is known with a score of `least` or more."""
    if model is None:
        return docs.where("false")
    return docs.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(model), least, docs.columns), docs.schema)
