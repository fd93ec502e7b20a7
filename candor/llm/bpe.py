"""BPE encoding by tree concatenation, and decoding.

A text is halved until its leaves are short; leaves are encoded independently (in one batch call, in the
library's threads for very long texts). Going up the tree, each join is repaired: a window around it is encoded
again and grows until it starts and ends with a unit whose ids both agree exactly with those of the side it
belongs to; what lies further out can't change, since the tokenizer never joins units across white space.

Text that the tokenizer can't split (one pre-token of thousands of characters) is halved too, and all its leaves
are encoded by one batch call, in parallel in the library's threads. But for the last they lack the end-of-word
suffix. Going up the tree, the joins of a level are repaired together: windows of growing numbers of tokens around
them are encoded again, a batch call for each growth, until their first and last token agree with both sides. A BPE
sequence is the encoding of its text if and only if each two neighbours are, so agreement at both ends makes the
whole exact.

Nulls are empty texts, which have no ids; repeated rows and ties need no rule; very long texts stay in one
task (a row is one value) with bounded windows; extra columns are left alone by `encode_column`.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .units import UnitEncoder, resident, slices, split_words, texts, tokenizer_variant

LEAF_CHARS = 4096
WINDOW_CHARS = 64
UNSPLIT_CHARS = 1024
PARALLEL_CHARS = 1 << 20
JOIN_IDS = 1 << 24
_BLANK = re.compile("[\x20\x09-\x0d]")



class TreeBpe:
    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS, unsplit: int = UNSPLIT_CHARS):
        from tokenizers import Tokenizer

        if leaf < 4 * unsplit:
            raise ValueError("a leaf must hold four unsplit stretches, so that windows stay inside of two leaves")
        self.leaf, self.window, self.unsplit = leaf, window, unsplit
        self.stretch = re.compile("[^\x20\x09-\x0d]{%d,}" % unsplit)
        self.units = UnitEncoder(path, words=True, long_unit=self._stretch_ids, longest=unsplit - 1)
        self.tok = self.units.tok
        plain = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}, "added_tokens": []}
        self.closed = Tokenizer.from_str(tokenizer_variant(path, **plain))
        self.open = Tokenizer.from_str(tokenizer_variant(path, **plain, model__end_of_word_suffix=None))
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()) + ")")
        vocab = self.tok.get_vocab(with_added_tokens=True)
        names = [""] * (max(vocab.values()) + 1)
        for name, i in vocab.items():
            names[i] = name
        self.names = pa.array(names, pa.string())
        self.n_bytes = [len(n.removesuffix("</w>")) for n in names]  # byte-level: a character is a byte

    def _leaves(self, text: str, at: int, end: int) -> list[tuple[int, int]]:
        if end - at <= self.leaf:
            return [(at, end)]
        middle = (at + end) // 2
        return self._leaves(text, at, middle) + self._leaves(text, middle, end)

    def _runs(self, text: str) -> list[tuple[int, int]]:
        """The text without its long unsplit stretches, and these, in order; all cuts are at white space."""
        out, at = [], 0
        if len(text) > self.unsplit:
            for m in self.stretch.finditer(text):
                out += [(at, m.start())] * (m.start() > at) + [m.span()]
                at = m.end()
        return out + [(at, len(text))] * (at < len(text))

    def _pieces(self, values: list[str]):
        """(offsets into the units, offsets of units into ids, ids)"""
        off, flat = split_words(pa.array(values, pa.string()))
        each, ids = self.units._gather(np.arange(len(flat) + 1), flat)
        return off, each, ids

    def _window(self, text: str, a: int, m: int, b: int, size: int) -> tuple[int, int]:
        """From the first blank at most `size` before m to the last one at most `size` after it."""
        lo, hi = max(a, m - size), min(b, m + size)
        if lo > a or a > 0 and not _BLANK.match(text[a]):
            lo = next((x.start() for x in _BLANK.finditer(text, lo, m)), -1)
        if hi < b or b < len(text):
            hi = max((x.end() for x in _BLANK.finditer(text, m, hi)), default=-1)
        return lo, hi

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of strings without nulls, equal to the library's own for each whole text."""
        rows = values.to_pylist()
        leaves, joins, tree = [], [], []  # tree: per text its leaves' numbers; a join is (text, left leaf, its size)
        for r, text in enumerate(rows):
            own = []
            for at, end in self._runs(text):
                for k, (a, b) in enumerate(self._leaves(text, at, end)):
                    if k:
                        joins.append((r, len(leaves) - 1, self.window))
                    own.append(len(leaves))
                    leaves.append((r, a, b))
            tree.append(own)
        off, each, ids = self._pieces([rows[r][a:b] for r, a, b in leaves])
        first, last = off[:-1].copy(), off[1:].copy()  # the units of each leaf that stand
        repaired: dict[int, np.ndarray] = {}
        entire: dict[int, np.ndarray] = {}
        spans: dict[int, tuple[int, int]] = {}
        while joins:
            windows = []
            for r, left, size in joins:
                (_, a, m), (_, _, b) = leaves[left], leaves[left + 1]
                lo, hi = self._window(rows[r], a, m, b, size)
                windows.append(rows[r][lo:hi] if lo >= 0 and hi >= 0 else None)
                joins[len(windows) - 1] = (r, left, size, lo, hi)
            woff, weach, wids = self._pieces([w or "" for w in windows])
            again = []
            for k, (r, left, size, lo, hi) in enumerate(joins):
                m = leaves[left][2]
                done = windows[k] is not None
                if done:
                    text = rows[r]
                    n_left, n_right = len(_words(text[lo:m])), len(_words(text[m:hi]))
                    x, y = off[left + 1] - n_left, off[left + 1] + n_right
                    w0, w1 = woff[k], woff[k + 1]
                    whole = lo <= leaves[left][1], hi >= leaves[left + 1][2]
                    agree = lambda u, w: np.array_equal(ids[each[u] : each[u + 1]], wids[weach[w] : weach[w + 1]])
                    done = (whole[0] or n_left > 1 and agree(x, w0)) and (whole[1] or n_right > 1 and agree(y - 1, w1 - 1))
                if done:
                    last[left], first[left + 1] = x, y
                    repaired[left], spans[left] = wids[weach[w0] : weach[w1]], (lo, hi)
                elif size > 2 * self.leaf:
                    entire[r] = np.zeros(0, np.uint32)  # hardly any words: the window is the whole text
                else:
                    again.append((r, left, 2 * size))
            joins = again
        for left, (lo, _) in spans.items():
            if left - 1 in spans and leaves[left - 1][0] == leaves[left][0] and spans[left - 1][1] > lo:
                entire[leaves[left][0]] = np.zeros(0, np.uint32)  # windows met
        for r in entire:
            entire[r] = self.units.encode(pa.array([rows[r]], pa.string()))[1]
        parts, lens = [], np.zeros(len(rows), np.int64)
        for r, own in enumerate(tree):
            if r in entire:
                parts.append(entire[r])
                lens[r] = len(entire[r])
                continue
            for k in own:
                stand = ids[each[first[k]] : each[max(first[k], last[k])]]
                parts += [stand, repaired[k]] if k in repaired else [stand]
                lens[r] += sum(map(len, parts[-2:] if k in repaired else parts[-1:]))
        return np.concatenate([[0], np.cumsum(lens)]), np.concatenate(parts or [np.zeros(0, np.uint32)]).astype(np.uint32)

    def _stretch_ids(self, text: str) -> list[int]:
        """Ids of a text without ASCII white space: by special tokens, pre-tokens, and trees over long ones."""
        out: list[int] = []
        for part in self.special.split(text):
            if (i := self.tok.token_to_id(part)) is not None and self.special.fullmatch(part):
                out.append(i)
                continue
            normal = self.tok.normalizer.normalize_str(part)
            words = [normal[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(normal)]
            short = iter(self.closed.encode_batch_fast([w for w in words if len(w) <= self.unsplit], add_special_tokens=False))
            for w in words:
                out += next(short).ids if len(w) <= self.unsplit else self._word(w, True)
        return out

    def _word(self, word: str, closed: bool) -> list[int]:
        """Ids of one long pre-token; `closed`: its last character ends the word."""
        n = 1
        while len(word) > n * self.unsplit:
            n *= 2
        cuts = [len(word) * k // n for k in range(n + 1)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        level = [e.ids for e in self.open.encode_batch_fast(parts[:-1], add_special_tokens=False)]
        level.append((self.closed if closed else self.open).encode(parts[-1], add_special_tokens=False).ids)
        while len(level) > 1:  # neighbours of this level become one
            level = self._merged(parts, level, closed)
            parts = [parts[k] + parts[k + 1] for k in range(0, len(parts), 2)]
        return level[0]

    def _merged(self, parts: list[str], ids: list[list[int]], closed: bool) -> list[list[int]]:
        """Ids of each two neighbours put together; windows around all joins are encoded at once, and again where they must grow."""
        out: list[list[int]] = [[] for _ in range(0, len(parts), 2)]
        open_joins, k = list(range(len(out))), 4
        while open_joins:
            windows = []
            for j in open_joins:
                left, right = ids[2 * j], ids[2 * j + 1]
                x, y = left[-k:], right[:k]
                head, tail = parts[2 * j].encode(), parts[2 * j + 1].encode()
                nx, ny = sum(self.n_bytes[i] for i in x), sum(self.n_bytes[i] for i in y)
                at_end = ny == len(tail)
                try:
                    text = (head[len(head) - nx :] + tail[:ny]).decode()
                except UnicodeDecodeError:  # a token may hold part of a character
                    continue
                windows.append((j, x, y, nx == len(head), at_end, closed and at_end and j == len(out) - 1, text))
            got: dict[int, list[int]] = {}
            for ends, tok in ((False, self.open), (True, self.closed)):
                own = [w for w in windows if w[5] == ends]
                got |= {w[0]: e.ids for w, e in zip(own, tok.encode_batch_fast([w[6] for w in own], add_special_tokens=False))}
            done = set()
            for j, x, y, at_start, at_end, _, _ in windows:
                new = got[j]
                if (at_start or new[0] == x[0]) and (at_end or new[-1] == y[-1]):
                    out[j] = ids[2 * j][: len(ids[2 * j]) - len(x)] + new + ids[2 * j + 1][len(y) :]
                    done.add(j)
            open_joins, k = [j for j in open_joins if j not in done], 2 * k
        return out

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The texts of runs of ids, as decode(ids, skip_special_tokens=False) without a decoder: joined by a space."""
        if self.tok.decoder is not None:
            return pa.array(self.tok.decode_batch([ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])], skip_special_tokens=False), pa.large_string())
        if len(ids) > JOIN_IDS and len(offsets) > 2:  # Arrow's join has 32-bit offsets
            m = len(offsets) // 2
            return pa.concat_arrays([self.decode(offsets[: m + 1], ids[: offsets[m]]), self.decode(offsets[m:] - offsets[m], ids[offsets[m] :])])
        step = [np.array([a, b]) for a, b in zip(range(0, len(ids), JOIN_IDS), [*range(JOIN_IDS, len(ids), JOIN_IDS), len(ids)])] if len(ids) > JOIN_IDS else [offsets]
        got = [pc.binary_join(pa.ListArray.from_arrays(pa.array(o - o[0], pa.int32()), self.names.take(pa.array(ids[o[0] : o[-1]]))), " ").cast(pa.large_string()) for o in step]
        return got[0] if len(got) == 1 else pa.array([" ".join(g[0].as_py() for g in got)], pa.large_string())


def _words(text: str) -> list[str]:
    return [w for w in _BLANK.split(text) if w]


def tree(path: str) -> TreeBpe:
    return resident(("tree", path), lambda: TreeBpe(path))


def _digests(path: str, limit: int):
    def run(batches):
        for batch in slices(batches, limit=limit):
            values = texts(batch)
            long = pc.max(pc.binary_length(values)).as_py() > PARALLEL_CHARS
            os.environ["TOKENIZERS_PARALLELISM"] = "true" if long else "false"  # tasks are parallel already; one long text isn't
            t = tree(path)
            off, ids = t.encode(values)
            decoded = t.decode(off, ids)
            raw = np.ascontiguousarray(ids, "<u4")
            sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(off, off[1:])]
            text_sha = [hashlib.sha256(d.as_buffer()).hexdigest() for d in decoded]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(off)), pa.array(sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def digests(docs: DataFrame, path: str, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text; reads doc_id and text only, shuffles nothing."""
    return docs.select("doc_id", "text").mapInArrow(_digests(path, slice_bytes), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _ids(path: str, text: str, out: str, schema_names: list[str]):
    def run(batches):
        for batch in slices(batches, text):
            off, ids = tree(path).encode(texts(batch, text))
            got = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema_names), got], [*schema_names, out])

    return run


def encode_column(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the ids of `text` in the array column `out`; all other columns stay."""
    from pyspark.sql import types as T

    if out in df.columns:
        raise ValueError(f"the column {out} exists")
    return df.mapInArrow(_ids(path, text, out, df.columns), T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _texts(path: str, ids: str, out: str, names: list[str]):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(ids).cast(pa.large_list(pa.int32()))
                lens = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
                got = tree(path).decode(np.concatenate([[0], np.cumsum(lens)]), flat).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), got], [*names, out])

    return run


def decode_column(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the decoded text of the id lists in `ids`; null lists decode to the empty text."""
    from pyspark.sql import types as T

    if out in df.columns:
        raise ValueError(f"the column {out} exists")
    return df.mapInArrow(_texts(path, ids, out, df.columns), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
