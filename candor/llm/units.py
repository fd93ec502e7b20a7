"""Columnar helpers shared by the text operators: Arrow slices of bounded size,
word splitting at ASCII white space and dictionary-based tokenisation."""

from __future__ import annotations

import ctypes
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: A cache of so many units stays in each Python worker.
KEPT_UNITS = 600_000
_SEPARATORS = "\x01\x02\x03\x04\x05\x06\x0e\x0f\x10|§¶†‡•■►◆★"


def tune(spark, batch: str = "16m") -> None:
    """Arrow batches of a bounded number of rows and bytes; joins by hash where measured sizes allow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")  # hash joins where every measured partition fits


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows whose `column` holds about `limit` bytes; one longer row stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.binary_length(batch.column(column).cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    tidy()


def merged(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 10 << 20) -> Iterator[pa.RecordBatch]:
    """Like slices, with short batches put together first: fewer, larger dictionaries."""
    held, size = [], 0

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        return slices(iter(table.to_batches()), column, limit)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(column).nbytes
        if size >= limit:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as strings; null becomes the empty text."""
    return batch.column(column).cast(pa.string()).fill_null("")


def as_utf8(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls."""
    values = values.cast(pa.large_string())
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def split_words(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each value: (offsets into the words, words)."""
    parts = pc.ascii_split_whitespace(values)
    off = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        keep = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        return keep[off - off[0]], flat.filter(full)
    return off - off[0], flat


def lower_ascii(values: pa.Array) -> pa.Array:
    """A-Z in lower case, all other characters as they are."""
    return pc.ascii_lower(values)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, distinct words); codes start at 0 in order of first occurrence."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... start+length-1 of each run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class UnitEncoder:
    """Tokenises columns of text through the distinct units of a batch.

    A unit is a stretch of text that the tokenizer never joins with what stands beside it, so each distinct
    unit is encoded once and its ids are gathered for every place. `words`: units end at ASCII white space,
    which must be dropped by the tokenizer. Otherwise a unit starts at a single space between two characters
    that aren't white space, the rule of byte-level vocabularies; texts with other spacing are encoded whole.
    """

    def __init__(self, path: str, words: bool, long_unit=None, longest: int = 4096, most_kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.words, self.long_unit, self.longest, self.most_kept = words, long_unit, longest, most_kept
        self.known, self.lens, self.kept = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def ids(self, parts: list[str], at_once: int = 200) -> list[np.ndarray]:
        """Ids of each text; the library's bulky results are dropped after every few texts."""
        out = []
        for k in range(0, len(parts), at_once):
            out += [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(parts[k : k + at_once], add_special_tokens=False)]
        return out

    def _mark(self, distinct: pa.Array) -> tuple[str, int] | None:
        """A separator of one id that no unit contains, so that its id tells where units end."""
        for c in _SEPARATORS:
            mark = self.ids([f" {c}"])[0]
            if len(mark) == 1 and not pc.any(pc.match_substring(distinct, c)).as_py():
                return c, int(mark[0])
        return None

    def _units(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of distinct units, many of them in one call around a separator."""
        parts, sep = distinct.to_pylist(), self._mark(distinct)
        single = pa.array(np.full(len(parts), sep is None))
        if self.long_unit:
            single = pc.or_(single, pc.greater(pc.binary_length(distinct), self.longest))
        if not self.words:
            single = pc.or_(single, pc.invert(pc.starts_with(distinct, " ")))
        alone = np.flatnonzero(single.to_numpy(zero_copy_only=False)).tolist()
        apart = dict(zip(alone, (np.asarray(g, np.uint32) for g in self._alone([parts[k] for k in alone]))))
        if len(apart) == len(parts):
            return np.array([len(g) for g in apart.values()], np.int64), np.concatenate(list(apart.values()))
        for k in apart:
            parts[k] = ""
        glue = f" {sep[0]} " if self.words else f" {sep[0]}"
        flat = self.ids([glue.join(parts[k : k + 64]) + glue for k in range(0, len(parts), 64)])
        values = np.concatenate(flat)
        is_mark = values == sep[1]
        lens = np.diff(np.concatenate([[-1], np.flatnonzero(is_mark)])) - 1
        kept = values[~is_mark]
        if not apart:
            return lens, kept
        even, off = lens.copy(), np.concatenate([[0], np.cumsum(lens)[:-1]])
        for k, g in apart.items():
            lens[k] = len(g)
        out = np.zeros(int(lens.sum()), np.uint32)
        at = np.concatenate([[0], np.cumsum(lens)])
        rest = np.setdiff1d(np.arange(len(parts)), list(apart))
        out[spread(at[rest], lens[rest])] = kept[spread(off[rest], even[rest])]
        for k, g in apart.items():
            out[at[k] : at[k + 1]] = g
        return lens, out

    def _alone(self, parts: list[str]) -> list[list[int]]:
        long = [k for k, p in enumerate(parts) if self.long_unit and len(p) > self.longest]
        got = self.ids(["" if self.long_unit and len(p) > self.longest else p for p in parts])
        for k in long:
            got[k] = self.long_unit(parts[k])
        return got

    def _gather(self, offsets: np.ndarray, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(units):
            return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint32)
        codes, distinct = coded(units)
        known = pc.index_in(distinct, self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = known < 0
        lens, ids = (np.zeros(0, np.int64), np.zeros(0, np.uint32)) if not new.any() else self._units(distinct.filter(pa.array(new)))
        base = len(self.lens)
        known[new] = base + np.arange(len(lens))
        all_lens, all_ids = np.concatenate([self.lens, lens]), np.concatenate([self.kept, ids])
        starts = np.concatenate([[0], np.cumsum(all_lens)[:-1]])
        if base < self.most_kept and len(lens):  # units met early are the frequent ones
            short = pc.less(pc.binary_length(fresh := distinct.filter(pa.array(new))), 64).to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(short)[: self.most_kept - base]
            self.known = pa.concat_arrays([self.known, fresh.take(pa.array(pick))])
            self.kept = np.concatenate([self.kept, all_ids[spread(starts[base + pick], lens[pick])]])
            self.lens = np.concatenate([self.lens, lens[pick]])
        at_unit = known[codes]
        n = all_lens[at_unit]
        at = np.concatenate([[0], np.cumsum(n)])
        return at[offsets], all_ids[spread(starts[at_unit], n)]

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a string array without nulls."""
        if self.words:
            return self._gather(*split_words(values))
        odd = pc.match_substring_regex(values, r"[\s\x0b\x{85}\p{Z}] | [\s\x0b\x{85}\p{Z}]|^ | $").to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._spaced(values)
        off, ids = self._spaced(values.filter(pa.array(~odd)))
        parts = self.ids(values.filter(pa.array(odd)).to_pylist())
        lens = np.zeros(len(values), np.int64)
        lens[~odd], lens[odd] = np.diff(off), [len(p) for p in parts]
        out = np.zeros(int(lens.sum()), np.uint32)
        at = np.concatenate([[0], np.cumsum(lens)])
        even = np.flatnonzero(~odd)
        out[spread(at[even], lens[even])] = ids
        for k, p in zip(np.flatnonzero(odd), parts):
            out[at[k] : at[k + 1]] = p
        return at, out

    def _spaced(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(values):
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        parts = pc.split_pattern(values, " ")
        off = np.asarray(parts.offsets, dtype=np.int64)
        off = off - off[0]
        flat = parts.flatten()
        first = np.zeros(len(flat), bool)
        first[off[:-1]] = True
        lead = pc.if_else(pa.array(first), "", " ")
        return self._gather(off, pc.binary_join_element_wise(lead, flat, ""))


_resident: dict = {}


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def resident(key, make=None):
    """What the worker keeps from task to task: one thing at a time. Without `make` it keeps nothing."""
    if key not in _resident:
        _resident.clear()
        tidy()
        if make:
            _resident[key] = make()
    return _resident.get(key)


def encoder(path: str, words: bool, kept: int = KEPT_UNITS) -> UnitEncoder:
    """The worker's encoder of this file; tasks that follow find its cache filled."""
    return resident(("encoder", path, words, kept), lambda: UnitEncoder(path, words, most_kept=kept))


def u32_crc(ids: np.ndarray) -> int:
    import zlib

    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def tokenizer_variant(path: str, **changes) -> str:
    """The tokenizer's JSON with entries replaced ("model.end_of_word_suffix" and the like)."""
    spec = json.load(open(path, encoding="utf-8"))
    for key, value in changes.items():
        at, *names = spec, *key.split("__")
        for name in names[:-1]:
            at = at[name]
        at[names[-1]] = value
    return json.dumps(spec)
