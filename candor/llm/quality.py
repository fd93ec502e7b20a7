"""Line-first cleaning: rules per line, failing lines go, documents that lose too much text are rejected.

A line with a word fails if
 * markup: more than a tenth as many symbols `#*$%&|<>` as words,
 * navigation: separators (| / > » · •) stand alone for a tenth of its words, three words at least,
 * punctuation: ten words or more without any of . , ; : ! ? …, or "!!" on a tenth of its words,
 * shouting: three words or more, all in capital letters,
 * boilerplate: it holds one of the phrases in BOILERPLATE (English, French, Spanish, German) and at most thirty words,
 * repeats: it has three words or more and equals an earlier line of the text.
A document is rejected if its words' characters on failing lines exceed MOST_LOST of all, or by the base rules
(under ten words, or over a fifth of its words in 5-word windows that occur twice).

Null and empty texts have no words and are rejected. Ties and repeated rows are judged alike, each row by
itself; a text is never split over tasks or cut. `clean` keeps all columns and replaces only text (and n_chars); the
verdict is that on the whole text, so what is left of a kept one may have fewer words than the base rules ask for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .units import as_utf8, coded, resident, slices, split_words, texts

MOST_LOST = 0.5
LEAST_WORDS = 10
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "accept cookies", "enable javascript", "click here",
    "sign up", "log in", "subscribe to", "newsletter", "read more", "share this", "follow us", "powered by", "lorem ipsum", "skip to content", "back to top", "page not found",
    "tous droits réservés", "mentions légales", "conditions d'utilisation", "politique de confidentialité", "utilise des cookies", "cliquez ici", "en savoir plus", "abonnez-vous", "retour en haut",
    "todos los derechos reservados", "aviso legal", "términos de uso", "política de privacidad", "utiliza cookies", "haga clic aquí", "leer más", "suscríbete", "volver arriba",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "klicken sie hier", "mehr erfahren", "jetzt anmelden", "nach oben",
)
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(codes: np.ndarray, offsets: np.ndarray, n: int = 5) -> np.ndarray:
    """Words of each text in n-word windows found twice or more in it. codes: equal for equal words."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1 :]) if len(doc) >= n else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.int64)
    grams = [codes[starts + k] for k in range(n)]
    h = doc[starts].astype(np.uint64)
    for g in grams:
        h = (h ^ g.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    equal = doc[starts[a]] == doc[starts[b]]
    for g in grams:
        equal &= g[a] == g[b]
    mark = np.zeros(len(starts), bool)
    mark[a] = mark[b] = True
    cover = np.zeros(len(codes) + 1, np.int64)
    if equal.all():
        hits = starts[mark]
    else:  # two windows share a hash: count exactly
        seen: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(mark):
            seen.setdefault((doc[starts[k]], *(g[k] for g in grams)), []).append(starts[k])
        hits = np.array([s for v in seen.values() if len(v) > 1 for s in v], np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + n, -1)
    return _sums(np.cumsum(cover[:-1]) > 0, offsets)


def assess(values: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(statistics of each text, offsets of texts into their lines, lines that fail)."""
    parts = pc.split_pattern(values, "\n")
    to_line = np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
    lines = parts.flatten()
    word_off, words = split_words(lines)
    per_line = np.diff(word_off)
    codes, distinct = coded(words)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(words) else np.zeros(0, np.int64)
    line_chars = _sums(chars, word_off)
    byte_off, raw = as_utf8(lines)
    symbols = _sums(_SYMBOL[raw], byte_off)
    separator = pc.is_in(distinct, pa.array(["|", "/", ">", "»", "·", "•", "-", "–"])).to_numpy(zero_copy_only=False)[codes] if len(words) else np.zeros(0, bool)
    line_codes, _ = coded(lines)
    doc = np.repeat(np.arange(len(values)), np.diff(to_line))
    with_word = np.flatnonzero(per_line > 0)
    _, first = np.unique(doc[with_word] * (len(lines) + 1) + line_codes[with_word], return_index=True)
    repeated = np.zeros(len(lines), bool)
    repeated[with_word] = True
    repeated[with_word[first]] = False
    bangs = pc.count_substring(lines, "!!").to_numpy(zero_copy_only=False)
    mute = ~pc.match_substring_regex(lines, r"[.,;:!?…]").to_numpy(zero_copy_only=False)
    capitals = pc.and_(pc.equal(lines, pc.utf8_upper(lines)), pc.not_equal(lines, pc.utf8_lower(lines))).to_numpy(zero_copy_only=False)
    stock = pc.match_substring_regex(lines, "|".join(BOILERPLATE), ignore_case=True).to_numpy(zero_copy_only=False)
    failing = (per_line > 0) & (
        (10 * symbols > per_line)
        | ((10 * _sums(separator, word_off) > per_line) & (per_line >= 3))
        | (mute & (per_line >= 10))
        | (10 * bangs > per_line)
        | (capitals & (per_line >= 3))
        | (stock & (per_line <= 30))
        | (repeated & (per_line >= 3))
    )
    to_word = word_off[to_line]
    out = {"n_words": np.diff(to_word), "word_chars": _sums(line_chars, to_line), "n_symbols": _sums(symbols, to_line), "n_dup_lines": _sums(repeated, to_line), "n_repeat_words": repeated_words(codes, to_word)}
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["lost_chars"] = _sums(line_chars * failing, to_line)
    out["kept"] = ~out["base_failed"] & (out["lost_chars"] <= MOST_LOST * out["word_chars"])
    return out, to_line, failing


def _judged(batches):
    resident(None)
    for batch in slices(batches):
        got, _, _ = assess(texts(batch))
        names = [c.split()[0] for c in STATS.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(got[n]) for n in names)], ["doc_id", *names])


def judge(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics and verdict of every document; nothing is shuffled."""
    return docs.select("doc_id", "text").mapInArrow(_judged, "doc_id long, " + STATS)


def _cleaned(names: list[str], text: str):
    def run(batches):
        resident(None)
        for batch in slices(batches, text):
            values = texts(batch, text)
            got, to_line, failing = assess(values)
            if not got["kept"].any():
                continue
            new = values.to_pylist()
            for k in np.flatnonzero(_sums(failing, to_line) > 0):
                own = failing[to_line[k] : to_line[k + 1]]
                new[k] = "\n".join(line for line, bad in zip(new[k].split("\n"), own) if not bad)
            cols = [pa.array(new, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(got["kept"]))

    return run


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents with all their columns, their text without failing lines."""
    fields = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    out = docs.mapInArrow(_cleaned(docs.columns, text), T.StructType(fields))
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
