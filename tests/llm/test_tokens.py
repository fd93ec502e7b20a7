"""Operators 1, 3 and 7 against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from candor.llm import bpe, orc_tokens, packing

from .cases import awkward, empty

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path, texts):
    tok = Tokenizer.from_file(path)
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], tok


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def check_packing(rows, want, window=2048, end=1):
    """rows: of the query; want: [(doc_id, text's ids)] as a multiset of documents."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    have = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    for doc_id, ids in want:
        whole, at = [*ids, end], 0
        while at < len(whole):
            k = next(k for k, h in enumerate(have) if h[0] == str(doc_id) and h[1] == at and h[4] == len(whole) and h[3] == crc(whole[at : at + h[2]]))
            at += have.pop(k)[2]
        assert at == len(whole)
    assert not have
    return 1 - sum(r.length for r in rows) / (window * len(by_sequence))


def test_packing_awkward_rows(spark):
    docs = awkward(spark)
    local = docs.collect()
    ids, _ = library(WORD, [r.text or "" for r in local])
    rows = packing.pack(packing.pieces(docs, WORD)).collect()
    check_packing(rows, [(r.doc_id, i) for r, i in zip(local, ids)])
    assert packing.pack(packing.pieces(empty(spark), WORD)).collect() == []


@pytest.mark.parametrize("lengths", [[700] * 400, list(range(1, 500)), [1500] * 90, [1200] * 50 + [3] * 20])
def test_packing_leaves_little_padding(spark, lengths):
    docs = spark.createDataFrame([(k, "a " * (n - 1)) for k, n in enumerate(lengths)], "doc_id long, text string")
    rows = packing.pack(packing.pieces(docs, WORD)).collect()
    one = library(WORD, ["a"])[0][0]
    padding = check_packing(rows, [(k, one * (n - 1)) for k, n in enumerate(lengths)])
    assert padding < 0.02 + 1 / max(1, sum(lengths) // 2048)


def test_nnls_against_kkt():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12)
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_tree_equals_the_library_on_awkward_texts():
    random.seed(2)
    parts = ["a", "B", " ", "  ", "\n", "É", "é", "́", "İ", "'s", "'", "12", "3.5", "$$", "<|endoftext|>", "\xa0", "日本", "😀", "ing", "the ", "\x0b", "\x85"]
    tree = bpe.TreeBpe(WORD, leaf=32, window=4, unsplit=8)
    for n in (40, 300, 1500):
        texts = ["".join(random.choices(parts, k=random.randint(0, n))) for _ in range(120)]
        texts += ["".join(random.choices("abcdefghinotrs", k=random.randint(1, n))) for _ in range(60)]
        texts += ["".join(random.choices(["é", "日", "😀", "a", "th"], k=random.randint(1, n))) for _ in range(60)] + ["", " " * n, "a" * n, "!" * n, "ab" * n]
        want, tok = library(WORD, texts)
        off, ids = tree.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == want
        assert tree.decode(off, ids).to_pylist() == tok.decode_batch(want, skip_special_tokens=False)


def test_tree_digests_of_rows(spark):
    docs = awkward(spark)
    local = docs.collect()
    ids, tok = library(WORD, [r.text or "" for r in local])
    want = sorted((str(r.doc_id), len(i), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(local, ids))
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(docs, WORD).collect()) == want
    assert bpe.digests(empty(spark), WORD).collect() == []
    there = bpe.decode_column(bpe.encode_column(docs, WORD, out="tokens"), "tokens" and WORD, ids="tokens").collect()
    assert sorted(r.decoded for r in there) == sorted(tok.decode(i, skip_special_tokens=False) for i in ids)


def test_orc_round_trip(spark):
    docs = awkward(spark).where("doc_id is null or doc_id <> 4")
    local = sorted(docs.collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    ids, _ = library(BYTE, [r.text or "" for r in local])
    path = orc_tokens.write(docs, BYTE, files=3)
    got = orc_tokens.checked(orc_tokens.read(spark, path)).collect()
    start, want = 0, []
    for r, i in zip(local, ids):
        want.append((r.doc_id, start, len(i) + 1, crc([*i, 0])))
        start += len(i) + 1
    strip = lambda rows: sorted(map(str, rows))
    assert strip(tuple(r) for r in got if r.doc_id is not None) == strip(w for w in want if w[0] is not None)
    assert sorted(r.ids_crc32 for r in got) == sorted(w[3] for w in want)
    assert [r.doc_id for r in orc_tokens.lookup(spark, path, [5]).collect()] == [5]
    empty_path = orc_tokens.write(empty(spark), BYTE)
    assert orc_tokens.checked(orc_tokens.read(spark, empty_path)).collect() == []


def test_equal_and_null_ids_are_dealt_to_several_files(spark):
    docs = spark.createDataFrame([(7 if k % 3 else None, f"word {k}") for k in range(400)], "doc_id long, text string").repartition(4)
    path = orc_tokens.write(docs, BYTE, files=4)
    parts = [r["count"] for r in spark.read.orc(path).groupBy("part").count().collect()]
    assert len(parts) == 4 and max(parts) < 200
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in orc_tokens.read(spark, path).collect())
    assert len(rows) == 400 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:])) and [r[2] for r in rows] == sorted((r[2] for r in rows), key=lambda i: -1 if i is None else i)


def test_files_have_row_indexes_and_bloom_filters(spark):
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(5000)], "doc_id long, text string")
    path = orc_tokens.write(docs, BYTE, files=1)
    jvm = spark._jvm
    name = jvm.org.apache.hadoop.fs.Path(spark.read.orc(path).inputFiles()[0])
    reader = jvm.org.apache.orc.OrcFile.createReader(name, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))
    assert reader.getRowIndexStride() == orc_tokens.ROW_GROUP
    stripe = reader.getStripes().get(0)
    streams = reader.rows().readStripeFooter(stripe).getStreamsList()
    kinds = {str(streams.get(k).getKind()) for k in range(streams.size())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and stripe.getIndexLength() > 0
    encodings = reader.rows().readStripeFooter(stripe).getColumnsList()
    assert {str(encodings.get(k).getKind()) for k in range(encodings.size())} == {"DIRECT", "DIRECT_V2"}  # version 2 of integer run lengths
