"""Media columns over content-addressed payloads in tar shards.

Each task packs the payloads of its rows into tar files of its own. A payload's member is named by its SHA-256
and stored once in a task, however many rows hold it. Of the places that tasks stored a payload at, the catalog
keeps one for each digest, so a row's digest says where its payload lies: shard, offset and length of the stored
form. The stored form here is an 8-bit greyscale PNG, WIDTH samples to a line, whose header's 33 bytes say
everything about the shape: metadata columns come from range reads of these bytes alone. Payloads are read back
once for each digest, in the order in which they lie in the shards, and joined to the rows that hold them.

A payload is the text's UTF-8 bytes, padded with blanks to a positive multiple of WIDTH.

Rows and shards are committed together: shards have names of their own for each attempt of a task, and only the
index rows of attempts that succeeded are kept, so a lost executor leaves unused files at most. Null texts count
as empty: one line of blanks. Equal texts have equal digests, so ties and repeated rows need no rule. Payloads
are written and read one by one; extra columns of the input aren't carried.
"""

from __future__ import annotations

import hashlib

import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import even_join, new_path, written
from .units import slices, texts

WIDTH = 192
SHARD_BYTES = 256 << 20
#: Stored bytes that one task reads back, about.
READ_BYTES = 64 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Digests that a task remembers, some 200 MB.
MOST_HELD = 1_000_000
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def payload_of(text: str) -> tuple[bytes, int]:
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (WIDTH - len(data) if not data else -len(data) % WIDTH), len(data)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    height = len(payload) // WIDTH
    rows = np.zeros((height, WIDTH + 1), np.uint8)  # each line begins with filter 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bits, colour type) from the first 33 bytes; raises if they are damaged."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def decode_png(data: bytes) -> bytes:
    width, height, bits, colour = png_header(data[:HEADER_BYTES])
    if (bits, colour) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    at, body = HEADER_BYTES, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("a line filter that isn't written here")
    return rows[:, 1:].tobytes()


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(name: str, size: int) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT)


def _store(folder: str):
    def run(batches):
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        out, name, at, held = None, "", 0, {}
        try:
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch).to_pylist()):
                    payload, n = payload_of(text)
                    digest = hashlib.sha256(payload).hexdigest()
                    if digest not in held:
                        if out is None or at > SHARD_BYTES:
                            if out is not None:
                                out.write(bytes(1024))
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.tar", 0
                            out = system.open_output_stream(f"{root}/{name}")
                        form = encode_png(payload)
                        out.write(_member(f"{digest}.png", len(form)) + form + bytes(-len(form) % 512))
                        if len(held) >= MOST_HELD:
                            held.clear()  # stored again where it comes again; the catalog keeps one place
                        held[digest] = (name, at + 512, len(form))
                        at += 512 + len(form) + -len(form) % 512
                    rows.append((doc_id, n, digest, *held[digest]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k in (2, 3) else pa.int64()) for k, c in enumerate(zip(*rows))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(bytes(1024))
                out.close()

    return run


def store(docs: DataFrame) -> tuple[DataFrame, str]:
    """(index, folder of the shards) for docs (doc_id, text). The index is written once and read back."""
    spark = docs.sparkSession
    folder, index = new_path(spark, "tars"), new_path(spark, "media-index")
    docs.select("doc_id", "text").mapInArrow(_store(folder), INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index), folder


def catalog(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length, rows: one place for each digest, and its number of rows; dealt and ordered for reading."""
    spark = index.sparkSession
    own = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"), F.count("*").alias("rows")).select("digest", "at.*", "rows")
    own = written(own, "media-catalog")
    parts = max(2 * spark.sparkContext.defaultParallelism, (own.agg(F.sum("length")).first()[0] or 0) // READ_BYTES)
    return own.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


_KINDS = {"long": pa.int64(), "string": pa.string()}


def _ranged(folder: str, visit, kept: list[str], added: str):
    names, kinds = zip(*(c.split() for c in added.split(", ")))

    def run(batches):
        system, root = _filesystem(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["shard"] != name:
                    if file:
                        file.close()
                    name, file = r["shard"], system.open_input_file(f"{root}/{r['shard']}")
                rows.append(visit(file, r))
            if rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, _KINDS[t]) for c, t in zip(zip(*rows), kinds))], [*kept, *names])
        if file:
            file.close()

    return run


def _with(places: DataFrame, folder: str, visit, added: str) -> DataFrame:
    """places (shard, offset, length and others) with the columns that visit(file, row) reads."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in places.schema)
    return places.mapInArrow(_ranged(folder, visit, places.columns, added), f"{schema}, {added}")


def metadata(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height, bits, colour, from range reads of the headers only."""

    def visit(f, r):
        f.seek(r["offset"])
        return png_header(f.read(HEADER_BYTES))

    return _with(places, folder, visit, "width long, height long, bits long, colour long")


def feature_of(payload: bytes) -> str:
    """Mean, deviation and zero crossings of the samples and their histogram in sixteen classes, as hex of the parts."""
    x = np.frombuffer(payload, np.uint8)
    mean = float(x.mean())
    crossings = int(np.count_nonzero(np.diff(x > mean)))
    classes = np.bincount(x >> 4, minlength=16)
    return f"{mean:.4f}:{float(x.std()):.4f}:{crossings}:" + "".join(f"{int(255 * c // len(x)):02x}" for c in classes)


def _features(f, r):
    f.seek(r["offset"])
    form = f.read(r["length"])
    payload = decode_png(form)
    digest = hashlib.sha256(payload).hexdigest()
    if digest != r["digest"] or r["width"] * r["height"] != len(payload):
        raise ValueError(f"shard {r['shard']} doesn't hold {r['digest']} at {r['offset']}")
    return (len(payload), digest, zlib.crc32(payload[-16:]), len(form), hashlib.sha256(form).hexdigest(), feature_of(payload))


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, what the payload read back gives (FEATURES), its place and the header's columns, for each row of index."""
    read = written(_with(metadata(catalog(index), folder), folder, _features, FEATURES), "media-features")
    rows = even_join(index.select("doc_id", "n_bytes", "digest"), read, ["digest"], index.count(), F.col("doc_id"))
    return rows.select("doc_id", "n_bytes", *(c.split()[0] for c in FEATURES.split(", ")), "digest", "shard", "offset", "length", "width", "height", "bits", "colour")
