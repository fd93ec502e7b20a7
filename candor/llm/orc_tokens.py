"""Token ids in ORC files, in ascending order of the document id.

Rows are dealt by ranges of doc_id, so that file k holds smaller ids than file k + 1; each task tokenises its
range and Spark's ORC writer stores the ids with integer run-length encoding, a row index every ROW_GROUP rows
and Bloom filters on doc_id. A row also carries its number of ids and the ids before it in its file, so the
place of each document follows from one sum per file, read from two narrow columns. Files are split by stripe
for reading; `lookup` prunes them by footers, row indexes and Bloom filters.

Null texts count as empty and hold the end id only. Rows whose doc_id is null come first. Rows with the same
doc_id stay beside each other, in the order of the input's partitions, and may fill several files. A row is stored
whole, however long its text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import new_path
from .units import encoder, merged, texts, u32_crc

END_ID = 0
ROW_GROUP = 1000
STRIPE_BYTES = 8 << 20
#: Bytes of text for each file, and the most files; beyond that many they grow.
FILE_BYTES, MOST_FILES = 32 << 20, 100_000


def _tokenise(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for batch in merged(batches):
            off, ids = encoder(path, words=False).encode(texts(batch))
            n = np.diff(off) + 1
            at = np.concatenate([[0], np.cumsum(n)])
            out = np.full(at[-1], end, np.int32)
            keep = np.ones(at[-1], bool)
            keep[at[1:] - 1] = False
            out[keep] = ids.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(before + at[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(out))],
                ["part", "doc_id", "file_start", "n_tokens", "ids"],
            )
            before += int(at[-1])

    return run


def write(docs: DataFrame, tokenizer: str, end: int = END_ID, files: int | None = None) -> str:
    """Writes the ids of docs (doc_id, text) and returns the folder."""
    spark = docs.sparkSession
    path = new_path(spark, "ids-orc")
    if files is None:
        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = min(MOST_FILES, max(1, -(-total // FILE_BYTES), spark.sparkContext.defaultParallelism))
    by = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]  # equal doc_ids are dealt by their rows
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *by).sortWithinPartitions(*by)
    rows = rows.select("doc_id", "text").mapInArrow(_tokenise(tokenizer, end), "part int, doc_id long, file_start long, n_tokens long, ids array<int>")
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", ROW_GROUP).option("orc.stripe.size", STRIPE_BYTES).orc(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, read by stripes from the files."""
    rows = spark.read.schema("part int, doc_id long, file_start long, n_tokens long, ids array<int>").orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("n"))
    base = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))  # MOST_FILES rows at most
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the ORC reader skips stripes and row groups by index and Bloom filter."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def _checked(batches):
    for batch in batches:
        if batch.num_rows:
            lists = batch.column("ids").cast(pa.large_list(pa.int32()))
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            crc = [u32_crc(flat[a:b]) for a, b in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checked(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of `read`, counted and summed from the ids that were read."""
    return rows.select("doc_id", "start", "ids").mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
