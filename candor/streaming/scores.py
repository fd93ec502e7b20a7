"""Scores of a growing log of records, kept by additive counts.

Records arrive as files of JSON lines; a (model, question) counts once, for the watermark's length of time. Each
batch adds its counts by model, category, subcategory and bin to a table of small snapshots; scores of any level
are sums of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring
from ..sources import readers

KEYS = ["model", "category", "subcategory"]


def source(spark: SparkSession, path: str, schema: str = readers.RECORD, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def distinct_facts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Flat facts, each (model, question) once within the watermark of its completion time."""
    timed = stream.withColumn("_at", F.coalesce(F.try_to_timestamp("completed_at_utc"), F.current_timestamp()))
    return readers.facts(timed.withWatermark("_at", late).dropDuplicatesWithinWatermark(["model", "question_id"]))


def start(facts: DataFrame, table: str, checkpoint: str, n_bins: int = 10):
    """Appends each batch's counts to a Parquet table; a batch that is run again replaces its own folder."""

    def add(batch: DataFrame, number: int) -> None:
        scoring.partials(batch, KEYS, n_bins).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return facts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def current(spark: SparkSession, table: str, keys: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores from all counts so far."""
    return scoring.collapse(spark.read.parquet(table), keys or ["model"], weights)
