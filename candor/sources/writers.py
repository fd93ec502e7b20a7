"""Sinks. Spark's commit protocol makes each of them whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with keys in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dataset(df: DataFrame, path: str, pos: str = "pos") -> None:
    """One JSON list of all rows in order of `pos`; a dataset of benchmark items, thousands of rows, is one file."""
    fields = F.struct(*sorted(c for c in df.columns if c != pos))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("k"), F.to_json(fields).alias("v")))).alias("r"))
    rows.select(F.concat(F.lit("[\n"), F.array_join(F.transform("r", lambda x: x["v"]), ",\n"), F.lit("\n]")).alias("value")).write.mode("overwrite").text(path)


def json_object(df: DataFrame, path: str) -> None:
    """One row as a JSON object, with keys in order of name; any other number of rows is an error."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).agg(F.count("*").alias("n"), F.first("value").alias("value"))
    one = F.when(F.col("n") == 1, F.col("value")).otherwise(F.raise_error(F.lit("an object is one row")).cast("string"))
    rows.select(one.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv(df: DataFrame, path: str, columns: list[str], bom: bool = False) -> None:
    """The named columns that exist; null is empty."""
    shown = df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    if bom:
        shown = shown.withColumnRenamed(columns[0], "﻿" + columns[0])
    shown.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def records(df: DataFrame, path: str) -> None:
    """Records as Parquet, in one folder for each model, so that reading a model prunes the others."""
    df.repartition("model").write.mode("overwrite").partitionBy("model").parquet(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A report table of `limit` rows at most; a last row tells how many more there are."""
    rows = df.limit(limit + 1).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    more = f"\n| and {df.count() - limit} more rows |" + " |" * (len(df.columns) - 1) if len(rows) > limit else ""
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]) + more


def run_package(facts: DataFrame, folder: str) -> None:
    """The standard tables of a run: summary, by category, by subcategory and the records."""
    from ..operators import ranking, scoring

    grouped = scoring.grouped_scores(facts)
    ranking.summary_order(scoring.scores(facts)).write.mode("overwrite").parquet(f"{folder}/summary")
    grouped.where("level <> 'model'").repartition(1).write.mode("overwrite").partitionBy("level").parquet(f"{folder}/groups")
    records(facts, f"{folder}/records")
