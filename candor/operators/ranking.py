"""Ranks, positions and selections. Order is always by columns, never by what Spark happens to read first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CATEGORIES, rank_key


def average_rank(value: str, by: list[str] | None = None, descending: bool = False) -> Column:
    """Rank of a value; equal values share the mean of their places. Null values have none."""
    by = by or []
    c = F.col(value)
    order = Window.partitionBy(*by, c.isNull()).orderBy(c.desc() if descending else c.asc())
    ties = Window.partitionBy(*by, c)
    return F.when(c.isNotNull(), F.rank().over(order) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def summary_order(scores: DataFrame) -> DataFrame:
    """Models by composite, undefined last and without a rank."""
    ranked = scores.withColumn("rank", average_rank("composite", descending=True))
    place = Window.orderBy(F.col("composite").desc_nulls_last(), "model")
    return ranked.withColumn("place", F.row_number().over(place))


def ordinal(value: str, by: list[str], ties: list[str]) -> Column:
    """Place in descending order without ties."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc_nulls_last(), *ties))


def rank_shift(a: DataFrame, b: DataFrame, value: str = "composite", key: str = "model") -> DataFrame:
    """Ranks of the keys that both tables score, and how far each moved."""
    both = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).where("a is not null and b is not null")
    out = both.select(key, average_rank("a", descending=True).alias("rank_a"), average_rank("b", descending=True).alias("rank_b"))
    return out.withColumn("shift", F.col("rank_a") - F.col("rank_b"))


def shift_summary(shifts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return shifts.groupBy(*(by or [])).agg(F.sum(F.when(F.col("shift") != 0, 1).otherwise(0)).cast("long").alias("n_changed"), F.max(F.abs("shift")).alias("max_shift"))


def holm(tests: DataFrame, family: list[str]) -> DataFrame:
    """Step-down adjusted p values (column p, ties by name) in each family."""
    order = Window.partitionBy(*family).orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy(*family))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col("p"))
    return tests.withColumn("_step", step).withColumn("p_adjusted", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def stratum(category: str = "category", subcategory: str = "subcategory") -> Column:
    """CATEGORY::subcategory; a blank subcategory is UNSPECIFIED."""
    return F.concat_ws("::", F.upper(F.coalesce(F.col(category), F.lit(""))), F.coalesce(F.nullif(F.col(subcategory), F.lit("")), F.lit("UNSPECIFIED")))


def select_items(items: DataFrame, limit: int | None = None, categories: list[str] | None = None, seed: int = 42, item_id: str = "question_id") -> DataFrame:
    """Items of the categories, `limit` of them taken in turn from the strata by hash, ordered by stratum and id.

    The same for any order of the input. An unknown category or a limit below 1 is an error.
    """
    wanted = [c.upper() for c in categories] if categories else list(CATEGORIES)
    if unknown := sorted(set(wanted) - set(CATEGORIES)):
        raise ValueError(f"unknown categories: {', '.join(unknown)}")
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    name = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    keyed = items.where(F.upper("category").isin(wanted)).withColumn("_stratum", stratum()).withColumn("_id", name)
    if limit is not None:
        keyed = keyed.withColumns({"_rank": rank_key(F.lit(str(seed)), F.col("_stratum"), F.col("_id")), "_turn": rank_key(F.lit(str(seed)), F.col("_stratum"))})
        turn = F.row_number().over(Window.partitionBy("_stratum").orderBy("_rank", "_id"))
        keyed = keyed.withColumn("_round", turn).where(F.col("_round") <= limit).orderBy("_round", "_turn", "_rank").limit(limit)
    return keyed.orderBy("_stratum", "_id").select(items.columns)


def selection_manifest(picked: DataFrame, item_id: str = "question_id") -> DataFrame:
    """One row: the number of items, their counts by category and stratum, and a hash of all ids in order.

    The hash is one of the whole list, so the ids of the selection, which `limit` bounds, come into one row.
    """
    x = picked.select(F.upper(F.coalesce("category", F.lit(""))).alias("c"), stratum().alias("s"), F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"))
    counts = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    by_c, by_s = (x.groupBy(k).agg(F.count("*").alias("n")).agg(counts(k).alias(a)) for k, a in (("c", "category_counts"), ("s", "stratum_counts")))
    ids = x.agg(F.count("*").alias("n_selected"), F.transform(F.array_sort(F.collect_list(F.struct("s", "i"))), lambda r: r["i"]).alias("question_ids"))
    out = ids.crossJoin(F.broadcast(by_c)).crossJoin(F.broadcast(by_s))  # one row each
    return out.select("n_selected", "category_counts", "stratum_counts", F.sha2(F.to_json("question_ids"), 256).alias("question_ids_sha256"), "question_ids")


def validation_packet(records: DataFrame, per_cell: int, seed: int = 42) -> DataFrame:
    """`per_cell` records by hash of each model and category, shuffled by hash and numbered."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), "model", "category", F.col("question_id").cast("string")), 256)
    keyed = records.withColumn("selection_hash", key)
    cell = F.row_number().over(Window.partitionBy("model", "category").orderBy("selection_hash"))
    picked = keyed.withColumn("_n", cell).where(F.col("_n") <= per_cell).drop("_n")
    short = F.count("*").over(Window.partitionBy("model", "category")) < per_cell
    picked = picked.withColumn("short_cell", short)
    number = F.row_number().over(Window.orderBy("selection_hash"))  # cells x per_cell rows
    return picked.withColumn("validation_id", F.format_string("V%04d", number))


def most_common(rows: DataFrame, by: list[str], value: str, k: int, seen: str) -> DataFrame:
    """The k most frequent values of each group; ties go to the value seen first."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(seen).alias("_first"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_first"))
    return n.withColumn("place", place).where(F.col("place") <= k).drop("_first")


def later_occurrence(by: list[str], pos: str) -> Column:
    """True from a key's second row on, in file order."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(pos)) > 1


def numbered(rows: DataFrame, pos: str, prefix: str, by: list[str] | None = None) -> DataFrame:
    """Ids PREFIX-0001 and on, in order of `pos`, for each group."""
    return rows.withColumn("fact_id", F.format_string(f"{prefix}-%04d", F.row_number().over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(pos))))


def leader(rows: DataFrame, by: list[str], value: str, key: str) -> DataFrame:
    """The key with the largest value of each group; ties go to the smaller key."""
    best = F.min(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.k").alias(key), (-F.col("b.v")).alias(value))
