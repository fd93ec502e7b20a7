"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than one in HOT_PARTS of all rows is salted; there are fewer than HOT_PARTS such keys.
HOT_PARTS = 1000
#: Scan partitions below this size are put together before a table of many small files is written.
SCAN_BYTES = 48 << 20
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the directory set on the context; a temporary folder only in local mode without either."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="candor-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def few_files(scan: DataFrame) -> DataFrame:
    """A scan without partitions much below SCAN_BYTES, twice the cores at least, so that what is written has few files."""
    n = scan.rdd.getNumPartitions()
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    few = max(2 * scan.sparkSession.sparkContext.defaultParallelism, size // SCAN_BYTES)
    return scan.coalesce(few) if few < n else scan


def few_parts(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df of about so many rows in few partitions, where Spark doesn't put small ones together by itself."""
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == df.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true":
        return df
    return df.repartition(1 + rows // each)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df, written as Parquet and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def settle(spark: SparkSession) -> None:
    """A full collection in each executor, after which its JVM gives the memory of earlier stages back to the system.

    Stages of very different kinds share one set of executors; a heap that one has grown stays taken beside the
    Python workers of the next. No data is read; where an executor gets no such task nothing but that is missed.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).where("java_method('java.lang.System', 'gc') is not null").count()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_stored", None):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def even_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, spread: Column, how: str = "inner", unique: bool = True) -> DataFrame:
    """rows joined with table, whose column `rows` has the number of rows with its key (total: of all), by shuffles only.

    Keys with more than one in HOT_PARTS of all rows are salted on both sides by `spread`, so none is one task's work.
    What is broadcast are these keys with their number of salts, fewer than HOT_PARTS whatever the input. Rows whose
    key is null match nothing and are dealt evenly. unique: each key is one row of table. The result doesn't have the
    column `rows`.
    """
    salts = F.ceil(F.col("rows") * HOT_PARTS / F.lit(max(total, 1))).cast("int")
    hot = table.where(F.col("rows") * HOT_PARTS > total).select(*on, salts.alias("salts"))
    hot = F.broadcast(hot if unique else hot.distinct())
    absent = reduce(or_, (F.col(c).isNull() for c in on))
    dealt = rows.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64(spread), F.coalesce("salts", F.when(absent, HOT_PARTS).otherwise(1))).cast("int")).drop("salts")
    some = F.when(F.col("rows") * HOT_PARTS > total, salts).otherwise(1)
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), some - 1))).drop("rows"), [*on, "salt"], how).drop("salt")
