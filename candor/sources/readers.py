"""Readers with declared schemas and strict checks. Paths go to Spark's own readers only."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RESPONSE = "struct<ok: boolean, text: string, requested_model: string, resolved_model: string, provider: string, metadata: string, usage: string, attempts: int, cache_hit: boolean, error_type: string, error_message: string>"
RECORD = (
    "question_id string, model string, category string, subcategory string, k int, started_at_utc string, completed_at_utc string, "
    f"answer_response {RESPONSE}, confidence_response {RESPONSE}, parsed_confidence double, confidence_parse_strategy string, confidence_parse_reason string, confidence_terminal boolean, "
    "classification struct<label: string, is_correct: boolean, abstention_detected: boolean, hedge_detected: boolean, substantive_answer_detected: boolean, reasons: array<string>, automated_label: string, adjudicated_label: string>, "
    "answer_valid boolean, confidence_valid boolean, exclusion_reason string, prompt_sha256 string"
)


def record_schema(answer_valid: str = "answer_valid", confidence_valid: str = "confidence_valid") -> str:
    """The schema of records whose two validity flags have other names in the files."""
    return RECORD.replace("answer_valid boolean", f"{answer_valid} boolean").replace("confidence_valid boolean", f"{confidence_valid} boolean")


EVIDENCE = "array<struct<source_id: string, url: string, publisher: string, title: string, published_at: string, retrieved_at: string, verified_at: string, snapshot_path: string, snapshot_sha256: string, evidence: string>>"
NOVELTY = "struct<status: string, basis: string, claim_became_true_at: string, source_id: string, reviewer_type: string, verified_at: string, evidence: string>"
ITEM = (
    "question_id string, category string, subcategory string, question string, correct_answer string, acceptable_answers array<string>, answer_aliases array<string>, expected_knowability int, "
    "knowability_by_model map<string,int>, document string, redacted_value string, event_date string, release_status string, qc_passed boolean, "
    f"temporal_novelty {NOVELTY}, source_evidence {EVIDENCE}"
)
FACT = f"fact_id string, subcategory string, event_date string, question_target string, gold_answer string, acceptable_answers array<string>, temporal_novelty {NOVELTY}, source_evidence {EVIDENCE}, verification struct<status: string, reviewer_type: string, verified_at: string>"


def dataset(spark: SparkSession, path: str, item: str = ITEM) -> DataFrame:
    """Items with `pos`, from a JSON list or an object that holds one as questions, data or items; else an error."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_colons(item)}>>")
    boxed = F.from_json("value", ", ".join(f"{k} array<struct<{_colons(item)}>>" for k in ("questions", "data", "items")))
    first = F.substring(F.ltrim("value"), 1, 1)
    arrays = F.when(first == "[", listed).when(first == "{", F.coalesce(boxed["questions"], boxed["data"], boxed["items"]))
    checked = F.coalesce(arrays, F.raise_error(F.lit("a dataset is a list, or an object with questions, data or items")).cast(f"array<struct<{_colons(item)}>>"))
    return rows.select(F.posexplode(checked).alias("pos", "item")).select("pos", "item.*")


def _colons(ddl: str) -> str:
    """Top-level `name type` pairs as `name: type`."""
    out, depth, part = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += c
    return ", ".join(out)


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines of a declared schema; a line that can't be read is an error unless strict is off."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def records(spark: SparkSession, path: str, strict: bool = True, answer_valid: str = "answer_valid", confidence_valid: str = "confidence_valid") -> DataFrame:
    """Flat facts of a file of records; the last arguments name its two validity flags."""
    rows = jsonl(spark, path, record_schema(answer_valid, confidence_valid), strict)
    return facts(rows.withColumnsRenamed({answer_valid: "answer_valid", confidence_valid: "confidence_valid"}))


def facts(recorded: DataFrame) -> DataFrame:
    """Flat facts for scoring, from nested evaluation records."""
    return recorded.select(
        "model", "question_id", "category", "subcategory", "k", F.col("answer_valid").alias("answered"), F.col("confidence_valid").alias("rated"), F.col("confidence_terminal").alias("terminal"),
        F.col("parsed_confidence").alias("confidence"), F.col("classification.label").alias("label"), F.col("classification.is_correct").alias("is_correct"), F.col("answer_response.text").alias("answer"), completion_tokens(F.col("answer_response.usage")).alias("tokens"),
    )


def completion_tokens(usage) -> object:
    """The first number under the names that providers use for output tokens, of a JSON text."""
    names = ("completion_tokens", "output_tokens", "completion_token_count", "output_token_count", "generated_tokens")
    return F.coalesce(*[F.get_json_object(usage, f"$.{n}").try_cast("double").cast("long") for n in names])


def csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A CSV file with a header, with or without a byte order mark; a repeated key is an error."""
    df = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if key:
        n = df.groupBy(key).agg(F.count("*").alias("_n"))
        df = df.join(n, key).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("repeated key "), key)).cast("string"))).drop("_n")
    return df


def capability_scores(spark: SparkSession, path: str) -> DataFrame:
    """(model, capability_score) of a CSV, a JSON object of scores by model, or a JSON list of rows; blank scores are left out.

    The score may be named CQ.
    """
    if path.lower().endswith(".json"):
        rows = spark.read.schema("value string").text(path, wholetext=True)
        row = "array<struct<model: string, capability_score: string, CQ: string>>"
        mapped = F.transform(F.map_entries(F.from_json("value", "map<string,string>")), lambda e: F.struct(e["key"].alias("model"), e["value"].alias("capability_score"), F.lit(None).cast("string").alias("CQ")))
        df = rows.select(F.explode(F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.from_json("value", row)).otherwise(mapped)).alias("r")).select("r.*")
    else:
        df = csv(spark, path)
    named = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("capability_score", "CQ") if c in df.columns]
    return df.select("model", F.coalesce(*named).try_cast("double").alias("capability_score")).dropna()


def capability_counts(spark: SparkSession, path: str) -> DataFrame:
    """(model, successes, trials) of a CSV; rows without whole numbers are left out."""
    df = csv(spark, path).select("model", F.col("n_correct").try_cast("long").alias("successes"), F.col("n_scored").try_cast("long").alias("trials"))
    return df.dropna()


def checked_counts(counts: DataFrame) -> DataFrame:
    """(model, capability_score, successes, trials), best first; counts that can't be are an error that names the model."""
    good = F.coalesce((F.col("trials") > 0) & F.col("successes").between(0, F.col("trials")), F.lit(False))
    named = F.raise_error(F.concat(F.lit("implausible counts of "), F.coalesce("model", F.lit("a row without a model")))).cast("long")
    checked = counts.withColumn("trials", F.when(good, F.col("trials")).otherwise(named))
    score = F.coalesce("capability_score", F.col("successes") / F.col("trials")) if "capability_score" in counts.columns else F.col("successes") / F.col("trials")
    return checked.select("model", score.alias("capability_score"), "successes", "trials").orderBy(F.desc("capability_score"), "model")


def canonical(value) -> str:
    """JSON with keys in order and without blanks, the form whose SHA-256 identifies a value."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(StringType())
def canonical_sha256(values: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts."""
    return values.map(lambda v: None if v is None else hashlib.sha256(canonical(json.loads(v)).encode()).hexdigest())


def tree_sha256(spark: SparkSession, path: str, suffix: str = ".py") -> str:
    """One hash of the names and contents of a source tree, whose files are few and small."""
    files = catalog(spark, path).where(F.lower("path").endswith(suffix))
    root = spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    rows = [(r.path.split(root, 1)[1], r.sha256) for r in files.select("path", "sha256").collect()]
    return hashlib.sha256(canonical([{"path": p, "sha256": h} for p, h in sorted(rows)]).encode()).hexdigest()


def route_of(rows: DataFrame, routes: DataFrame, default: str = "unknown") -> DataFrame:
    """rows with the serving route of their model, `default` where none is known."""
    return rows.join(routes.select("model", "route"), "model", "left").withColumn("route", F.coalesce("route", F.lit(default)))


def adjudication(spark: SparkSession, path: str, labels: tuple[str, ...]) -> DataFrame:
    """(model, question_id, label) of an object {"model::question": label} or a list of such rows."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    listed = F.from_json("value", "array<struct<model: string, question_id: string, label: string>>")
    entry = F.map_entries(F.from_json("value", "map<string,string>"))
    pairs = F.transform(entry, lambda e: F.struct(F.split(e["key"], "::")[0].alias("model"), F.split(e["key"], "::")[1].alias("question_id"), e["value"].alias("label")))
    x = rows.select(F.explode(F.when(F.substring(F.ltrim("value"), 1, 1) == "[", listed).otherwise(pairs)).alias("e")).select("e.*")
    return x.withColumn("label", F.when(F.col("label").isin(*labels), F.col("label")).otherwise(F.raise_error(F.lit("unknown label")).cast("string")))


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[str, str] | None]:
    """(facts with pos, event window) of a ledger file."""
    rows = spark.read.schema("value string").text(path, wholetext=True)
    x = rows.select(F.from_json("value", f"event_window struct<start: string, end: string>, facts array<struct<{_colons(FACT)}>>").alias("l"))
    w = x.select("l.event_window.*").first()
    window = (w["start"], w["end"]) if w and w["start"] and w["end"] else None
    return x.select(F.posexplode("l.facts").alias("pos", "fact")).select("pos", "fact.*"), window


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checkpoint(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Rows of an append log whose header has this fingerprint; another one is an error."""
    rows = spark.read.parquet(path)
    return rows.withColumn("fingerprint", F.when(F.col("fingerprint") == fingerprint, F.col("fingerprint")).otherwise(F.raise_error(F.lit("the log belongs to another experiment")).cast("string"))).dropDuplicates(["model", "question_id"])


def append_checkpoint(rows: DataFrame, path: str, fingerprint: str) -> None:
    """Adds rows that are scored and final to an append log."""
    final = rows.where("answered and (rated or terminal)")
    final.withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").parquet(path)


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached answer of the same content, if there is one; only successes are ever cached."""
    return requests.join(cache.where("ok").select("request_sha256", "response"), "request_sha256", "left").withColumn("cache_hit", F.col("response").isNotNull())


def cache_answers(answers: DataFrame, path: str) -> None:
    """Adds answers (request_sha256, ok, response) that succeeded and aren't there yet to a cache of Parquet files."""
    fresh = answers.where("ok").dropDuplicates(["request_sha256"])
    spark = answers.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.schema(fresh.schema).parquet(path).select("request_sha256"), "request_sha256", "left_anti")
    fresh.select("request_sha256", "ok", "response").write.mode("append").parquet(path)


def manifest_source(manifest: DataFrame, parser: str) -> DataFrame:
    """The one source of a manifest (parser, ...) that a parser reads; none or several are an error."""
    own = manifest.where(F.col("parser") == parser)
    n = own.agg(F.count("*").alias("_n"))
    one = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.concat(F.lit(f"sources of parser {parser}: "), F.col("_n").cast("string"))).cast("boolean"))
    return n.where(one).join(own, how="left").drop("_n")


def request_key(*columns: str):
    """The identity of a request: SHA-256 of its fields as JSON, in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
