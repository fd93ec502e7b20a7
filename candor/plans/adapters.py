"""The shared test tables read as evaluation records, answers, coders and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = {
    "model": "concat('m', lpad(cast(model_no as string), 2, '0'))",
    "item_no": "item_no",
    "question_id": "concat('q', lpad(cast(item_no as string), 6, '0'))",
    "category": "category",
    "subcategory": "concat(category, '-S', cast((item_no div 4) % 5 as string))",
    "k": "case when model_no = 11 and category = 'PCQ' then 1 else 0 end",
    "answered": "event_type <> 'error'",
    "terminal": "event_type = 'signup' and kk % 10 = 0",
    "confidence": "case when event_type = 'error' or (event_type = 'signup' and kk % 10 = 0) then null else kk / 100D end",
    "label": "case when event_type = 'error' then null when u < 3 + model_no % 5 then 'ABSTAIN' when u < 5 + model_no % 7 then 'HEDGE' when category in ('PCQ', 'HNQ') and u < 12 + model_no % 4 then 'CONFIDENT_CORRECT' else 'CONFIDENT_WRONG' end",
    "answer_error": "case when event_type = 'error' and kk % 3 > 0 then element_at(array('timeout', 'refused'), cast(kk % 3 as int)) end",
    "parse_reason": "case when event_type = 'signup' and kk % 20 = 0 then 'no_numeric_token' end",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of 12 models, from all events; only three columns are read."""
    events = table(spark, sf_dir, "events")
    x = events.selectExpr("cast(event_id % 12 as int) as model_no", "event_id div 12 as item_no", "event_type", "cast(get_json_object(props, '$.k') as int) as kk")
    x = x.selectExpr("*", "element_at(array('FEQ', 'PCQ', 'HNQ', 'CCQ'), cast(item_no % 4 as int) + 1) as category", "(kk * 7 + item_no) % 20 as u")
    x = x.selectExpr(*[f"{e} as {c}" for c, e in RECORDS.items()])
    return x.withColumn("rated", F.col("confidence").isNotNull()).withColumn("is_correct", F.coalesce(F.col("label") == "CONFIDENT_CORRECT", F.lit(False)))


def records_at_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from lineitem: more rows, for timing."""
    x = table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey % 12 as int) as model_no", "l_orderkey as item_no", "l_linenumber", "l_discount", "l_returnflag")
    x = x.selectExpr("*", "element_at(array('FEQ', 'PCQ', 'HNQ', 'CCQ'), cast(item_no % 4 as int) + 1) as category", "cast(round(l_discount * 1000) as int) % 20 + l_linenumber as u")
    return x.selectExpr(
        "concat('m', lpad(cast(model_no as string), 2, '0')) as model", "concat_ws('-', cast(item_no as string), cast(l_linenumber as string)) as question_id", "category",
        "concat(category, '-S', cast((item_no div 4) % 5 as string)) as subcategory", "0 as k", "l_returnflag <> 'A' as answered", "true as rated", "false as terminal",
        "l_discount * 10 as confidence", "case when u < 4 then 'ABSTAIN' when u < 7 then 'HEDGE' when u < 14 then 'CONFIDENT_CORRECT' else 'CONFIDENT_WRONG' end as label", "u between 7 and 13 as is_correct",
    )


#: Answers made of a fixed sentence, by doc_id % 12, and a document.
TEMPLATES = (
    "I do not know.",
    "I don't have any information about this.",
    "The answer is 42.",
    "Perhaps it was Anna Berg.",
    "It is unknown. The answer is 7.",
    "The document does not state this",
    "It happened in May 2026.",
    "The identifier was assigned to",
    "It was (according to the record",
    "Probably, but I am not sure.",
    "The value is not available.",
    "They met in Anna Berg Street, March 22,",
)
CONFIDENCES = ("0", "73", "100%", "Confidence: 80", "I'd say around 85%.", "8/10", "the 85th percentile", "0.85", "101", "-1", "", "Confidence: 80.")


_ESCAPED = "\\'"


def case(column: str, values: tuple[str, ...], quote: str = "''") -> str:
    """A CASE over column % len(values); `quote` is how the dialect writes a quote inside of a string."""
    return f"case {column} % {len(values)} " + " ".join("when {} then '{}'".format(k, v.replace("'", quote)) for k, v in enumerate(values)) + " end"


#: Every blank of Unicode's class Zs: what SQL trims.
_BLANKS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (doc_id, model, question_id, answer, reply, tokens) from documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    t, own = case("doc_id", TEMPLATES, _ESCAPED), f"btrim(replace(text, char(10), ' '), '{_BLANKS}')"
    return docs.selectExpr(
        "doc_id", "concat('m', lpad(cast(doc_id % 6 as string), 2, '0')) as model", "concat('q', lpad(cast(doc_id as string), 8, '0')) as question_id",
        f"case when doc_id % 3 = 0 then {t} when doc_id % 3 = 1 then concat({own}, ' ', {t}) else concat({t}, ' ', {own}) end as answer",
        f"{case('(doc_id div 3)', CONFIDENCES, _ESCAPED)} as reply", "cast(n_chars % 300 as int) as tokens",
    )


PAIRS = [("p0", "m00", "m01"), ("p1", "m02", "m03"), ("p2", "m04", "m05"), ("p3", "m06", "m07"), ("p4", "m08", "m09"), ("p5", "m10", "m11")]


def models(spark: SparkSession) -> DataFrame:
    rows = [(m, p, g) for p, old, new in PAIRS for m, g in ((old, "old"), (new, "new"))]
    return spark.createDataFrame(rows, "model string, pair string, generation string")


def capability(spark: SparkSession) -> DataFrame:
    """A capability probe's counts: 259 trials, successes by rule."""
    return spark.range(12).selectExpr("concat('m', lpad(cast(id as string), 2, '0')) as model", "cast(200 + (id * 17) % 50 as bigint) as successes", "cast(259 as bigint) as trials")
