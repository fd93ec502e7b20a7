"""Queries over the shared tables, one for each operator, and their SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agreement, lineage, neardup, ranking, resample, scoring, sensitivity, stats, validation
from . import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def out(df: DataFrame, *columns, digits: int = 9) -> DataFrame:
    """The columns, doubles rounded and counts as long."""
    df = df.select(*columns) if columns else df
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        cols.append((F.round(c, digits) + F.lit(0.0) if kind == "double" else c.cast("long") if kind in ("int", "smallint") else c).alias(f.name))
    return df.select(*cols)


# --- SQL of the adapters

REC = """
base AS (SELECT event_id % 12 AS model_no, event_id // 12 AS item_no, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS kk FROM events),
grid AS (SELECT *, ['FEQ','PCQ','HNQ','CCQ'][CAST(item_no % 4 AS INTEGER) + 1] AS category, (kk * 7 + item_no) % 20 AS u FROM base),
rec AS (SELECT 'm' || lpad(CAST(model_no AS VARCHAR), 2, '0') AS model, item_no, 'q' || lpad(CAST(item_no AS VARCHAR), 6, '0') AS question_id, category, category || '-S' || CAST((item_no // 4) % 5 AS VARCHAR) AS subcategory,
  CASE WHEN model_no = 11 AND category = 'PCQ' THEN 1 ELSE 0 END AS k, event_type <> 'error' AS answered, event_type = 'signup' AND kk % 10 = 0 AS terminal,
  CASE WHEN event_type = 'error' OR (event_type = 'signup' AND kk % 10 = 0) THEN NULL ELSE kk / 100.0::DOUBLE END AS confidence, least(kk // 10, 9) AS bin,
  CASE WHEN event_type = 'error' THEN NULL WHEN u < 3 + model_no % 5 THEN 'ABSTAIN' WHEN u < 5 + model_no % 7 THEN 'HEDGE' WHEN category IN ('PCQ','HNQ') AND u < 12 + model_no % 4 THEN 'CONFIDENT_CORRECT' ELSE 'CONFIDENT_WRONG' END AS label,
  CASE WHEN event_type = 'error' AND kk % 3 > 0 THEN ['timeout','refused'][CAST(kk % 3 AS INTEGER)] END AS answer_error, CASE WHEN event_type = 'signup' AND kk % 20 = 0 THEN 'no_numeric_token' END AS parse_reason FROM grid),
fact AS (SELECT *, k = 0 AND answered AS ok, k = 0 AND answered AND confidence IS NOT NULL AS has_conf, k = 0 AND answered AND confidence IS NOT NULL AND label LIKE 'CONFIDENT%' AS sub FROM rec)
"""


def scores_sql(keys: str, source: str = "fact", name: str = "sc") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""
{name}_bins AS (SELECT {keys}, bin, abs(sum(CASE WHEN label = 'CONFIDENT_CORRECT' THEN 1.0::DOUBLE ELSE 0 END) - sum(confidence)) AS gap, count(*) AS n FROM {source} WHERE sub GROUP BY {keys}, bin),
{name}_ece AS (SELECT {keys}, sum(gap) / sum(n) AS ece FROM {name}_bins GROUP BY {keys}),
{name}_cnt AS (SELECT {keys}, count(*) AS n_input, sum(ok::INT) AS n, sum(has_conf::INT) AS n_conf, sum(sub::INT) AS n_cal, sum((k = 0 AND answered AND terminal)::INT) AS n_term, sum((k = 0 AND confidence IS NULL AND NOT terminal)::INT) AS n_retry,
  sum((NOT answered)::INT) AS fails, sum((k <> 0)::INT) AS n_k1, sum((ok AND label = 'ABSTAIN')::INT) AS n_a, sum((ok AND label = 'HEDGE')::INT) AS n_h, sum((ok AND label = 'CONFIDENT_CORRECT')::INT) AS n_cc, sum((ok AND label = 'CONFIDENT_WRONG')::INT) AS n_cw FROM {source} GROUP BY {keys}),
{name} AS (SELECT a.*, b.ece, CASE WHEN n > 0 THEN (n_a + n_h) / n END AS restraint_rate, CASE WHEN n > 0 THEN 1 - n_cw / n END AS error_avoidance, 1 - b.ece AS calibration,
  0.30::DOUBLE * CASE WHEN n > 0 THEN (n_a + n_h) / n END + 0.45::DOUBLE * CASE WHEN n > 0 THEN 1 - n_cw / n END + 0.25::DOUBLE * (1 - b.ece) AS composite FROM {name}_cnt a LEFT JOIN {name}_ece b ON {on})
"""


SCORE_COLUMNS = """n_input::BIGINT AS n_input, n::BIGINT AS n_scorable, n_conf::BIGINT AS n_confidence, n_cal::BIGINT AS n_calibration, n_term::BIGINT AS n_terminal_missing, n_retry::BIGINT AS n_retryable, fails::BIGINT AS technical_failures, n_k1::BIGINT AS n_out_of_scope,
 n_a::BIGINT AS n_abstain, n_h::BIGINT AS n_hedge, n_cc::BIGINT AS n_confident_correct, n_cw::BIGINT AS n_confident_wrong, round(ece, 11) AS ece, (n - n_conf)::BIGINT AS n_missing_confidence, round(CASE WHEN n > 0 THEN n_conf / n END, 11) AS confidence_coverage,
 round(restraint_rate, 11) AS restraint_rate, round(error_avoidance, 11) AS error_avoidance, round(calibration, 11) AS calibration, round(composite, 11) AS composite"""


def rank_sql(value: str, by: str = "", order: str = "DESC") -> str:
    part = f"PARTITION BY {by} " if by else ""
    same = f"PARTITION BY {by + ', ' if by else ''}{value}"
    return f"(rank() OVER ({part}ORDER BY {value} {order}) + (count(*) OVER ({same}) - 1) / 2.0::DOUBLE)"


# --- scores


@query(f"WITH {REC}, {scores_sql('model')} SELECT model, {SCORE_COLUMNS}, {rank_sql('composite')} AS rank FROM sc")
def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(ranking.summary_order(scoring.scores(A.records(spark, sf_dir))).drop("place"), digits=11)


@query(f"WITH {REC}, {scores_sql('model, category')} SELECT model, category AS \"group\", {SCORE_COLUMNS} FROM sc")
def q_category_scores(spark, sf_dir):
    return out(scoring.grouped_scores(A.records(spark, sf_dir)).where("level = 'category'").drop("level"), digits=11)


@query(f"WITH {REC}, {scores_sql('model, subcategory')} SELECT model, subcategory AS \"group\", {SCORE_COLUMNS} FROM sc")
def q_subcategory_scores(spark, sf_dir):
    return out(scoring.grouped_scores(A.records(spark, sf_dir)).where("level = 'subcategory'").drop("level"), digits=11)


@query(
    f"""WITH {REC}, m AS (SELECT DISTINCT model FROM fact WHERE sub), b AS (SELECT model, bin, count(*) AS n, avg(confidence) AS c, avg(CASE WHEN label = 'CONFIDENT_CORRECT' THEN 1.0::DOUBLE ELSE 0 END) AS a FROM fact WHERE sub GROUP BY ALL)
SELECT m.model, r.bin::BIGINT AS bin, round(r.bin / 10, 9) AS low, round((r.bin + 1) / 10, 9) AS high, coalesce(b.n, 0)::BIGINT AS count, round(c, 9) AS mean_confidence, round(a, 9) AS accuracy, round(abs(a - c), 9) AS gap
FROM m CROSS JOIN range(10) r(bin) LEFT JOIN b ON b.model = m.model AND b.bin = r.bin"""
)
def q_calibration_bins(spark, sf_dir):
    return out(scoring.calibration_bins(A.records(spark, sf_dir)))


@query(f"WITH {REC} SELECT count(*) AS n_records, sum(answered::INT)::BIGINT AS n_answered, count(confidence) AS n_rated, sum((k = 0 AND confidence IS NULL AND NOT terminal)::INT)::BIGINT AS n_retryable, sum((k = 0 AND answered AND terminal)::INT)::BIGINT AS n_terminal_missing, sum((NOT answered)::INT)::BIGINT AS technical_failures FROM rec")
def q_run_quality(spark, sf_dir):
    return out(scoring.run_quality(A.records(spark, sf_dir)))


@query(
    f"""WITH {REC} SELECT model, {', '.join(f"sum((label = '{x}')::INT)::BIGINT AS n_{x.lower()}, round(sum((label = '{x}')::INT) / count(*), 9) AS share_{x.lower()}" for x in T.LABELS)} FROM fact WHERE ok GROUP BY model"""
)
def q_response_distribution(spark, sf_dir):
    return out(scoring.response_distribution(A.records(spark, sf_dir)))


@query(
    f"""WITH {REC} SELECT model, count(*) AS n_items, sum((answered AND label IS NOT NULL)::INT)::BIGINT AS n_scored, count(confidence) AS n_confidence, sum((confidence IS NOT NULL AND coalesce(label, '') IN ('CONFIDENT_CORRECT', 'CONFIDENT_WRONG'))::INT)::BIGINT AS n_calibration,
sum((NOT answered OR label IS NULL)::INT)::BIGINT AS n_excluded, sum((answered AND label IS NOT NULL AND confidence IS NULL)::INT)::BIGINT AS n_excluded_calibration_only FROM rec GROUP BY model"""
)
def q_coverage(spark, sf_dir):
    return out(scoring.coverage(A.records(spark, sf_dir)))


@query(
    f"""WITH {REC} SELECT model, question_id, category, subcategory, CASE WHEN answered AND label IS NOT NULL THEN 'calibration' ELSE 'restraint, avoidance, calibration' END AS excluded_from,
CASE WHEN NOT answered OR label IS NULL THEN 'technical_failure' WHEN terminal THEN 'terminal_missing_confidence' ELSE 'missing_confidence' END AS reason,
CASE WHEN NOT answered OR label IS NULL THEN coalesce(answer_error, 'invalid_record') ELSE coalesce(parse_reason, 'unparseable_confidence') END AS detail, NULL::VARCHAR AS exclusion_reason_recorded
FROM rec WHERE NOT (answered AND label IS NOT NULL AND confidence IS NOT NULL)"""
)
def q_exclusions(spark, sf_dir):
    return out(scoring.exclusions(A.records(spark, sf_dir)))


@query(
    f"""WITH {REC}, s AS (SELECT model, 'pooled' AS source, * EXCLUDE (model) FROM fact WHERE has_conf UNION ALL SELECT model, CASE WHEN label LIKE 'CONF%' THEN 'substantive' ELSE 'restraint' END, * EXCLUDE (model) FROM fact WHERE has_conf),
b AS (SELECT model, source, bin, count(*) AS n, sum(confidence) AS c, sum((label = 'CONFIDENT_CORRECT')::INT) AS a FROM s GROUP BY ALL),
e AS (SELECT model, source, sum(n)::BIGINT AS n, sum(c) / sum(n) AS mean_confidence, sum(a) / sum(n) AS accuracy, sum(abs(a - c)) / sum(n) AS ece FROM b GROUP BY ALL)
SELECT e.model, source, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy, round(ece, 9) AS ece, round((SELECT ece FROM e x WHERE x.model = e.model AND source = 'pooled') - (SELECT ece FROM e x WHERE x.model = e.model AND source = 'substantive'), 9) AS pooled_minus_substantive FROM e"""
)
def q_calibration_sources(spark, sf_dir):
    return out(scoring.calibration_sources(A.records(spark, sf_dir)))


@query(f"WITH {REC}, {scores_sql('model, category')} SELECT category, round(avg(restraint_rate), 9) AS restraint_rate, round(avg(error_avoidance), 9) AS error_avoidance, round(avg(calibration), 9) AS calibration, round(avg(composite), 9) AS composite, count(composite) AS n_models FROM sc GROUP BY category")
def q_category_means(spark, sf_dir):
    return out(scoring.category_means(A.records(spark, sf_dir)))


@query(f"WITH {REC}, c AS (SELECT category, sum((ok AND label = 'CONFIDENT_CORRECT')::INT) AS n FROM fact GROUP BY category) SELECT category, n::BIGINT AS n, round(n / (SELECT sum(n) FROM c), 9) AS share FROM c")
def q_confident_correct_share(spark, sf_dir):
    return out(scoring.confident_correct(A.records(spark, sf_dir)))


@query(
    f"""WITH {REC}, {scores_sql('model')}, {scores_sql('model, category', name='cat')}, b AS (SELECT model, CASE WHEN count(calibration) = 4 THEN avg(calibration) END AS bc FROM cat GROUP BY model)
SELECT sc.model, round(restraint_rate, 9) AS restraint_rate, round(error_avoidance, 9) AS error_avoidance, round(calibration, 9) AS calibration, round(composite, 9) AS composite, round(bc, 9) AS balanced_calibration, round(0.30::DOUBLE * restraint_rate + 0.45::DOUBLE * error_avoidance + 0.25::DOUBLE * bc, 9) AS balanced_composite FROM sc JOIN b ON b.model = sc.model"""
)
def q_category_balanced(spark, sf_dir):
    return out(scoring.category_balanced(A.records(spark, sf_dir)))


_SCOPES = " UNION ALL ".join(f"SELECT '{s}' AS scenario, * FROM fact WHERE category IN ({', '.join(repr(x) for x in c)})" for s, c in sensitivity.SCOPES.items())


@query(
    f"""WITH {REC}, scoped AS ({_SCOPES}), {scores_sql('scenario, model', 'scoped')}, r AS (SELECT scenario, model, composite, {rank_sql('composite', 'scenario')} AS rank FROM sc WHERE composite IS NOT NULL)
SELECT r.scenario, r.model, round(r.composite, 9) AS composite, r.rank, o.rank AS official_rank, r.rank - o.rank AS shift FROM r JOIN r o ON o.model = r.model AND o.scenario = 'official'"""
)
def q_scope_sensitivity(spark, sf_dir):
    return out(sensitivity.scope_shifts(A.records(spark, sf_dir)))


_WEIGHTS = ", ".join(f"('{n}', {w['restraint']}::DOUBLE, {w['avoidance']}::DOUBLE, {w['calibration']}::DOUBLE)" for n, w in sensitivity.WEIGHT_SETS.items())


@query(
    f"""WITH {REC}, {scores_sql('model')}, o AS (SELECT *, {rank_sql('composite')} AS official_rank FROM sc WHERE composite IS NOT NULL),
x AS (SELECT scenario, model, composite, restraint_rate * a + error_avoidance * b + calibration * c AS alternative, official_rank FROM o CROSS JOIN (VALUES {_WEIGHTS}) w(scenario, a, b, c)), y AS (SELECT *, {rank_sql('alternative', 'scenario')} AS alternative_rank FROM x)
SELECT scenario, model, round(composite, 9) AS composite, round(alternative, 9) AS alternative, official_rank, alternative_rank, alternative_rank - official_rank AS shift FROM y"""
)
def q_weight_sensitivity(spark, sf_dir):
    return out(sensitivity.weight_scores(scoring.scores(A.records(spark, sf_dir))))


@query(
    f"""WITH {REC}, a AS (SELECT model, item_no AS source_id, label IN ('ABSTAIN','HEDGE') AS a FROM fact WHERE ok AND category = 'CCQ'), b AS (SELECT model, item_no + 1 AS source_id, label = 'CONFIDENT_CORRECT' AS b FROM fact WHERE ok AND category = 'HNQ')
SELECT model, count(*) AS n_paired, round(avg(a::INT), 9) AS missing_restraint_rate, round(avg(b::INT), 9) AS restored_correct_rate, round(avg((a AND b)::INT), 9) AS joint_pass_rate, sum((a AND b)::INT)::BIGINT AS both_pass, sum((a AND NOT b)::INT)::BIGINT AS restraint_only, sum((NOT a AND b)::INT)::BIGINT AS restored_only, sum((NOT a AND NOT b)::INT)::BIGINT AS both_fail
FROM a JOIN b USING (model, source_id) GROUP BY model"""
)
def q_matched_selectivity(spark, sf_dir):
    r = A.records(spark, sf_dir).where(scoring.scorable())
    a = r.where("category = 'CCQ'").select("model", F.col("item_no").alias("source_id"), F.col("label").isin("ABSTAIN", "HEDGE").alias("passed"))
    b = r.where("category = 'HNQ'").select("model", (F.col("item_no") + 1).alias("source_id"), (F.col("label") == "CONFIDENT_CORRECT").alias("passed"))
    return out(sensitivity.matched_selectivity(a, b))


# --- selection and ranks


_ITEMS = "i AS (SELECT DISTINCT question_id, category, CASE WHEN item_no % 40 < 4 THEN '' ELSE subcategory END AS subcategory FROM rec), t AS (SELECT *, category || '::' || CASE WHEN subcategory = '' THEN 'UNSPECIFIED' ELSE subcategory END AS st FROM i)"
_PICKED = "h AS (SELECT *, sha256('42' || chr(0) || st || chr(0) || question_id) AS rk, sha256('42' || chr(0) || st) AS tn FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY rk, question_id) AS n FROM h), p AS (SELECT * FROM r ORDER BY n, tn, rk LIMIT 150)"


def selectable(spark, sf_dir):
    """Items, some without a subcategory."""
    items = A.records(spark, sf_dir).select("question_id", "category", F.when(F.col("item_no") % 40 < 4, "").otherwise(F.col("subcategory")).alias("subcategory"))
    return items.distinct()


@query(f"WITH {REC}, {_ITEMS}, {_PICKED} SELECT question_id, category, subcategory FROM p")
def q_roundrobin_sample(spark, sf_dir):
    return out(ranking.select_items(selectable(spark, sf_dir), 150))


_OF_TWO = _PICKED.replace("FROM t)", "FROM t WHERE category IN ('HNQ', 'CCQ'))")


@query(f"WITH {REC}, {_ITEMS}, {_OF_TWO} SELECT question_id, category, subcategory FROM p")
def q_category_sample(spark, sf_dir):
    return out(ranking.select_items(selectable(spark, sf_dir), 150, ["hnq", "CCQ"]))


@query(
    f"""WITH {REC}, {_ITEMS}, {_PICKED} SELECT (SELECT count(*) FROM p) AS n_selected, (SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM p GROUP BY category)) AS categories,
(SELECT string_agg(st || '=' || n, ',' ORDER BY st) FROM (SELECT st, count(*) AS n FROM p GROUP BY st)) AS strata, (SELECT sha256('[' || string_agg('"' || question_id || '"', ',' ORDER BY st, question_id) || ']') FROM p) AS question_ids_sha256"""
)
def q_selection_manifest(spark, sf_dir):
    m = ranking.selection_manifest(ranking.select_items(selectable(spark, sf_dir), 150))
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out(m.select("n_selected", flat("category_counts").alias("categories"), flat("stratum_counts").alias("strata"), "question_ids_sha256"))


@query(
    f"""WITH {REC}, h AS (SELECT *, sha256('42:' || model || ':' || category || ':' || question_id) AS selection_hash FROM fact WHERE ok), p AS (SELECT *, row_number() OVER (PARTITION BY model, category ORDER BY selection_hash) AS n FROM h)
SELECT 'V' || lpad(CAST(row_number() OVER (ORDER BY selection_hash) AS VARCHAR), 4, '0') AS validation_id, model, category, question_id, label FROM p WHERE n <= 10"""
)
def q_validation_packet(spark, sf_dir):
    r = A.records(spark, sf_dir).where(scoring.scorable())
    return out(ranking.validation_packet(r, 10), "validation_id", "model", "category", "question_id", "label")


@query(
    f"""WITH {REC}, t AS (SELECT category AS family, model AS name, round(sum((label = 'ABSTAIN')::INT) / count(*) / 8, 12) AS p FROM fact WHERE ok GROUP BY ALL), s AS (SELECT *, least(1.0::DOUBLE, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS st FROM t)
SELECT family, name, round(p, 9) AS p, round(max(st) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS p_adjusted FROM s"""
)
def q_holm(spark, sf_dir):
    r = A.records(spark, sf_dir).where(scoring.scorable())
    t = r.groupBy(F.col("category").alias("family"), F.col("model").alias("name")).agg(F.round(F.sum(F.when(F.col("label") == "ABSTAIN", 1).otherwise(0)) / F.count("*") / 8, 12).alias("p"))
    return out(ranking.holm(t, ["family"]))


@query(
    f"""WITH {REC}, n AS (SELECT model, confidence, count(*) AS n, min(question_id) AS f FROM fact WHERE has_conf GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY n DESC, f) AS place FROM n) SELECT model, confidence, n, place FROM p WHERE place <= 4"""
)
def q_most_common(spark, sf_dir):
    return out(ranking.most_common(A.records(spark, sf_dir).where(scoring.has_confidence()), ["model"], "confidence", 4, "question_id"))


@query(f"WITH {REC}, {scores_sql('model, category')}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY composite DESC, model) AS place FROM sc WHERE composite IS NOT NULL) SELECT category, model, round(composite, 9) AS composite FROM r WHERE place = 1")
def q_category_leader(spark, sf_dir):
    return out(ranking.leader(scoring.scores(A.records(spark, sf_dir), ["model", "category"]), ["category"], "composite", "model"))


# --- statistics

_CORR = """CASE WHEN count(*) >= 3 AND max({x}) <> min({x}) AND max({y}) <> min({y}) THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"""


def _component_pairs(scores: DataFrame) -> DataFrame:
    names = [("restraint_rate", "error_avoidance"), ("restraint_rate", "calibration"), ("error_avoidance", "calibration")]
    return scores.select("model", F.explode(F.array(*[F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in names])).alias("s")).select("model", "s.*")


_PAIRS = " UNION ALL ".join(f"SELECT model, '{a}~{b}' AS pair, {a} AS x, {b} AS y FROM sc" for a, b in (("restraint_rate", "error_avoidance"), ("restraint_rate", "calibration"), ("error_avoidance", "calibration")))


@query(
    f"""WITH {REC}, {scores_sql('model')}, p AS ({_PAIRS}), r AS (SELECT *, {rank_sql('x', 'pair', 'ASC')} AS rx, {rank_sql('y', 'pair', 'ASC')} AS ry FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT pair, count(*) AS n, round({_CORR.format(x='x', y='y')}, 9) AS pearson, round({_CORR.format(x='rx', y='ry')}, 9) AS spearman, 'ok' AS status FROM r GROUP BY pair"""
)
def q_component_corr(spark, sf_dir):
    return out(stats.correlations(_component_pairs(scoring.scores(A.records(spark, sf_dir))), "x", "y", ["pair"]))


@query(
    f"""WITH {REC}, {scores_sql('model')}, p AS ({_PAIRS}), r AS (SELECT pair, count(*) AS n, {_CORR.format(x='x', y='y')} AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY pair)
SELECT pair, n, round(r, 9) AS r, round(tanh(atanh(r) - {stats.Z95}::DOUBLE / sqrt(n - 3)), 9) AS low, round(tanh(atanh(r) + {stats.Z95}::DOUBLE / sqrt(n - 3)), 9) AS high FROM r"""
)
def q_fisher_ci(spark, sf_dir):
    c = stats.correlations(_component_pairs(scoring.scores(A.records(spark, sf_dir))), "x", "y", ["pair"])
    low, high = stats.fisher_interval(F.col("pearson"), F.col("n"))
    return out(c.select("pair", "n", F.col("pearson").alias("r"), low.alias("low"), high.alias("high")))


_PAIR_VALUES = ", ".join(f"('{p}', '{o}', '{n}')" for p, o, n in A.PAIRS)


@query(f"WITH {REC}, {scores_sql('model')} SELECT pair, round(o.composite, 9) AS old, round(n.composite, 9) AS new, round(n.composite - o.composite, 9) AS difference FROM (VALUES {_PAIR_VALUES}) p(pair, a, b) JOIN sc o ON o.model = a JOIN sc n ON n.model = b")
def q_pairs(spark, sf_dir):
    return out(lineage.generation_pairs(A.models(spark), scoring.scores(A.records(spark, sf_dir))))


@query(
    f"""WITH {REC}, {scores_sql('model')}, d AS (SELECT row_number() OVER (ORDER BY pair) - 1 AS k, o.composite AS o, n.composite AS n, n.composite - o.composite AS d FROM (VALUES {_PAIR_VALUES}) p(pair, a, b) JOIN sc o ON o.model = a JOIN sc n ON n.model = b),
m AS (SELECT mask, abs(sum(CASE WHEN (mask >> k) & 1 = 1 THEN d ELSE -d END)) >= abs((SELECT sum(d) FROM d)) - 1e-12 AS hit FROM d CROSS JOIN range(64) r(mask) GROUP BY mask)
SELECT count(*) AS n_pairs, round(avg(o), 9) AS old_mean, round(avg(n), 9) AS new_mean, round(avg(d), 9) AS mean_difference, round(median(d), 9) AS median_difference, sum((d > 0)::INT)::BIGINT AS n_up, sum((d < 0)::INT)::BIGINT AS n_down, sum((d = 0)::INT)::BIGINT AS n_unchanged, round(stddev_samp(d), 9) AS sd, round(avg(d) / stddev_samp(d), 9) AS cohens_dz, 'ok' AS status,
(SELECT sum(hit::INT)::BIGINT FROM m) AS n_extreme, 64::BIGINT AS n_permutations, round((SELECT sum(hit::INT) / 64 FROM m), 9) AS p_value FROM d"""
)
def q_sign_permutation(spark, sf_dir):
    return out(stats.paired(lineage.generation_pairs(A.models(spark), scoring.scores(A.records(spark, sf_dir)))))


@query(
    f"""WITH {REC}, {scores_sql('model')}, v AS (SELECT row_number() OVER (ORDER BY model) - 1 AS k, composite AS v, (model < 'm04')::INT AS g FROM sc), t AS (SELECT sum(v) AS t, sum(v * g) AS own FROM v),
m AS (SELECT mask, sum(CASE WHEN (mask >> k) & 1 = 1 THEN v ELSE 0 END) AS s FROM v CROSS JOIN range(4096) r(mask) WHERE bit_count(mask) = 4 GROUP BY mask), x AS (SELECT own / 4 - (t - own) / 8 AS d, abs(s / 4 - (t - s) / 8) >= abs(own / 4 - (t - own) / 8) - 1e-12 AS hit FROM m, t)
SELECT round(d, 9) AS difference, sum(hit::INT)::BIGINT AS n_extreme, count(*) AS n_permutations, round(sum(hit::INT) / count(*), 9) AS p_value FROM x GROUP BY d"""
)
def q_group_permutation(spark, sf_dir):
    rows = scoring.scores(A.records(spark, sf_dir)).withColumn("own", F.col("model") < "m04")
    return out(stats.group_permutation(rows, "own", "composite"))


_NATIONS = "v AS (SELECT n_nationkey AS k, n_regionkey = 0 AS own, round((SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey)) AS o, round((SELECT avg(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey)) AS n FROM nation)"


def nations(spark, sf_dir):
    """25 pairs of whole numbers: mean balances of the suppliers and customers of each nation."""
    mean = lambda table, x: A.table(spark, sf_dir, table).groupBy(F.col(f"{x}_nationkey").alias("n_nationkey")).agg(F.round(F.avg(f"{x}_acctbal").cast("double")).alias("old" if x == "s" else "new"))
    every = A.table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") == 0).alias("own"))
    return every.join(mean("supplier", "s"), "n_nationkey", "left").join(mean("customer", "c"), "n_nationkey", "left")


@query(
    f"""WITH {_NATIONS}, d AS (SELECT row_number() OVER (ORDER BY k) - 1 AS k, n - o AS d FROM v WHERE n - o <> 0), m AS (SELECT count(*) AS m, abs(sum(d)) AS t FROM d),
a AS (SELECT mask, sum(CASE WHEN (mask >> k) & 1 = 1 THEN d ELSE -d END) AS s FROM d CROSS JOIN range(4096) r(mask) WHERE k < 12 GROUP BY mask), b AS (SELECT mask, sum(CASE WHEN (mask >> (k - 12)) & 1 = 1 THEN d ELSE -d END) AS s FROM d CROSS JOIN range(8192) r(mask) WHERE k >= 12 AND mask < pow(2, (SELECT m FROM m) - 12) GROUP BY mask)
SELECT (SELECT count(*) FROM v WHERE n IS NOT NULL AND o IS NOT NULL) AS n_pairs, (SELECT count(*) FROM a, b WHERE abs(a.s + b.s) >= (SELECT t FROM m)) AS n_extreme, (SELECT count(*) FROM a, b) AS n_permutations, round((SELECT count(*) FROM a, b WHERE abs(a.s + b.s) >= (SELECT t FROM m)) / (SELECT count(*) FROM a, b), 9) AS p_value"""
)
def q_sign_permutation_many(spark, sf_dir):
    return out(stats.paired(nations(spark, sf_dir)), "n_pairs", "n_extreme", "n_permutations", "p_value")


@query(
    f"""WITH {_NATIONS}, t AS (SELECT sum(n) AS t, sum(n) FILTER (own) AS s FROM v), c AS (SELECT v1.n + v2.n + v3.n + v4.n + v5.n AS s FROM v v1 JOIN v v2 ON v2.k > v1.k JOIN v v3 ON v3.k > v2.k JOIN v v4 ON v4.k > v3.k JOIN v v5 ON v5.k > v4.k),
x AS (SELECT t.s / 5 - (t.t - t.s) / 20 AS d, abs(c.s / 5 - (t.t - c.s) / 20) >= abs(t.s / 5 - (t.t - t.s) / 20) - 1e-9 AS hit FROM c, t)
SELECT round(d, 9) AS difference, sum(hit::INT)::BIGINT AS n_extreme, count(*) AS n_permutations, round(sum(hit::INT) / count(*), 9) AS p_value FROM x GROUP BY d"""
)
def q_group_permutation_many(spark, sf_dir):
    rows = nations(spark, sf_dir).select(F.format_string("n%02d", "n_nationkey").alias("model"), "own", "new")
    return out(stats.group_permutation(rows, "own", "new"))


@query(
    f"""WITH {REC}, {scores_sql('model')}, c AS (SELECT corr(restraint_rate, error_avoidance) AS xy, corr(restraint_rate, calibration) AS xz, corr(error_avoidance, calibration) AS yz FROM sc) SELECT round(xy, 9) AS xy, round(xz, 9) AS xz, round(yz, 9) AS yz, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 9) AS partial FROM c"""
)
def q_partial_corr(spark, sf_dir):
    c = scoring.scores(A.records(spark, sf_dir)).agg(stats.correlation("restraint_rate", "error_avoidance").alias("xy"), stats.correlation("restraint_rate", "calibration").alias("xz"), stats.correlation("error_avoidance", "calibration").alias("yz"))
    return out(c.withColumn("partial", stats.partial_correlation(F.col("xy"), F.col("xz"), F.col("yz"))))


@query(
    f"""WITH {REC}, c AS (SELECT model, sum((label = 'CONFIDENT_CORRECT')::INT) AS s, count(*) AS n FROM fact WHERE ok GROUP BY model), p AS (SELECT sum(s) / sum(n) AS r, sum(n) AS t, count(*) AS m FROM c)
SELECT m AS n_models, round(r, 9) AS pooled_rate, round((SELECT sum(pow(s - n * r, 2) / (n * r) + pow(n - s - n * (1 - r), 2) / (n * (1 - r))) FROM c, p), 9) AS dispersion, round((SELECT stddev_samp(s / n) FROM c), 9) AS observed_sd, round(sqrt(r * (1 - r) / (t / m)), 9) AS sampling_sd, round((SELECT stddev_samp(s / n) FROM c) / sqrt(r * (1 - r) / (t / m)), 9) AS sd_ratio FROM p"""
)
def q_dispersion(spark, sf_dir):
    r = A.records(spark, sf_dir).where(scoring.scorable())
    return out(stats.dispersion(r.groupBy("model").agg(scoring.counted(F.col("label") == "CONFIDENT_CORRECT").alias("successes"), F.count("*").alias("trials"))))


_DRAW = "CAST(('0x' || substr(md5(CAST(rep AS VARCHAR) || ':' || CAST(item_no AS VARCHAR)), 1, 12)) AS BIGINT)"


def _boot(reps: int) -> str:
    return f"""items AS (SELECT DISTINCT item_no FROM rec), draws AS (SELECT rep, {_DRAW} % (SELECT count(*) FROM items) AS item_no FROM items CROSS JOIN range({reps}) r(rep)), times AS (SELECT rep, item_no, count(*) AS t FROM draws GROUP BY ALL),
reps AS (SELECT model, rep, sum(t * (label IN ('ABSTAIN','HEDGE'))::INT) / sum(t) AS restraint_rate, 1 - sum(t * (label = 'CONFIDENT_WRONG')::INT) / sum(t) AS error_avoidance FROM fact JOIN times USING (item_no) WHERE ok GROUP BY ALL)"""


@query(f"WITH {REC}, {_boot(50)} SELECT model, round(avg(restraint_rate), 9) AS mean, round(quantile_cont(restraint_rate, 0.025), 9) AS low, round(quantile_cont(restraint_rate, 0.975), 9) AS high FROM reps GROUP BY model")
def q_hash_bootstrap(spark, sf_dir):
    return out(resample.percentile_interval(resample.hash_bootstrap(A.records(spark, sf_dir), 50), ["model"], "restraint_rate"))


@query(
    f"""WITH {REC}, {_boot(50)}, d AS (SELECT pair, n.restraint_rate - o.restraint_rate AS d FROM (VALUES {_PAIR_VALUES}) p(pair, a, b) JOIN reps o ON o.model = a JOIN reps n ON n.model = b AND n.rep = o.rep)
SELECT pair, round(avg(d), 9) AS mean, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, round(avg((d > 0)::INT), 9) AS share_up FROM d GROUP BY pair"""
)
def q_paired_bootstrap(spark, sf_dir):
    pairs = spark.createDataFrame(A.PAIRS, "pair string, old string, new string")
    return out(resample.paired_difference(resample.hash_bootstrap(A.records(spark, sf_dir), 50), pairs, "restraint_rate"))


@query()
def q_seeded_bootstrap(spark, sf_dir):
    reps = resample.seeded_bootstrap(A.records(spark, sf_dir))
    return out(resample.percentile_interval(reps, ["model"], "composite"))


@query()
def q_perm_corr(spark, sf_dir):
    pairs = _component_pairs(scoring.scores(A.records(spark, sf_dir)))
    return out(resample.correlation_tests(pairs))


@query()
def q_homogeneity(spark, sf_dir):
    return out(resample.homogeneity(A.capability(spark)))


# --- agreement

_CODERS = "c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'CONFIDENT_CORRECT' WHEN doc_id % 3 = 0 THEN 'HEDGE' ELSE 'CONFIDENT_WRONG' END AS a, CASE WHEN toxic = 1 THEN 'CONFIDENT_WRONG' WHEN doc_id % 11 = 0 THEN 'ABSTAIN' WHEN quality = 1 THEN 'CONFIDENT_CORRECT' ELSE 'HEDGE' END AS b FROM labels)"


def coders(spark, sf_dir):
    rows = A.table(spark, sf_dir, "labels")
    a = F.when(F.col("quality") == 1, "CONFIDENT_CORRECT").when(F.col("doc_id") % 3 == 0, "HEDGE").otherwise("CONFIDENT_WRONG")
    b = F.when(F.col("toxic") == 1, "CONFIDENT_WRONG").when(F.col("doc_id") % 11 == 0, "ABSTAIN").when(F.col("quality") == 1, "CONFIDENT_CORRECT").otherwise("HEDGE")
    return agreement.joined(rows.select("doc_id", a.alias("label")), rows.select("doc_id", b.alias("label")), "doc_id", ("a", "b"))


@query(
    f"""WITH {_CODERS}, t AS (SELECT count(*) AS n, sum((a = b)::INT) AS s FROM c), x AS (SELECT sum(p.n * q.n) AS pr FROM (SELECT a AS v, count(*) AS n FROM c GROUP BY a) p JOIN (SELECT b AS v, count(*) AS n FROM c GROUP BY b) q USING (v))
SELECT n, round(s / n, 9) AS observed, round(pr / (n * n), 9) AS expected, round((s / n - pr / (n * n)) / (1 - pr / (n * n)), 9) AS kappa FROM t, x"""
)
def q_kappa(spark, sf_dir):
    return out(agreement.kappa(coders(spark, sf_dir), "a", "b"))


_GRID = f"g AS (SELECT r.x AS reference, p.x AS predicted FROM (VALUES {', '.join(f'({x!r})' for x in T.LABELS)}) r(x) CROSS JOIN (VALUES {', '.join(f'({x!r})' for x in T.LABELS)}) p(x)), cm AS (SELECT reference, predicted, (SELECT count(*) FROM c WHERE a = reference AND b = predicted) AS n FROM g)"


@query(f"WITH {_CODERS}, {_GRID} SELECT reference, predicted, n FROM cm")
def q_confusion(spark, sf_dir):
    return out(agreement.confusion(coders(spark, sf_dir), "a", "b"))


_F1 = """k AS (SELECT l.reference AS label, (SELECT sum(n) FROM cm x WHERE x.reference = l.reference) AS support, (SELECT sum(n) FROM cm x WHERE x.predicted = l.reference) AS called, (SELECT sum(n) FROM cm x WHERE x.reference = l.reference AND x.predicted = l.reference) AS hits FROM (SELECT DISTINCT reference FROM cm) l),
pr AS (SELECT label, support, CASE WHEN called > 0 THEN hits / called END AS p, CASE WHEN support > 0 THEN hits / support END AS r FROM k), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END AS f1 FROM pr)"""


@query(f"WITH {_CODERS}, {_GRID}, {_F1} SELECT label, support::BIGINT AS support, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM f")
def q_f1(spark, sf_dir):
    return out(agreement.class_scores(agreement.confusion(coders(spark, sf_dir), "a", "b")))


@query(f"WITH {_CODERS}, {_GRID}, {_F1} SELECT sum(support)::BIGINT AS n, round(avg(f1), 9) AS macro_f1, round(sum(coalesce(support * f1, 0)) / sum(support), 9) AS weighted_f1 FROM f")
def q_f1_overall(spark, sf_dir):
    return out(agreement.overall(agreement.class_scores(agreement.confusion(coders(spark, sf_dir), "a", "b"))))


_IMPACT = f"""{_CODERS}, i AS (SELECT 'm' || CAST(doc_id % 8 AS VARCHAR) AS model, avg((a IN ('ABSTAIN','HEDGE'))::INT) AS restraint_auto, avg((b IN ('ABSTAIN','HEDGE'))::INT) AS restraint_human, 1 - avg((a = 'CONFIDENT_WRONG')::INT) AS avoidance_auto, 1 - avg((b = 'CONFIDENT_WRONG')::INT) AS avoidance_human FROM c GROUP BY 1)"""


@query(f"WITH {_IMPACT} SELECT model, round(restraint_auto, 9) AS restraint_auto, round(restraint_human, 9) AS restraint_human, round(avoidance_auto, 9) AS avoidance_auto, round(avoidance_human, 9) AS avoidance_human, round(restraint_auto - restraint_human, 9) AS restraint_bias, round(avoidance_auto - avoidance_human, 9) AS avoidance_bias FROM i")
def q_score_impact(spark, sf_dir):
    rows = coders(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 8).cast("string")))
    return out(agreement.score_impact(rows, "a", "b"))


@query(
    f"""WITH {_IMPACT} SELECT round(avg(abs(restraint_auto - restraint_human)), 9) AS restraint_mae, round(max(abs(restraint_auto - restraint_human)), 9) AS restraint_max, round(corr(restraint_auto, restraint_human), 9) AS restraint_r, round(avg(abs(avoidance_auto - avoidance_human)), 9) AS avoidance_mae, round(max(abs(avoidance_auto - avoidance_human)), 9) AS avoidance_max, round(corr(avoidance_auto, avoidance_human), 9) AS avoidance_r FROM i"""
)
def q_impact_summary(spark, sf_dir):
    rows = coders(spark, sf_dir).withColumn("model", F.concat(F.lit("m"), (F.col("doc_id") % 8).cast("string")))
    return out(agreement.impact_summary(agreement.score_impact(rows, "a", "b")))
