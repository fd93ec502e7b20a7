"""Runs: union of compatible ones, resuming, regeneration checks and file catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Records of runs with equal columns, tagged by run; a model in two runs is an error."""
    out = None
    for name, df in runs.items():
        tagged = df.withColumn("source_run", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    n = out.groupBy("model").agg(F.countDistinct("source_run").alias("_runs"))
    checked = out.join(F.broadcast(n), "model")
    return checked.withColumn("source_run", F.when(F.col("_runs") == 1, F.col("source_run")).otherwise(F.raise_error(F.concat(F.lit("in two runs: "), F.col("model"))).cast("string"))).drop("_runs")


# What must be equal in the manifests of runs whose records are put together.
SIGNATURE = {
    "framework_version": "framework_version", "protocol_version": "protocol_version", "framework_source_sha256": "run.framework_source_sha256", "dataset_sha256": "dataset.sha256", "config_sha256": "config.sha256",
    "selection_question_ids_sha256": "run.selection.question_ids_sha256", "n_selected": "run.selection.n_selected", "answer_prompt_version": "run.answer_prompt_version", "confidence_prompt_version": "run.confidence_prompt_version", "dataset_policy": "run.dataset_policy",
}


def signatures(manifests: DataFrame) -> DataFrame:
    """(source_run, field, value) of manifests (source_run, manifest: a JSON text); the configuration counts by its snapshot's hash."""
    from ..sources.readers import canonical_sha256

    at = lambda path: F.get_json_object("manifest", "$." + path)
    fields = {f: at(p) for f, p in SIGNATURE.items()} | {"config_snapshot_sha256": canonical_sha256(at("config.snapshot"))}
    return manifests.select("source_run", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.nullif(v, F.lit("")).alias("value")) for f, v in fields.items()])).alias("s")).select("source_run", "s.*")


def run_issues(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """(code, source_run, detail): why runs can't be put together. records: source_run, model, question_id, answered, rated.

    Their manifests must have equal signatures, name the models that their records have and select the questions that
    each model answered, once each and wholly scored; no model may be in two runs. Manifests are few rows.
    """
    sig = signatures(manifests)
    other = sig.groupBy("field").agg(F.count_distinct(F.coalesce("value", F.lit("\0"))).alias("n"))
    issue = lambda df, code, detail, run="source_run": df.select(F.lit(code).alias("code"), F.col(run).alias("source_run") if run else F.lit(None).cast("string").alias("source_run"), detail.alias("detail"))
    listed = manifests.select("source_run", F.explode(F.from_json(F.get_json_object("manifest", "$.models"), "array<struct<name: string>>")).alias("m")).select("source_run", F.col("m.name").alias("model"), F.lit(True).alias("listed"))
    by = records.groupBy("source_run", "model").agg(
        F.count("*").alias("n"), F.count_distinct("question_id").alias("different"), F.sum(F.when(F.coalesce(F.col("answered") & F.col("rated"), F.lit(False)), 0).otherwise(1)).alias("unscored")
    )
    both = by.join(listed, ["source_run", "model"], "full_outer")
    ids = manifests.select("source_run", F.explode(F.from_json(F.get_json_object("manifest", "$.run.selection.question_ids"), "array<string>")).alias("question_id"))
    selected = ids.groupBy("source_run").agg(F.count("*").alias("selected"), F.count_distinct("question_id").alias("distinct_ids"))
    hits = records.join(ids.distinct(), ["source_run", "question_id"], "left_semi").groupBy("source_run", "model").agg(F.count_distinct("question_id").alias("hits"))
    cover = by.join(selected, "source_run", "left").join(hits, ["source_run", "model"], "left")
    partial = (F.col("n") != F.col("distinct_ids")) | (F.col("different") != F.col("n")) | (F.coalesce("hits", F.lit(0)) != F.col("distinct_ids"))
    out = issue(sig.where("value is null"), "signature_field_missing", F.col("field"))
    for part in (
        issue(other.where("n > 1"), "signature_differs", F.col("field"), None),
        issue(both.where("listed is null"), "model_not_in_manifest", F.col("model")),
        issue(both.where("n is null"), "model_without_records", F.col("model")),
        issue(by.groupBy("model").agg(F.count("*").alias("runs")).where("runs > 1"), "model_in_several_runs", F.col("model"), None),
        issue(selected.where("selected <> distinct_ids"), "selection_repeats_questions", F.col("selected").cast("string")),
        issue(cover.where(F.coalesce(partial, F.lit(True))), "not_one_record_for_each_question", F.col("model")),
        issue(by.where("unscored > 0"), "incomplete_coverage", F.col("model")),
    ):
        out = out.unionByName(part)
    return out


def aggregated(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Records of compatible runs; with any issue it is an error that names the codes."""
    bad = run_issues(records, manifests).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("_codes"))
    checked = records.crossJoin(F.broadcast(bad))  # one row
    return checked.where(F.when(F.col("_codes") == "", True).otherwise(F.raise_error(F.concat(F.lit("runs can't be put together: "), F.col("_codes"))).cast("boolean"))).drop("_codes")


def evaluation_grid(items: DataFrame, models: DataFrame, k) -> DataFrame:
    """Items for each model that are in scope for it."""
    return items.crossJoin(F.broadcast(models)).withColumn("k", k).where("k = 0")


def pending(selected: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("model", "question_id")) -> DataFrame:
    return selected.join(done.select(*keys).distinct(), list(keys), "left_anti")


def resumable(done: DataFrame, selected: DataFrame, keys: tuple[str, ...] = ("model", "question_id")) -> DataFrame:
    """Checkpointed rows that are still selected, the first of each key."""
    return done.join(selected.select(*keys).distinct(), list(keys), "left_semi").dropDuplicates(list(keys))


def regenerated(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Values before and after, and whether they changed (null equals null)."""
    x = old.select(key, *[F.col(v).alias(f"{v}_before") for v in values]).join(new.select(key, *[F.col(v).alias(f"{v}_after") for v in values]), key, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after"))
    return x.withColumn("changed", ~same)


def id_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids that only one side has, and that both have."""
    x = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full_outer")
    return x.select(key, F.when(F.col("_b").isNull(), "only_first").when(F.col("_a").isNull(), "only_second").otherwise("both").alias("side"))


def catalog_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Files (path, bytes, sha256) that are missing, differ or weren't expected."""
    x = expected.select("path", F.col("sha256").alias("e")).join(actual.select("path", F.col("sha256").alias("a")), "path", "full_outer")
    return x.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "mismatched").otherwise("valid").alias("state"))


def generation_pairs(models: DataFrame, scores: DataFrame, value: str = "composite") -> DataFrame:
    """(pair, old, new, difference) of model generations, both with a defined score."""
    s = models.join(scores.select("model", value), "model").where(F.col("pair").isNotNull())
    wide = s.groupBy("pair").pivot("generation", ["old", "new"]).agg(F.first(value))
    return wide.where("old is not null and new is not null").withColumn("difference", F.col("new") - F.col("old"))


def usable(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """Scores of models that aren't excluded; an exclusion of an unknown model or without a reason is an error."""
    bad = excluded.join(scores.select("model"), "model", "left_anti").unionByName(excluded.where("trim(coalesce(reason, '')) = ''")).select("model")
    checked = scores.join(excluded.select("model"), "model", "left_anti")
    flagged = checked.crossJoin(F.broadcast(bad.agg(F.count("*").alias("_bad"))))
    return flagged.where(F.when(F.col("_bad") == 0, True).otherwise(F.raise_error(F.lit("unknown or unreasoned exclusion")).cast("boolean"))).drop("_bad")
