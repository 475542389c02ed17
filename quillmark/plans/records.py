"""Queries on model answers: repair, normalisation, fusion, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.records import band, dependency, fused, placeholder, repaired, route, title, truth
from .registry import CORPUS, LOG, query

_NOT_NULL = "reasoning IS NOT NULL"


@query()
def json_repair(t):
    """What can be parsed of each answer, and by which step; regular expressions with lookaround and brace counting have no portable SQL."""
    fields, how = repaired(F.col("reasoning"))
    df = t.inference_results.where(_NOT_NULL).select("result_id", fields.alias("f"), how.alias("how"))
    return df.select("result_id", "how", truth(F.col("f.humorous")).alias("humorous"), F.coalesce("f.reason", "f.reasoning").alias("reason"))


@query("""WITH x AS (SELECT result_id, reasoning, CASE WHEN json_valid(reasoning) THEN reasoning END AS j FROM inference_results WHERE reasoning IS NOT NULL)
SELECT result_id, CASE WHEN json_type(j) = 'OBJECT' THEN 'object' WHEN trim(reasoning, ' ') = '' THEN 'blank' ELSE 'text' END AS kind, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.reason') END AS reason FROM x""")
def answer_kind(t):
    v = F.try_parse_json("reasoning")
    kind = F.when(F.schema_of_variant(v).startswith("OBJECT"), "object").when(F.trim("reasoning") == "", "blank").otherwise("text")
    df = t.inference_results.where(_NOT_NULL).withColumn("kind", F.coalesce(kind, F.lit("text")))
    return df.select("result_id", "kind", F.when(F.col("kind") == "object", F.try_variant_get(v, "$.reason", "string")).alias("reason"))


_DEP = "CASE WHEN cultural_dependency IS NULL THEN 'Not analyzed' WHEN lower(cultural_dependency) LIKE '%high%' THEN 'High' WHEN lower(cultural_dependency) LIKE '%med%' THEN 'Medium' WHEN lower(cultural_dependency) LIKE '%low%' OR lower(cultural_dependency) LIKE '%none%' THEN 'Low' ELSE upper(substr(trim(cultural_dependency), 1, 1)) || lower(substr(trim(cultural_dependency), 2)) END"


@query(f"""SELECT result_id, CASE WHEN cultural_category IS NULL OR lower(trim(cultural_category)) IN ('', 'none', 'null') THEN 'Not identified' ELSE upper(substr(trim(cultural_category), 1, 1)) || lower(substr(trim(cultural_category), 2)) END AS category,
replace({_DEP}, 'Not analyzed', 'Not Analyzed') AS dependency FROM inference_results""")
def normalize_record(t):
    dep = F.replace(dependency(F.col("cultural_dependency")), F.lit("Not analyzed"), F.lit("Not Analyzed"))
    category = F.when(F.col("cultural_category").isNull() | F.lower(F.trim("cultural_category")).isin("", "none", "null"), "Not identified").otherwise(title(F.col("cultural_category")))
    return t.inference_results.select("result_id", category.alias("category"), dep.alias("dependency"))


@query(f"""WITH {LOG} SELECT result_id, CASE WHEN NOT late AND p IS NOT NULL AND q IS NOT NULL THEN p >= 0.5 WHEN NOT late THEN prediction = 1 END AS humorous, CASE WHEN NOT late AND p IS NOT NULL AND q IS NOT NULL THEN round(greatest(p, 1 - p), 6) END AS confidence,
CASE WHEN NOT late AND p IS NOT NULL AND q IS NOT NULL THEN 'probability' WHEN NOT late AND prediction IS NOT NULL THEN 'text' ELSE 'unavailable' END AS method FROM log""")
def decision_fusion(t):
    h, c, m = fused(F.col("p"), F.col("q"), F.col("prediction") == 1, F.col("late"))
    return t.log().select("result_id", h.alias("humorous"), c.alias("confidence"), m.alias("method"))


@query(f"""WITH {LOG} SELECT result_id, CASE WHEN late OR (json_error IS NOT NULL AND NOT coalesce(stage2_fallback_to_stage1, false)) THEN NULL ELSE prediction END AS safe FROM log""")
def safe_prediction(t):
    bad = F.col("late") | (F.col("json_error").isNotNull() & ~F.coalesce("stage2_fallback_to_stage1", F.lit(False)))
    return t.log("stage2_fallback_to_stage1").select("result_id", F.when(~bad, F.col("prediction")).alias("safe"))


@query(f"""WITH {LOG}, x AS (SELECT result_id, p >= 0.5 AS h, coalesce(lower(cultural_category), 'none') <> 'none' AS cat, coalesce(trim(retrieved_context) <> '', false) AS ctx, coalesce(stage2_failed, false) AS failed FROM log)
SELECT result_id, CASE WHEN NOT coalesce(h, false) AND NOT (cat AND ctx) THEN 'short_circuit_nonhumor' WHEN NOT ctx THEN 'reuse_stage1' WHEN failed THEN 'stage2_fallback' ELSE 'stage2' END AS route FROM x""")
def two_stage_route(t):
    log = t.log("cultural_category", "retrieved_context", "stage2_failed")
    has = F.coalesce(F.lower("cultural_category"), F.lit("none")) != "none"
    return log.select("result_id", route(F.col("p") >= 0.5, has, F.col("retrieved_context"), F.col("stage2_failed")).alias("route"))


@query(f"""WITH {LOG}, a AS (SELECT evaluation_id, sample_index, p, q FROM log WHERE run_condition = 'general')
SELECT b.result_id, round(greatest(coalesce(nullif(a.p, 0), 0.5), coalesce(nullif(a.q, 0), 0.5)), 6) AS confidence, a.p IS NOT NULL AS reused FROM log b LEFT JOIN a ON a.evaluation_id = b.evaluation_id AND a.sample_index = b.sample_index WHERE b.run_condition = 'cultural'""")
def stage1_reuse(t):
    """Confidence that the second run takes over from the first run of its sample; one pass, no join."""
    log = t.log()
    g = log.groupBy("evaluation_id", "sample_index").agg(F.max(F.when(F.col("run_condition") == "general", F.struct("result_id", "p", "q"))).alias("a"), F.max(F.when(F.col("run_condition") == "cultural", F.col("result_id"))).alias("result_id"))
    c = F.greatest(F.coalesce(F.nullif(F.col("a.p"), F.lit(0.0)), F.lit(0.5)), F.coalesce(F.nullif(F.col("a.q"), F.lit(0.0)), F.lit(0.5)))
    return g.where("result_id is not null").select("result_id", F.round(c, 6).alias("confidence"), F.col("a.p").isNotNull().alias("reused"))


@query(f"WITH {LOG} SELECT result_id, CASE WHEN greatest(p, 1 - p) >= 0.8 THEN 'High' WHEN greatest(p, 1 - p) >= 0.5 THEN 'Moderate' WHEN p IS NOT NULL THEN 'Low' END AS band FROM log")
def confidence_band(t):
    return t.log().select("result_id", F.when(F.col("p").isNotNull(), band(F.greatest("p", 1 - F.col("p")))).alias("band"))


@query("SELECT result_id, round(inference_duration_s * 0.3, 6) AS prefill_s, round(greatest(0, inference_duration_s * 0.7), 6) AS decode_s, coalesce(generated_token_count >= 256, false) AS at_limit, round(inference_duration_s / nullif(generated_token_count, 0), 6) AS s_per_token FROM inference_results WHERE inference_duration_s IS NOT NULL")
def timing_split(t):
    s = F.col("inference_duration_s")
    return t.inference_results.where("inference_duration_s is not null").select("result_id", F.round(s * 0.3, 6).alias("prefill_s"), F.round(F.greatest(F.lit(0.0), s * 0.7), 6).alias("decode_s"), F.coalesce(F.col("generated_token_count") >= 256, F.lit(False)).alias("at_limit"), F.round(F.try_divide(s, F.col("generated_token_count")), 6).alias("s_per_token"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS l FROM embeddings), e AS (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS x FROM v)
SELECT vec_id, round((x[1] + x[2]) / (x[1] + x[2] + x[3] + x[4]), 6) AS p_true FROM e""")
def softmax_pool(t):
    """Softmax over logits, pooled over the tokens of two answers and renormalised."""
    logits = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    v = t.embeddings.select("vec_id", logits.alias("l")).withColumn("m", F.array_max("l"))
    v = v.withColumn("x", F.transform("l", lambda x: F.exp(x - F.col("m"))))
    yes, no = F.col("x")[0] + F.col("x")[1], F.col("x")[2] + F.col("x")[3]
    return v.select("vec_id", F.round(yes / (yes + no), 6).alias("p_true"))


@query("SELECT vec_id, len(list_concat(embedding, embedding[1:4]))::INTEGER AS width, round(list_concat(embedding, embedding[1:4])[66]::DOUBLE, 6) AS probe FROM embeddings")
def feature_concat(t):
    both = F.concat("embedding", F.slice("embedding", 1, 4))
    return t.embeddings.select("vec_id", F.size(both).alias("width"), F.round(both[65].cast("double"), 6).alias("probe"))


@query("SELECT result_id, CASE WHEN retrieved_context IS NULL OR lower(trim(retrieved_context)) IN ('', 'none', 'null') THEN 'No context' ELSE trim(retrieved_context) END AS context FROM inference_results")
def placeholder_context(t):
    return t.inference_results.select("result_id", placeholder(F.col("retrieved_context"), "No context").alias("context"))


@query(f"""WITH {LOG} SELECT evaluation_id, sample_index, run_condition, CASE WHEN NOT valid THEN 'failed' WHEN prediction = 1 THEN 'Humorous' ELSE 'Not Humorous' END AS verdict, round(p, 4) AS p, coalesce(nullif(trim(cultural_category), ''), 'none') AS category, late FROM log""")
def evaluation_record(t):
    """What an evaluation keeps of a run: verdict, probability, category; a failed run has no class."""
    verdict = F.when(~F.col("valid"), "failed").when(F.col("prediction") == 1, "Humorous").otherwise("Not Humorous")
    category = F.coalesce(F.nullif(F.trim("cultural_category"), F.lit("")), F.lit("none"))
    return t.log("cultural_category").select("evaluation_id", "sample_index", "run_condition", verdict.alias("verdict"), F.round("p", 4).alias("p"), category.alias("category"), "late")


@query("""SELECT result_id, NULL::BOOLEAN AS humorous, NULL::VARCHAR AS reason, json_error AS error, reasoning AS raw FROM inference_results WHERE json_error IS NOT NULL""")
def error_record(t):
    """The record of a run whose answer cannot be read: nothing but the message and the raw answer."""
    return t.inference_results.where("json_error is not null").select("result_id", F.lit(None).cast("boolean").alias("humorous"), F.lit(None).cast("string").alias("reason"), F.col("json_error").alias("error"), F.col("reasoning").alias("raw"))


@query("""SELECT result_id, evaluation_id || '_' || strftime(logged_at, '%Y%m%d_%H%M%S') || '_' || substr(md5(result_id::VARCHAR), 1, 8) AS run_id FROM inference_results WHERE evaluation_id IS NOT NULL AND logged_at IS NOT NULL""")
def run_ids(t):
    """Names of runs: experiment, time and eight hexadecimal digits, here of the row's own id so that they can be made again."""
    r = t.inference_results.where("evaluation_id is not null and logged_at is not null")
    return r.select("result_id", F.concat_ws("_", "evaluation_id", F.date_format("logged_at", "yyyyMMdd_HHmmss"), F.substring(F.md5(F.col("result_id").cast("string")), 1, 8)).alias("run_id"))


@query("""SELECT sample_index, original_labels.humour AS humour, original_labels.sarcastic AS sarcastic, original_labels.offensive AS offensive, deduplication_status.verified AS verified, deduplication_status.quarantine_overlap AS quarantine_overlap FROM sample_manifest""")
def flat_records(t):
    """Nested records as flat rows."""
    return t.sample_manifest.select("sample_index", "original_labels.humour", "original_labels.sarcastic", "original_labels.offensive", "deduplication_status.verified", "deduplication_status.quarantine_overlap")


@query(f"WITH {CORPUS} SELECT row_id, coalesce(nullif(trim(image_filename), ''), 'blank.jpg') AS image, coalesce(ocr, '') AS text, is_humorous AS label FROM corpus WHERE is_humorous IS NOT NULL")
def training_rows(t):
    """Rows of a training set: a blank image and an empty text in place of missing ones."""
    c = t.corpus("image_filename", "ocr", "is_humorous").dropna(subset=["is_humorous"])
    return c.select("row_id", F.coalesce(F.nullif(F.trim("image_filename"), F.lit("")), F.lit("blank.jpg")).alias("image"), F.coalesce("ocr", F.lit("")).alias("text"), F.col("is_humorous").alias("label"))
