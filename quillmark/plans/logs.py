"""Queries on the append-only log: completeness, resuming, progress, configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.log import planned, remaining
from .registry import LOG, query

CONDITIONS = ["general", "cultural"]
_COMPLETE = "evaluation_id IS NOT NULL AND sample_index IS NOT NULL AND run_condition IS NOT NULL AND trim(run_condition) <> ''"


@query(f"SELECT DISTINCT evaluation_id, sample_index, run_condition FROM inference_results WHERE {_COMPLETE}")
def complete_records(t):
    return t.inference_results.where(_COMPLETE).select("evaluation_id", "sample_index", "run_condition").distinct()


@query(f"WITH {LOG} SELECT result_id, valid FROM log", name="valid_mask")
def valid_mask_of(t):
    return t.log().select("result_id", "valid")


@query(f"WITH {LOG} SELECT DISTINCT meme_id FROM log WHERE valid AND meme_id IS NOT NULL")
def valid_ids(t):
    return t.log("meme_id").where("valid and meme_id is not null").select("meme_id").distinct()


@query(f"WITH {LOG} SELECT evaluation_id, sample_index, run_condition, result_id, attempt FROM log", name="last_wins")
def last_wins_rows(t):
    return t.log().select("evaluation_id", "sample_index", "run_condition", "result_id", "attempt")


_SAMPLES = "(SELECT DISTINCT replace(manifest_id, 'man', 'eval') AS evaluation_id, sample_index FROM sample_manifest WHERE sample_index IS NOT NULL AND manifest_id IS NOT NULL)"


def _samples(t):
    return t.sample_manifest.dropna(subset=["sample_index", "manifest_id"]).select(F.replace("manifest_id", F.lit("man"), F.lit("eval")).alias("evaluation_id"), "sample_index").distinct()


@query(f"""WITH {LOG}, plan AS (SELECT evaluation_id, sample_index, unnest(['general', 'cultural']) AS run_condition FROM {_SAMPLES})
SELECT p.evaluation_id, p.sample_index, p.run_condition, CASE WHEN p.run_condition = 'general' THEN 0 ELSE 1 END::INTEGER AS turn FROM plan p ANTI JOIN log l ON p.evaluation_id = l.evaluation_id AND p.sample_index = l.sample_index AND p.run_condition = l.run_condition AND l.valid""")
def resume_plan(t):
    """Planned runs that no valid row covers."""
    todo = remaining(planned(_samples(t), CONDITIONS), t.log().where("valid"), ["evaluation_id", "sample_index", "run_condition"])
    return todo.select("evaluation_id", "sample_index", "run_condition", F.when(F.col("run_condition") == "general", 0).otherwise(1).alias("turn"))


TARGETED = (1003, 1001, 1010, 1042, 1017, 1000)


@query(f"""WITH {LOG}, want AS (SELECT ord::INTEGER AS ord, idx FROM (VALUES {', '.join(f'({i}, {x})' for i, x in enumerate(TARGETED))}) v(ord, idx))
SELECT ord, idx AS sample_index, e.evaluation_id FROM want JOIN {_SAMPLES} e ON e.sample_index = want.idx ANTI JOIN (SELECT * FROM log WHERE valid AND run_condition = 'cultural_c') l ON l.evaluation_id = e.evaluation_id AND l.sample_index = e.sample_index""")
def targeted_rerun(t):
    """A fixed list of samples in its order, without those done."""
    want = t.spark.createDataFrame([(i, x) for i, x in enumerate(TARGETED)], "ord int, sample_index int")
    todo = F.broadcast(want).join(_samples(t), "sample_index")
    return remaining(todo, t.log().where("valid and run_condition = 'cultural_c'"), ["evaluation_id", "sample_index"]).select("ord", "sample_index", "evaluation_id")


@query(f"""WITH {LOG}, plan AS (SELECT evaluation_id, count(*) * 2 AS total FROM {_SAMPLES} GROUP BY 1),
done AS (SELECT evaluation_id, count(*) AS completed, count(*) FILTER (valid) AS n_valid, count(*) FILTER (run_condition = 'general') AS general, count(*) FILTER (run_condition = 'cultural') AS cultural, count(*) FILTER (late) AS timeouts, count(*) FILTER (json_error IS NOT NULL) AS json_failures FROM log WHERE run_condition IN ('general', 'cultural') GROUP BY 1)
SELECT plan.evaluation_id, total, coalesce(completed, 0) AS completed, coalesce(n_valid, 0) AS n_valid, coalesce(general, 0) AS general, coalesce(cultural, 0) AS cultural, coalesce(timeouts, 0) AS timeouts, coalesce(json_failures, 0) AS json_failures FROM plan LEFT JOIN done USING (evaluation_id)""")
def progress_status(t):
    plan = _samples(t).groupBy("evaluation_id").agg((F.count("*") * 2).alias("total"))
    c = F.col("run_condition")
    done = t.log().where(c.isin(*CONDITIONS)).groupBy("evaluation_id").agg(F.count("*").alias("completed"), F.count_if("valid").alias("n_valid"), F.count_if(c == "general").alias("general"), F.count_if(c == "cultural").alias("cultural"), F.count_if("late").alias("timeouts"), F.count_if(F.col("json_error").isNotNull()).alias("json_failures"))
    names = ["completed", "n_valid", "general", "cultural", "timeouts", "json_failures"]
    return plan.join(done, "evaluation_id", "left").na.fill(0, names).select("evaluation_id", "total", *names)


EXPECTED = {"model": "m3f19a2c", "cultural": "k8812d0f"}


@query(f"""WITH h AS (SELECT evaluation_id, unnest([{{'name': 'model', 'hash': model_config_hash}}, {{'name': 'cultural', 'hash': cultural_config_hash}}]) AS x FROM inference_results),
e AS (SELECT * FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in EXPECTED.items())}) v(name, expected))
SELECT evaluation_id, e.name AS config_name, x.hash AS stored, expected, count(*) AS n FROM h JOIN e ON e.name = x.name WHERE x.hash IS NOT NULL AND x.hash <> expected AND evaluation_id IS NOT NULL GROUP BY ALL""")
def config_mismatch(t):
    """Stored configuration hashes that differ from the expected ones."""
    stored = F.create_map(F.lit("model"), F.col("model_config_hash"), F.lit("cultural"), F.col("cultural_config_hash"))
    h = t.inference_results.where("evaluation_id is not null").groupBy("evaluation_id", "model_config_hash", "cultural_config_hash").agg(F.count("*").alias("c"))
    h = h.select("evaluation_id", "c", F.explode(stored).alias("config_name", "stored")).where("stored is not null")
    expected = F.element_at(F.create_map(*[F.lit(x) for kv in EXPECTED.items() for x in kv]), F.col("config_name"))
    return h.withColumn("expected", expected).where("stored <> expected").groupBy("evaluation_id", "config_name", "stored", "expected").agg(F.sum("c").alias("n"))


@query("""WITH b AS (SELECT meme_id, any_value(ground_truth) AS g FROM benchmark_memes GROUP BY 1)
SELECT result_id, coalesce(b.g, 1)::INTEGER AS gold, b.g IS NOT NULL AS known FROM inference_results r LEFT JOIN b ON b.meme_id = r.meme_id""")
def gold_lookup(t):
    """Gold label of the benchmark meme of each row, with a default."""
    gold = t.benchmark_memes.groupBy("meme_id").agg(F.max("ground_truth").alias("g"))
    return t.inference_results.select("result_id", "meme_id").join(gold, "meme_id", "left").select("result_id", F.coalesce("g", F.lit(1)).alias("gold"), F.col("g").isNotNull().alias("known"))


@query("""WITH s AS (SELECT sample_index, image_filename, row_number() OVER (PARTITION BY image_filename ORDER BY sample_index) AS rn FROM sample_manifest WHERE image_filename IS NOT NULL AND sample_index IS NOT NULL)
SELECT b.sample_index AS ordinal, s.sample_index, s.image_filename FROM benchmark_memes b JOIN s ON s.image_filename = replace(b.image_filename, 'bench_0', 'train_10') AND s.rn = 1""")
def restore_order(t):
    """For each key of an ordered list the first matching sample; keys without one are dropped."""
    want = t.benchmark_memes.select(F.col("sample_index").alias("ordinal"), F.replace("image_filename", F.lit("bench_0"), F.lit("train_10")).alias("image_filename"))
    first = t.sample_manifest.dropna(subset=["image_filename", "sample_index"]).groupBy("image_filename").agg(F.min("sample_index").alias("sample_index"))
    return first.join(want, "image_filename").select("ordinal", "sample_index", "image_filename")


@query("""SELECT result_id, json_valid(drishtikon_diagnostics) AS ok, CASE WHEN json_valid(drishtikon_diagnostics) THEN json_array_length(drishtikon_diagnostics)::INTEGER END AS n_entries,
  CASE WHEN json_valid(drishtikon_diagnostics) THEN round((drishtikon_diagnostics::JSON->0->>'score')::DOUBLE, 6) END AS top_score FROM inference_results WHERE drishtikon_diagnostics IS NOT NULL AND trim(drishtikon_diagnostics) <> ''""")
def jsonl_tolerant_scan(t):
    """JSON values of a text column; corrupt ones are flagged, blank ones skipped."""
    v = F.try_parse_json("drishtikon_diagnostics")
    df = t.inference_results.where("trim(drishtikon_diagnostics) <> ''").withColumn("v", v)
    return df.select("result_id", F.col("v").isNotNull().alias("ok"), F.when(F.col("v").isNotNull(), F.json_array_length("drishtikon_diagnostics")).alias("n_entries"), F.round(F.try_variant_get("v", "$[0].score", "double"), 6).alias("top_score"))
