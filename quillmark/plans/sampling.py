"""Queries on splits, quota samples, manifests and their validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.sampling import order_key, ranked
from .dedup import SAMPLES, _samples, dupes_of, hamming_pairs, keyed_samples, pairs_of, quarantine_first_hits
from .registry import CORPUS, query


@query(f"""WITH {CORPUS}, x AS (SELECT row_id, is_humorous, row_number() OVER (PARTITION BY is_humorous ORDER BY md5('42|split|' || row_id)) AS place, count(*) OVER (PARTITION BY is_humorous) AS n FROM corpus WHERE is_humorous IS NOT NULL)
SELECT row_id, is_humorous, CASE WHEN place <= floor(0.8 * n) THEN 'train' WHEN place <= floor(0.9 * n) THEN 'validation' ELSE 'test' END AS part FROM x""")
def stratified_split(t):
    """80/10/10 by class in hash order; exact shares, and no class passes through one task."""
    c = t.corpus("is_humorous").dropna(subset=["is_humorous"]).withColumn("o", order_key("row_id", "split"))
    r = ranked(c, ["is_humorous"], "o")
    part = F.when(F.col("place") <= F.floor(F.lit(0.8) * F.col("total")), "train").when(F.col("place") <= F.floor(F.lit(0.9) * F.col("total")), "validation").otherwise("test")
    return r.select("row_id", "is_humorous", part.alias("part"))


@query(f"""WITH {CORPUS} SELECT row_id, is_humorous, row_number() OVER (PARTITION BY is_humorous ORDER BY md5('42|balanced|' || row_id)) AS place FROM corpus WHERE is_humorous IS NOT NULL QUALIFY place <= 50""")
def balanced_sample(t):
    c = t.corpus("is_humorous").dropna(subset=["is_humorous"]).withColumn("o", order_key("row_id", "balanced"))
    return ranked(c, ["is_humorous"], "o").where("place <= 50").select("row_id", "is_humorous", "place")


#: Strata in order of priority: (name, quota, SQL predicate over a meme).
STRATA = (
    ("NH3", 4, "is_humorous = 0 AND lower(ocr) LIKE '%breaking%'"),
    ("NH6", 6, "is_humorous = 0 AND offensive IN ('very_offensive', 'hateful_offensive')"),
    ("NH5", 6, "is_humorous = 0 AND overall IN ('negative', 'very_negative')"),
    ("NH1", 12, "is_humorous = 0 AND sarcastic = 'not_sarcastic'"),
    ("NH2", 12, "is_humorous = 0 AND motivational = 'motivational'"),
    ("NH4", 10, "is_humorous = 0"),
    ("H5", 5, "is_humorous = 1 AND ocr_lang = 'en'"),
    ("H4", 5, "is_humorous = 1 AND offensive = 'slight'"),
    ("H3", 10, "is_humorous = 1 AND sarcastic = 'twisted_meaning'"),
    ("H1", 15, "is_humorous = 1 AND humour = 'hilarious'"),
    ("H2", 15, "is_humorous = 1"),
)


def _quota_sql() -> str:
    steps, used = [], []
    for name, quota, where in STRATA:
        without = " AND ".join(f"row_id NOT IN (SELECT row_id FROM d_{u})" for u in used) or "true"
        steps.append(f"d_{name} AS (SELECT row_id, '{name}' AS stratum FROM corpus WHERE {where} AND {without} ORDER BY md5('42|{name}|' || row_id) LIMIT {quota})")
        used.append(name)
    return f"WITH {CORPUS}, " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT row_id, stratum FROM d_{n}" for n, *_ in STRATA)


@query(_quota_sql())
def quota_sample(t):
    """Quota sample of disjoint strata in order of priority.

    A row drawn earlier can displace at most as many candidates as were drawn before, so for each stratum the first
    quota + (all earlier quotas) rows in hash order hold its draw: one pass keeps these bounded lists (100 rows each at
    most), and the draws are settled on them.
    """
    c = t.corpus("ocr", "humour", "sarcastic", "offensive", "motivational", "overall", "ocr_lang", "is_humorous")
    total = 0
    tops = []
    for name, quota, where in STRATA:
        total += quota
        tops.append(F.when(F.expr(where), F.struct(order_key("row_id", name).alias("o"), F.lit(name).alias("stratum"), F.lit(total).alias("room"))))
    rows = c.select("row_id", F.explode(F.array_compact(F.array(*tops))).alias("x")).select("row_id", "x.*")
    listed = ranked(rows, ["stratum"], "o").where("place <= room").select("row_id", "stratum", "o")

    def settle(pdf):
        import pandas as pd

        used, out = set(), []
        for name, quota, _ in STRATA:
            mine = pdf[pdf.stratum == name].sort_values("o")
            mine = mine[~mine.row_id.isin(used)].head(quota)
            used |= set(mine.row_id)
            out.append(mine[["row_id", "stratum"]])
        return pd.concat(out)

    return listed.groupBy().applyInPandas(settle, "row_id long, stratum string")


@query(f"""WITH {SAMPLES}, r AS (SELECT sample_index, manifest_id, row_number() OVER (PARTITION BY manifest_id ORDER BY image_filename, sample_index) AS n FROM s WHERE manifest_id IS NOT NULL)
SELECT sample_index, manifest_id, printf('heldout_%03d', n) AS sample_name FROM r""")
def manifest(t):
    """Names of samples by their order within the manifest; a manifest is a bounded draw."""
    w = Window.partitionBy("manifest_id").orderBy(F.col("image_filename").asc_nulls_last(), "sample_index")
    s = _samples(t, "manifest_id", "image_filename").dropna(subset=["manifest_id"])
    return s.select("sample_index", "manifest_id", F.format_string("heldout_%03d", F.row_number().over(w)).alias("sample_name"))


@query(f"""WITH {CORPUS} SELECT row_id, CASE WHEN lower(ocr) LIKE '%sharma%' AND is_humorous = 0 THEN 'AMBIGUOUS_BORDERLINE' WHEN sarcastic IN ('twisted_meaning', 'very_twisted') AND is_humorous = 0 THEN 'AMBIGUOUS_BORDERLINE' WHEN offensive = 'hateful_offensive' AND is_humorous = 1 THEN 'AMBIGUOUS_BORDERLINE' ELSE 'CLEAN_CONSENSUS' END AS status,
  CASE WHEN lower(ocr) LIKE '%sharma%' AND is_humorous = 0 THEN 'stock character' WHEN sarcastic IN ('twisted_meaning', 'very_twisted') AND is_humorous = 0 THEN 'irony without humour' WHEN offensive = 'hateful_offensive' AND is_humorous = 1 THEN 'hostile humour' END AS reason FROM corpus""")
def ambiguity_flag(t):
    c = t.corpus("ocr", "sarcastic", "offensive", "is_humorous")
    rules = ((F.lower("ocr").contains("sharma") & (F.col("is_humorous") == 0), "stock character"), (F.col("sarcastic").isin("twisted_meaning", "very_twisted") & (F.col("is_humorous") == 0), "irony without humour"), ((F.col("offensive") == "hateful_offensive") & (F.col("is_humorous") == 1), "hostile humour"))
    reason = F.lit(None).cast("string")
    for cond, why in reversed(rules):
        reason = F.when(cond, why).otherwise(reason)
    return c.withColumn("reason", reason).select("row_id", F.when(F.col("reason").isNotNull(), "AMBIGUOUS_BORDERLINE").otherwise("CLEAN_CONSENSUS").alias("status"), "reason")


_RULES = (("bad_truth", "ground_truth IS NULL OR ground_truth NOT IN (0, 1)"), ("no_stratum", "stratum_id IS NULL"), ("truth_against_class", "ground_truth IS NOT NULL AND class_name IS NOT NULL AND (ground_truth = 1) <> (class_name = 'humorous')"), ("no_text", "ocr_text IS NULL OR trim(ocr_text) = ''"), ("no_file", "image_filename IS NULL"))


@query(f"WITH {SAMPLES} " + " UNION ALL ".join(f"SELECT '{n}' AS rule, sample_index FROM s WHERE {w}" for n, w in _RULES))
def manifest_violations(t):
    """One row per violated rule and sample; all rules are applied in one pass."""
    s = _samples(t, "ground_truth", "stratum_id", "class_name", "ocr_text", "image_filename")
    return s.select("sample_index", F.explode(F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n)) for n, w in _RULES]))).alias("rule")).select("rule", "sample_index")


@query()
def manifest_errors(t):
    """(rule, manifest_id, sample_index, other): manifest_violations and the rules over several samples, which have no SQL.

    Repeated ids, files and paths within a manifest (the first sample is `other`), quarantined files, texts and samples
    (`other` is the benchmark's or the quarantined sample's index), pairs within a manifest that look or read alike, and
    manifests whose classes are not half and half (sample_index null).
    """
    s = _samples(t, "manifest_id", "sample_id", "image_filename", "relative_image_path", "ground_truth")
    of = s.select("sample_index", "manifest_id")
    rows = lambda df, rule, other: df.select(F.lit(rule).alias("rule"), "manifest_id", "sample_index", other.cast("long").alias("other"))
    out = [manifest_violations(t).join(of, "sample_index").select("rule", "manifest_id", "sample_index", F.lit(None).cast("long").alias("other"))]
    for rule, column in (("repeated_id", "sample_id"), ("repeated_file", "image_filename"), ("repeated_path", "relative_image_path")):
        known = s.dropna(subset=["manifest_id", column])
        first = known.groupBy("manifest_id", column).agg(F.min("sample_index").alias("first"), F.count("*").alias("n")).where("n > 1")
        out.append(rows(known.join(first, ["manifest_id", column]).where("sample_index > first"), rule, F.col("first")))
    b = t.benchmark_memes.select("image_filename", F.col("sample_index").alias("ref")).dropna().dropDuplicates(["image_filename"])
    out.append(rows(s.join(b, "image_filename"), "quarantined_file", F.col("ref")))
    texts = dupes_of(t, keyed_samples(t)).select(F.col("cand").alias("sample_index"), "ref").join(of, "sample_index")
    out.append(rows(texts, "quarantined_text", F.col("ref")))
    out.append(rows(quarantine_first_hits(t).withColumnRenamed("cand", "sample_index").join(of, "sample_index"), "quarantined_sample", F.col("ref")))
    looks = hamming_pairs(t).select("key_a", "key_b")
    reads = pairs_of("ocr_text", keyed_samples(t)).select(F.col("cand").alias("key_a"), F.col("ref").alias("key_b"))
    for rule, pairs in (("looks_alike", looks), ("reads_alike", reads)):
        a, c = of.withColumnRenamed("sample_index", "key_a"), of.withColumnRenamed("sample_index", "key_b")
        out.append(rows(pairs.join(a, "key_a").join(c, ["manifest_id", "key_b"]).withColumnRenamed("key_a", "sample_index"), rule, F.col("key_b")))
    half = s.dropna(subset=["manifest_id"]).groupBy("manifest_id").agg(F.count_if(F.col("ground_truth") == 1).alias("x"), F.count_if(F.col("ground_truth") == 0).alias("y")).where("x <> y")
    out.append(rows(half.withColumn("sample_index", F.lit(None).cast("int")), "not_half_and_half", F.lit(None)))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more.withColumn("sample_index", F.col("sample_index").cast("int")))
    return whole


@query(f"""WITH {SAMPLES}, c AS (SELECT manifest_id, stratum_id, count(*) AS n FROM s WHERE manifest_id IS NOT NULL AND stratum_id IS NOT NULL GROUP BY ALL), q AS (SELECT manifest_id, stratum_id, sum(min_count)::BIGINT AS quota FROM draw_targets GROUP BY ALL)
SELECT coalesce(c.manifest_id, q.manifest_id) AS manifest_id, coalesce(c.stratum_id, q.stratum_id) AS stratum_id, coalesce(n, 0) AS n, coalesce(quota, 0) AS quota, coalesce(n, 0) >= coalesce(quota, 0) AS ok FROM c FULL JOIN q ON c.manifest_id = q.manifest_id AND c.stratum_id = q.stratum_id""")
def quota_check(t):
    c = _samples(t, "manifest_id", "stratum_id").dropna(subset=["manifest_id", "stratum_id"]).groupBy("manifest_id", "stratum_id").agg(F.count("*").alias("n"))
    q = t.draw_targets.groupBy("manifest_id", "stratum_id").agg(F.sum("min_count").alias("quota"))
    return c.join(q, ["manifest_id", "stratum_id"], "full").na.fill(0, ["n", "quota"]).select("manifest_id", "stratum_id", "n", "quota", (F.col("n") >= F.col("quota")).alias("ok"))


#: Checks before a run, in order: name, SQL of what is counted, SQL of what must hold of the counts of a manifest.
_CHECKS = (
    ("sample_count", "n_samples", "n_samples > 0 AND n_samples = n_ids AND n_samples = n_files AND n_one = n_zero"),
    ("fingerprint", "fingerprint", "true"),
    ("files_named", "n_without_file", "n_without_file = 0"),
    ("stratum_quotas", "n_short_strata", "n_short_strata = 0"),
    ("parity", "n_changed", "n_changed = 0"),
    ("historical_exclusion", "n_historical", "n_historical = 0"),
    ("borderline_flags", "n_borderline", "n_unflagged = 0"),
    ("config_hashes", "n_configs", "n_configs >= 1"),
    ("distinct_outputs", "n_conditions", "n_conditions >= 2"),
    ("failure_exclusion", "n_failed_with_class", "n_failed_with_class = 0"),
)
_SAMPLE_FACTS = {
    "n_samples": "count(*)", "n_ids": "count(DISTINCT sample_id)", "n_files": "count(DISTINCT image_filename)", "n_one": "count_if(ground_truth = 1)", "n_zero": "count_if(ground_truth = 0)", "n_without_file": "count_if(image_filename IS NULL)",
    "n_borderline": "count_if(ambiguity_status = 'AMBIGUOUS_BORDERLINE')", "n_unflagged": "count_if(ambiguity_status IS NULL)",
}
_RUN_FACTS = {"n_configs": "count(DISTINCT model_config_hash)", "n_conditions": "count(DISTINCT run_condition)", "n_failed_with_class": "count_if(timed_out AND prediction IS NOT NULL)"}
_FACTS = [*_SAMPLE_FACTS, "fingerprint", "n_historical", "n_changed", "n_short_strata", *_RUN_FACTS]


def _listed(facts):
    return ", ".join(f"{v} AS {k}" for k, v in facts.items())


@query(f"""WITH {SAMPLES}, a AS (SELECT manifest_id, {_listed(_SAMPLE_FACTS)}, bit_xor(('0x' || substr(md5(sample_id), 1, 12))::BIGINT) AS fingerprint, count_if(image_filename IN (SELECT image_filename FROM benchmark_memes)) AS n_historical FROM s WHERE manifest_id IS NOT NULL GROUP BY 1),
d AS (SELECT manifest_id, count_if(k > 1) AS n_changed FROM (SELECT manifest_id, sample_id, count(DISTINCT coalesce(image_filename, '') || '|' || coalesce(ground_truth::VARCHAR, '') || '|' || coalesce(ocr_text, '')) AS k FROM sample_manifest WHERE manifest_id IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL) GROUP BY 1),
h AS (SELECT manifest_id, stratum_id, count(*) AS have FROM s GROUP BY ALL), q AS (SELECT manifest_id, stratum_id, sum(min_count) AS quota FROM draw_targets GROUP BY ALL),
o AS (SELECT q.manifest_id, count_if(coalesce(have, 0) < quota) AS n_short_strata FROM q LEFT JOIN h ON h.manifest_id = q.manifest_id AND h.stratum_id = q.stratum_id GROUP BY 1),
r AS (SELECT replace(evaluation_id, 'eval_', 'man_') AS manifest_id, {_listed(_RUN_FACTS)} FROM inference_results WHERE evaluation_id IS NOT NULL GROUP BY 1),
f AS (SELECT a.manifest_id, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in _FACTS)} FROM a LEFT JOIN d USING (manifest_id) LEFT JOIN o USING (manifest_id) LEFT JOIN r USING (manifest_id))
""" + " UNION ALL ".join(f"SELECT manifest_id, {i} AS no, '{name}' AS check_name, {holds} AS passed, {what} AS evidence FROM f" for i, (name, what, holds) in enumerate(_CHECKS, 1)))
def preflight(t):
    """Ten checks of each manifest before a run, each with the number that shows why; the fingerprint is of its sample ids in any order.

    Deliveries of one sample that differ in file, class or text count against parity. Whether an image can be read is left to the readers of files.
    """
    s = t.samples("manifest_id", "stratum_id", "sample_id", "image_filename", "ground_truth", "ambiguity_status").dropna(subset=["manifest_id"])
    old = t.benchmark_memes.select("image_filename").dropna().distinct().withColumn("historical", F.lit(1))
    digit = F.conv(F.substring(F.md5("sample_id"), 1, 12), 16, 10).cast("long")
    facts = s.join(old, "image_filename", "left").groupBy("manifest_id").agg(*[F.expr(v).alias(k) for k, v in _SAMPLE_FACTS.items()], F.bit_xor(digit).alias("fingerprint"), F.count("historical").alias("n_historical"))
    told = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("image_filename", "ground_truth", "ocr_text")])
    changed = t.sample_manifest.dropna(subset=["manifest_id", "sample_id"]).groupBy("manifest_id", "sample_id").agg(F.countDistinct(told).alias("k")).groupBy("manifest_id").agg(F.count_if(F.col("k") > 1).alias("n_changed"))
    have = s.groupBy("manifest_id", "stratum_id").agg(F.count("*").alias("have"))
    quota = t.draw_targets.groupBy("manifest_id", "stratum_id").agg(F.sum("min_count").alias("quota")).join(have, ["manifest_id", "stratum_id"], "left")
    short = quota.groupBy("manifest_id").agg(F.count_if(F.coalesce("have", F.lit(0)) < F.col("quota")).alias("n_short_strata"))
    runs = t.inference_results.where("evaluation_id is not null").groupBy(F.replace("evaluation_id", F.lit("eval_"), F.lit("man_")).alias("manifest_id")).agg(*[F.expr(v).alias(k) for k, v in _RUN_FACTS.items()])
    for more in (changed, short, runs):
        facts = facts.join(more, "manifest_id", "left")
    checks = [F.struct(F.lit(i).alias("no"), F.lit(name).alias("check_name"), F.expr(holds).alias("passed"), F.col(what).alias("evidence")) for i, (name, what, holds) in enumerate(_CHECKS, 1)]
    return facts.select("manifest_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _FACTS]).select("manifest_id", F.explode(F.array(*checks)).alias("x")).select("manifest_id", "x.*")


_FLAGS = [w for _, _, w in STRATA]


@query(f"WITH {CORPUS}, x AS (SELECT " + " + ".join(f"coalesce(({w})::INTEGER, 0)" for w in _FLAGS) + " AS n_strata FROM corpus) SELECT n_strata::INTEGER AS n_strata, count(*) AS n FROM x GROUP BY 1")
def strata_overlap_hist(t):
    c = t.corpus("ocr", "humour", "sarcastic", "offensive", "motivational", "overall", "ocr_lang", "is_humorous")
    n = sum((F.coalesce(F.expr(w).cast("int"), F.lit(0)) for w in _FLAGS), F.lit(0))
    return c.groupBy(n.alias("n_strata")).agg(F.count("*").alias("n"))


TEMPLATE = "Read the caption and answer whether it is humorous.\nCaption: {ocr_text}"


@query(f"""WITH {CORPUS} SELECT row_id, image_filename AS image, replace('{TEMPLATE}', '{{ocr_text}}', ocr) AS user_message, CASE WHEN is_humorous = 1 THEN 'humorous' ELSE 'not humorous' END AS answer FROM corpus WHERE ocr IS NOT NULL AND is_humorous IS NOT NULL""".replace("\\n", "' || chr(10) || '").replace("\nCaption", "' || chr(10) || 'Caption"))
def instruction_records(t):
    """Instruction records; `instruction_messages` in sources.jsonl nests them as messages for the JSONL sink."""
    c = t.corpus("ocr", "image_filename", "is_humorous").dropna(subset=["ocr", "is_humorous"])
    return c.select("row_id", F.col("image_filename").alias("image"), F.replace(F.lit(TEMPLATE), F.lit("{ocr_text}"), F.col("ocr")).alias("user_message"), F.when(F.col("is_humorous") == 1, "humorous").otherwise("not humorous").alias("answer"))


@query("""SELECT r.result_id, p.prompt_text || CASE WHEN trim(coalesce(r.ocr_text, '')) <> '' THEN chr(10) || 'Text: ' || r.ocr_text ELSE '' END || CASE WHEN trim(coalesce(r.retrieved_context, '')) <> '' THEN chr(10) || 'Notes: ' || r.retrieved_context ELSE '' END AS message
FROM inference_results r JOIN prompts p USING (prompt_hash)""")
def prompt_messages(t):
    """Prompts with their sections; a section without text is left out."""
    part = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"\n{name}: "), F.col(c))).otherwise("")
    r = t.inference_results.select("result_id", "prompt_hash", "ocr_text", "retrieved_context").join(t.prompts.select("prompt_hash", "prompt_text"), "prompt_hash")
    return r.select("result_id", F.concat("prompt_text", part("Text", "ocr_text"), part("Notes", "retrieved_context")).alias("message"))
