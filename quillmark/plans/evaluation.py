"""Queries that compare runs: confusion matrices, sweeps, calibration, ranking, agreement, latency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.metrics import CONFUSION_SQL, RATES_SQL, average_precision, confusion, cumulated, rates, ratio, roc_auc, score_table
from .registry import LOG, PAIRED, query

TAUS = (0.1, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.575, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9)
TAU_SQL = "(VALUES " + ", ".join(f"({x}::DOUBLE)" for x in TAUS) + ") v(tau)"
_VALID = "valid AND ground_truth IN (0, 1)"
_BOTH = "valid_a AND valid_b AND ground_truth IN (0, 1)"


@query(f"WITH {LOG} SELECT run_condition, {CONFUSION_SQL.format(t='ground_truth', p='prediction')} FROM log WHERE {_VALID} GROUP BY 1")
def confusion_matrix(t):
    return t.log("ground_truth").where(_VALID).groupBy("run_condition").agg(*confusion(F.col("prediction"), F.col("ground_truth")))


@query(f"WITH {LOG}, c AS (SELECT run_condition, {CONFUSION_SQL.format(t='ground_truth', p='prediction')} FROM log WHERE {_VALID} GROUP BY 1) SELECT *, {RATES_SQL} FROM c")
def binary_metrics(t):
    return rates(confusion_matrix(t))


@query(f"""WITH {LOG}, c AS (SELECT run_condition, tau, {CONFUSION_SQL.format(t='ground_truth', p='(CASE WHEN coalesce(p >= tau, false) THEN 1 ELSE 0 END)')}
  FROM log, {TAU_SQL} WHERE valid AND p IS NOT NULL AND ground_truth IN (0, 1) GROUP BY ALL) SELECT *, {RATES_SQL} FROM c""")
def threshold_sweep(t):
    """Metrics per condition and threshold. Rows are counted per interval between thresholds once and the counts cumulated; rows aren't multiplied by the thresholds."""
    df = t.log("ground_truth").where(_VALID + " and p is not null")
    bin_ = sum((F.when(F.col("p") >= x, 1).otherwise(0) for x in TAUS), F.lit(0))  # thresholds reached
    counts = df.groupBy("run_condition", bin_.alias("reached")).agg(F.count_if(F.col("ground_truth") == 1).alias("pos"), F.count_if(F.col("ground_truth") == 0).alias("neg"))
    per = counts.select("run_condition", "pos", "neg", F.explode(F.array(*[F.struct(F.lit(x).alias("tau"), (F.col("reached") > i).alias("hit")) for i, x in enumerate(TAUS)])).alias("s")).select("run_condition", "pos", "neg", "s.*")
    add = lambda c, hit: F.sum(F.when(F.col("hit") == hit, F.col(c)).otherwise(0))
    return rates(per.groupBy("run_condition", "tau").agg(add("neg", False).alias("tn"), add("neg", True).alias("fp"), add("pos", False).alias("fn"), add("pos", True).alias("tp")))


@query(f"""WITH {LOG}, x AS (SELECT run_condition, unnest([0, 1]) AS label, ground_truth, prediction FROM log WHERE {_VALID}),
c AS (SELECT run_condition, label, count(*) FILTER (ground_truth = label) AS support, count(*) FILTER (prediction = label) AS said, count(*) FILTER (ground_truth = label AND prediction = label) AS hit FROM x GROUP BY ALL),
f AS (SELECT *, coalesce(2 * hit / nullif(support + said, 0)::DOUBLE, 0) AS f1 FROM c WHERE support + said > 0)
SELECT run_condition, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY 1""")
def macro_weighted_f1(t):
    return _macro(t.log("ground_truth").where(_VALID), ["run_condition"])


def _macro(df, keys):
    """Macro and weighted F1 over the labels that occur as truth or prediction."""
    c = df.select(*keys, "ground_truth", "prediction", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    c = c.groupBy(*keys, "label").agg(F.count_if(F.col("ground_truth") == F.col("label")).alias("support"), F.count_if(F.col("prediction") == F.col("label")).alias("said"), F.count_if((F.col("ground_truth") == F.col("label")) & (F.col("prediction") == F.col("label"))).alias("hit"))
    f = c.where("support + said > 0").withColumn("f1", ratio(2 * F.col("hit"), F.col("support") + F.col("said")))
    return f.groupBy(*keys).agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


@query(f"""WITH {LOG}, x AS (SELECT cultural_dependency AS dependency, unnest([0, 1]) AS label, ground_truth, prediction FROM log WHERE {_VALID} AND cultural_dependency IS NOT NULL),
c AS (SELECT dependency, label, count(*) FILTER (ground_truth = label) AS support, count(*) FILTER (prediction = label) AS said, count(*) FILTER (ground_truth = label AND prediction = label) AS hit FROM x GROUP BY ALL),
f AS (SELECT *, coalesce(2 * hit / nullif(support + said, 0)::DOUBLE, 0) AS f1 FROM c WHERE support + said > 0)
SELECT dependency, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f GROUP BY 1""")
def subgroup_f1(t):
    df = t.log("ground_truth", "cultural_dependency").where(_VALID + " and cultural_dependency is not null")
    return _macro(df.withColumnRenamed("cultural_dependency", "dependency"), ["dependency"])


@query(f"WITH {PAIRED} SELECT * EXCLUDE (sources, context), CASE WHEN pred_a <> pred_b THEN true ELSE false END AS changed FROM paired WHERE {_BOTH}")
def paired_compare(t):
    return t.paired().where(_BOTH).drop("sources", "context").withColumn("changed", F.coalesce(F.col("pred_a") != F.col("pred_b"), F.lit(False)))


@query(f"""WITH {PAIRED}, m AS (SELECT sample_index, manifest_id FROM sample_manifest WHERE sample_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY ingested_at DESC) = 1)
SELECT m.manifest_id, m.sample_index, p.pred_a, p.pred_b, p.valid_a, p.valid_b FROM m LEFT JOIN paired p ON p.evaluation_id = replace(m.manifest_id, 'man_', 'eval_') AND p.sample_index = m.sample_index""")
def paired_alignment(t):
    """Every sample of a manifest with both runs of its evaluation; nulls where there is none."""
    p = t.paired().select("evaluation_id", "sample_index", "pred_a", "pred_b", "valid_a", "valid_b")
    m = t.samples("manifest_id").withColumn("evaluation_id", F.replace("manifest_id", F.lit("man_"), F.lit("eval_")))
    return m.join(p, ["evaluation_id", "sample_index"], "left").select("manifest_id", "sample_index", "pred_a", "pred_b", "valid_a", "valid_b")


_USED = "CASE WHEN valid_a AND valid_b THEN 'paired' WHEN valid_a THEN 'general' WHEN valid_b THEN 'cultural' ELSE 'none' END"
_SPEAKS = "CASE WHEN valid_b THEN pred_b WHEN valid_a THEN pred_a END"


@query(f"WITH {PAIRED} SELECT evaluation_id, sample_index, {_USED} AS used, {_SPEAKS} AS prediction FROM paired")
def paired_fallback(t):
    """The run that speaks for a sample: the cultural one, else the general one, else none."""
    return t.paired().select("evaluation_id", "sample_index", F.expr(_USED).alias("used"), F.expr(_SPEAKS).alias("prediction"))


@query(f"WITH {PAIRED} SELECT evaluation_id, sample_index, ground_truth, pred_a, pred_b FROM paired WHERE {_BOTH} AND pred_a <> pred_b")
def changed_predictions(t):
    return t.paired().where(_BOTH).where("pred_a <> pred_b").select("evaluation_id", "sample_index", "ground_truth", "pred_a", "pred_b")


@query(f"""WITH {PAIRED} SELECT evaluation_id, count(*) FILTER (pred_a = ground_truth AND pred_b = ground_truth) AS both_right, count(*) FILTER (pred_a <> ground_truth AND pred_b = ground_truth) AS fixed,
  count(*) FILTER (pred_a = ground_truth AND pred_b <> ground_truth) AS broken, count(*) FILTER (pred_a <> ground_truth AND pred_b <> ground_truth) AS both_wrong, count(*) FILTER (pred_a <> pred_b) AS changed FROM paired WHERE {_BOTH} GROUP BY 1""")
def transition_counts(t):
    a, b = F.col("pred_a") == F.col("ground_truth"), F.col("pred_b") == F.col("ground_truth")
    return t.paired().where(_BOTH).groupBy("evaluation_id").agg(F.count_if(a & b).alias("both_right"), F.count_if(~a & b).alias("fixed"), F.count_if(a & ~b).alias("broken"), F.count_if(~a & ~b).alias("both_wrong"), F.count_if(F.col("pred_a") != F.col("pred_b")).alias("changed"))


@query(f"""WITH {PAIRED}, d AS (SELECT *, p_b - p_a AS d FROM paired WHERE {_BOTH} AND p_a IS NOT NULL AND p_b IS NOT NULL)
SELECT count(*) AS n, round(avg(p_a), 6) AS mean_a, round(avg(p_b), 6) AS mean_b, round(avg(d), 6) AS mean_delta, round(quantile_cont(d, 0.5), 6) AS median_delta,
  count(*) FILTER (d > 0.01) AS up, count(*) FILTER (d < -0.01) AS down, count(*) FILTER (abs(d) <= 0.01) AS same FROM d""")
def prob_delta_stats(t):
    d = t.paired().where(_BOTH + " and p_a is not null and p_b is not null").withColumn("d", F.col("p_b") - F.col("p_a"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("p_a"), 6).alias("mean_a"), F.round(F.avg("p_b"), 6).alias("mean_b"), F.round(F.avg("d"), 6).alias("mean_delta"), F.round(F.percentile("d", 0.5), 6).alias("median_delta"), F.count_if(F.col("d") > 0.01).alias("up"), F.count_if(F.col("d") < -0.01).alias("down"), F.count_if(F.abs("d") <= 0.01).alias("same"))


@query(f"WITH {LOG} SELECT run_condition, round(avg(p) FILTER (ground_truth = 0), 6) AS mean_p_0, round(avg(p) FILTER (ground_truth = 1), 6) AS mean_p_1 FROM log WHERE {_VALID} GROUP BY 1")
def prob_by_truth(t):
    mean = lambda g: F.round(F.avg(F.when(F.col("ground_truth") == g, F.col("p"))), 6).alias(f"mean_p_{g}")
    return t.log("ground_truth").where(_VALID).groupBy("run_condition").agg(mean(0), mean(1))


@query(f"""WITH {LOG} SELECT run_condition, count(*) AS n, round(avg(inference_duration_s), 6) AS mean_s, round(quantile_cont(inference_duration_s, 0.5), 6) AS median_s, round(max(inference_duration_s), 6) AS max_s, round(sum(inference_duration_s), 3) AS total_s,
  count(*) FILTER (late) AS timeouts FROM log GROUP BY 1""")
def latency_stats(t):
    s = "inference_duration_s"
    return t.log(s).groupBy("run_condition").agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean_s"), F.round(F.percentile(s, 0.5), 6).alias("median_s"), F.round(F.max(s), 6).alias("max_s"), F.round(F.sum(s), 3).alias("total_s"), F.count_if("late").alias("timeouts"))


@query(f"""WITH {LOG} SELECT evaluation_id, run_condition, count(*) AS attempts, count(*) FILTER (valid) AS evaluated, count(*) FILTER (NOT valid) AS failures, count(*) FILTER (late) AS timeouts,
  count(*) FILTER (coalesce(stage2_fallback_to_stage1, false)) AS fallbacks, round(count(*) FILTER (valid) / count(*)::DOUBLE, 6) AS valid_rate FROM log GROUP BY ALL""")
def reliability_rollup(t):
    g = t.log("stage2_fallback_to_stage1").groupBy("evaluation_id", "run_condition")
    return g.agg(F.count("*").alias("attempts"), F.count_if("valid").alias("evaluated"), F.count_if(~F.col("valid")).alias("failures"), F.count_if("late").alias("timeouts"), F.count_if(F.coalesce("stage2_fallback_to_stage1", F.lit(False))).alias("fallbacks"), F.round(F.count_if("valid") / F.count("*"), 6).alias("valid_rate"))


@query(f"""WITH {LOG} SELECT run_condition, round(count(*) FILTER (coalesce(json_error ILIKE '%pars%' OR json_error ILIKE '%missing%', false)) / greatest(1, count(*))::DOUBLE, 6) AS parse_failure_rate,
  round(count(*) FILTER (prediction IS NULL) / greatest(1, count(*))::DOUBLE, 6) AS inference_failure_rate FROM log GROUP BY 1""")
def failure_rates(t):
    bad = F.coalesce(F.lower("json_error").rlike("pars|missing"), F.lit(False))
    return t.log().groupBy("run_condition").agg(F.round(F.count_if(bad) / F.count("*"), 6).alias("parse_failure_rate"), F.round(F.count_if(F.col("prediction").isNull()) / F.count("*"), 6).alias("inference_failure_rate"))


@query(f"""WITH {PAIRED}, c AS (SELECT evaluation_id, count(*) AS n, avg((pred_a = ground_truth)::INTEGER) AS acc_a, avg((pred_b = ground_truth)::INTEGER) AS acc_b FROM paired WHERE {_BOTH} GROUP BY 1)
SELECT evaluation_id, n, round(acc_a, 6) AS accuracy_a, round(acc_b, 6) AS accuracy_b, round(acc_b - acc_a, 6) AS delta FROM c""")
def mode_delta(t):
    right = lambda p: F.avg((F.col(p) == F.col("ground_truth")).cast("int"))
    g = t.paired().where(_BOTH).groupBy("evaluation_id").agg(F.count("*").alias("n"), right("pred_a").alias("x"), right("pred_b").alias("y"))
    return g.select("evaluation_id", "n", F.round("x", 6).alias("accuracy_a"), F.round("y", 6).alias("accuracy_b"), F.round(F.col("y") - F.col("x"), 6).alias("delta"))


_STRATA = """, s AS (SELECT sample_index, stratum_id, ambiguity_status FROM sample_manifest WHERE sample_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY ingested_at DESC) = 1)"""


def _strata(t):
    from ..operators.log import last_wins

    return last_wins(t.sample_manifest.select("sample_index", "stratum_id", "ambiguity_status", "ingested_at"), ["sample_index"], ["ingested_at"])


@query(f"""WITH {PAIRED}{_STRATA} SELECT coalesce(stratum_id, '') AS stratum, count(*) AS n, count(*) FILTER (valid_a) AS completed_a, count(*) FILTER (valid_b) AS completed_b,
  round(coalesce(count(*) FILTER (valid_a AND pred_a = ground_truth) / nullif(count(*) FILTER (valid_a), 0)::DOUBLE, 0), 6) AS acc_a, round(coalesce(count(*) FILTER (valid_b AND pred_b = ground_truth) / nullif(count(*) FILTER (valid_b), 0)::DOUBLE, 0), 6) AS acc_b
FROM paired JOIN s USING (sample_index) GROUP BY 1""")
def stratum_breakdown(t):
    df = t.paired().join(_strata(t), "sample_index")
    hit = lambda x: F.round(ratio(F.count_if(F.col(f"valid_{x}") & (F.col(f"pred_{x}") == F.col("ground_truth"))), F.count_if(f"valid_{x}")), 6).alias(f"acc_{x}")
    return df.groupBy(F.coalesce("stratum_id", F.lit("")).alias("stratum")).agg(F.count("*").alias("n"), F.count_if("valid_a").alias("completed_a"), F.count_if("valid_b").alias("completed_b"), hit("a"), hit("b"))


@query(f"""WITH {PAIRED}{_STRATA}, c AS (SELECT coalesce(ambiguity_status, 'ALL') AS subset, {CONFUSION_SQL.format(t='ground_truth', p='pred_b')} FROM paired JOIN s USING (sample_index) WHERE {_BOTH} AND ambiguity_status IS NOT NULL GROUP BY GROUPING SETS ((ambiguity_status), ()))
SELECT *, {RATES_SQL} FROM c""")
def subset_metrics(t):
    df = t.paired().where(_BOTH).join(_strata(t), "sample_index").where("ambiguity_status is not null")
    c = df.rollup("ambiguity_status").agg(*confusion(F.col("pred_b"), F.col("ground_truth")))
    return rates(c.withColumn("subset", F.coalesce("ambiguity_status", F.lit("ALL"))).drop("ambiguity_status"))


@query(f"""WITH {PAIRED}, x AS (SELECT coalesce(matches, 0) > 0 AS has_d, len(coalesce(sources, [])) > 0 AS has_p, pred_a <> pred_b AS changed FROM paired WHERE {_BOTH})
SELECT CASE WHEN has_d AND has_p THEN 'both' WHEN has_d THEN 'd_only' WHEN has_p THEN 'p_only' ELSE 'neither' END AS source_kind, count(*) AS n, count(*) FILTER (changed) AS n_changed FROM x GROUP BY 1""")
def source_crosstab(t):
    d, p = F.coalesce("matches", F.lit(0)) > 0, F.coalesce(F.size("sources"), F.lit(0)) > 0
    kind = F.when(d & p, "both").when(d, "d_only").when(p, "p_only").otherwise("neither")
    return t.paired().where(_BOTH).groupBy(kind.alias("source_kind")).agg(F.count("*").alias("n"), F.count_if(F.col("pred_a") != F.col("pred_b")).alias("n_changed"))


@query("SELECT json_error AS error_type, count(*) AS n FROM inference_results WHERE json_error IS NOT NULL AND trim(json_error) <> '' GROUP BY 1")
def error_type_counts(t):
    return t.inference_results.where("trim(json_error) <> ''").groupBy(F.col("json_error").alias("error_type")).agg(F.count("*").alias("n"))


_CONF = "greatest(p, 1 - p)"


@query(f"WITH {LOG} SELECT result_id, round({_CONF}, 6) AS confidence FROM log WHERE {_VALID} AND p IS NOT NULL AND prediction <> ground_truth AND {_CONF} >= 0.8")
def high_conf_errors(t):
    return t.log("ground_truth").where(_VALID + f" and p is not null and prediction <> ground_truth and {_CONF} >= 0.8").select("result_id", F.round(F.expr(_CONF), 6).alias("confidence"))


@query(f"WITH {LOG} SELECT result_id, round({_CONF}, 6) AS confidence FROM log WHERE {_VALID} AND p IS NOT NULL AND prediction = ground_truth AND {_CONF} <= 0.6")
def low_conf_correct(t):
    return t.log("ground_truth").where(_VALID + f" and p is not null and prediction = ground_truth and {_CONF} <= 0.6").select("result_id", F.round(F.expr(_CONF), 6).alias("confidence"))


@query(f"WITH {LOG} SELECT result_id, evaluation_id, sample_index, '' AS human_assigned_error_type, CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS hypothesis FROM log WHERE {_VALID} AND prediction <> ground_truth")
def review_worksheet(t):
    return t.log("ground_truth").where(_VALID + " and prediction <> ground_truth").select("result_id", "evaluation_id", "sample_index", F.lit("").alias("human_assigned_error_type"), F.when(F.col("prediction") == 1, "false_positive").otherwise("false_negative").alias("hypothesis"))


@query("""SELECT evaluation_id, sample_index, run_condition, count(DISTINCT prediction) <= 1 AS same FROM inference_results WHERE evaluation_id IS NOT NULL AND sample_index IS NOT NULL AND run_condition IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL HAVING count(*) > 1""")
def determinism(t):
    """Whether all attempts of a run gave the same prediction."""
    k = ["evaluation_id", "sample_index", "run_condition"]
    g = t.inference_results.dropna(subset=[*k, "prediction"]).groupBy(*k).agg(F.count("*").alias("n"), (F.min("prediction") == F.max("prediction")).alias("same"))
    return g.where("n > 1").drop("n")


_SCORED = f"{_VALID} AND p IS NOT NULL"


@query(f"""WITH {LOG}, s AS (SELECT run_condition, p, count(*) FILTER (ground_truth = 1) AS pos, count(*) FILTER (ground_truth = 0) AS neg FROM log WHERE {_SCORED} GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER (PARTITION BY run_condition ORDER BY p DESC ROWS UNBOUNDED PRECEDING) - pos AS above FROM s),
g AS (SELECT run_condition, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg, sum(neg * above)::BIGINT AS concordant, sum(pos * neg)::BIGINT AS tied FROM c GROUP BY 1)
SELECT *, n_pos * n_neg - concordant - tied AS discordant, round((concordant + tied / 2) / (n_pos * n_neg)::DOUBLE, 6) AS auc FROM g""", name="roc_auc")
def roc_auc_by_condition(t):
    return roc_auc(t.log("ground_truth").where("valid"), ["run_condition"], "p", "ground_truth")


@query(f"""WITH {LOG}, s AS (SELECT run_condition, p, count(*) FILTER (ground_truth = 1) AS pos, count(*) FILTER (ground_truth = 0) AS neg FROM log WHERE {_SCORED} GROUP BY ALL)
SELECT run_condition, p AS score, sum(pos) OVER w::BIGINT AS tp, sum(neg) OVER w::BIGINT AS fp FROM s WINDOW w AS (PARTITION BY run_condition ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve(t):
    c = cumulated(score_table(t.log("ground_truth").where("valid"), ["run_condition"], "p", "ground_truth"), ["run_condition"], "p")
    return c.select("run_condition", F.col("p").alias("score"), "tp", "fp")


@query(f"""WITH {LOG}, s AS (SELECT run_condition, p, count(*) FILTER (ground_truth = 1) AS pos, count(*) FILTER (ground_truth = 0) AS neg FROM log WHERE {_SCORED} GROUP BY ALL),
c AS (SELECT run_condition, pos, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM s WINDOW w AS (PARTITION BY run_condition ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
SELECT run_condition, sum(pos)::BIGINT AS n_pos, round(sum(pos * (tp / (tp + fp)::DOUBLE)) / sum(pos), 6) AS average_precision FROM c GROUP BY 1""")
def avg_precision(t):
    return average_precision(t.log("ground_truth").where("valid"), ["run_condition"], "p", "ground_truth")


@query(f"WITH {LOG} SELECT run_condition, count(*) AS n, round(avg(power(p - ground_truth, 2)), 6) AS brier, round(stddev_samp(power(p - ground_truth, 2)) / sqrt(count(*)), 6) AS brier_se FROM log WHERE {_SCORED} GROUP BY 1")
def brier(t):
    error, n = F.pow(F.col("p") - F.col("ground_truth"), 2), F.count("*")
    return t.log("ground_truth").where(_SCORED).groupBy("run_condition").agg(n.alias("n"), F.round(F.avg(error), 6).alias("brier"), F.round(F.stddev_samp(error) / F.sqrt(n), 6).alias("brier_se"))


@query(f"""WITH {PAIRED} SELECT evaluation_id, sample_index, round(power(p_a - ground_truth, 2), 6) AS error_a, round(power(p_b - ground_truth, 2), 6) AS error_b, round(power(p_b - ground_truth, 2) - power(p_a - ground_truth, 2), 6) AS delta
FROM paired WHERE {_BOTH} AND p_a IS NOT NULL AND p_b IS NOT NULL""")
def brier_rows(t):
    """Squared errors of both runs of each sample, and what the second run changes."""
    a, b = (F.pow(F.col(p) - F.col("ground_truth"), 2) for p in ("p_a", "p_b"))
    return t.paired().where(_BOTH + " and p_a is not null and p_b is not null").select("evaluation_id", "sample_index", F.round(a, 6).alias("error_a"), F.round(b, 6).alias("error_b"), F.round(b - a, 6).alias("delta"))


@query("""WITH x AS (SELECT evaluation_id, attempt, round(avg(power(humor_probability - ground_truth, 2)), 9) AS loss FROM inference_results WHERE humor_probability IS NOT NULL AND NOT isnan(humor_probability) AND ground_truth IS NOT NULL AND evaluation_id IS NOT NULL AND attempt IS NOT NULL GROUP BY ALL)
SELECT evaluation_id, attempt, round(loss, 6) AS loss FROM x QUALIFY row_number() OVER (PARTITION BY evaluation_id ORDER BY x.loss, attempt) = 1""")
def best_epoch(t):
    """Of each run the pass of least loss; the earlier one of equal losses."""
    rows = t.inference_results.where("humor_probability is not null and not isnan(humor_probability) and ground_truth is not null and evaluation_id is not null and attempt is not null")
    loss = rows.groupBy("evaluation_id", "attempt").agg(F.round(F.avg(F.pow(F.col("humor_probability") - F.col("ground_truth"), 2)), 9).alias("loss"))
    return loss.groupBy("evaluation_id").agg(F.min(F.struct("loss", "attempt")).alias("x")).select("evaluation_id", "x.attempt", F.round("x.loss", 6).alias("loss"))


@query(f"""WITH {LOG}, x AS (SELECT run_condition, m, least(floor(p * m), m - 1) AS bin, p, ground_truth FROM log, (VALUES (5), (10)) v(m) WHERE {_SCORED}),
b AS (SELECT run_condition, m, bin, count(*) AS n, abs(avg(p) - avg(ground_truth)) AS gap FROM x GROUP BY ALL)
SELECT run_condition, m::INTEGER AS n_bins, round(sum(n * gap) / sum(n), 6) AS ece FROM b GROUP BY ALL""")
def ece(t):
    """Expected calibration error with 5 and 10 bins of equal width; tenths are counted once, fifths are made of them."""
    df = t.log("ground_truth").where(_SCORED)
    tenths = df.groupBy("run_condition", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b10"), F.least(F.floor(F.col("p") * 5), F.lit(4)).alias("b5")).agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("ground_truth").alias("sg"))
    x = tenths.select("run_condition", "n", "sp", "sg", F.explode(F.array(F.struct(F.lit(5).alias("n_bins"), F.col("b5").alias("bin")), F.struct(F.lit(10).alias("n_bins"), F.col("b10").alias("bin")))).alias("s")).select("*", "s.*")
    g = x.groupBy("run_condition", "n_bins", "bin").agg(F.sum("n").alias("n"), F.abs(F.sum("sp") - F.sum("sg")).alias("gap"))
    return g.groupBy("run_condition", "n_bins").agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))


@query(f"""WITH {PAIRED}, c AS (SELECT evaluation_id, count(*) AS n, count(*) FILTER (pred_a = pred_b) AS agree, sum(pred_a) AS a1, sum(pred_b) AS b1 FROM paired WHERE valid_a AND valid_b GROUP BY 1),
k AS (SELECT *, agree / n::DOUBLE AS po, (a1 * b1 + (n - a1) * (n - b1)) / (n * n)::DOUBLE AS pe FROM c)
SELECT evaluation_id, n, round(po, 6) AS agreement, CASE WHEN pe < 1 THEN round((po - pe) / (1 - pe), 6) ELSE 1.0 END AS kappa FROM k""")
def cohen_kappa(t):
    c = t.paired().where("valid_a and valid_b").groupBy("evaluation_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred_a") == F.col("pred_b")).alias("agree"), F.sum("pred_a").alias("a1"), F.sum("pred_b").alias("b1"))
    n = F.col("n")
    k = c.withColumn("po", F.col("agree") / n).withColumn("pe", (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n))
    return k.select("evaluation_id", "n", F.round("po", 6).alias("agreement"), F.when(F.col("pe") < 1, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6)).otherwise(F.lit(1.0)).alias("kappa"))


@query(f"""WITH {LOG} SELECT evaluation_id, sample_index, max(prediction) FILTER (run_condition = 'general') AS general, max(prediction) FILTER (run_condition = 'cultural') AS cultural, max(prediction) FILTER (run_condition = 'cultural_c') AS cultural_c FROM log WHERE valid GROUP BY ALL""")
def longitudinal_pivot(t):
    return t.log().where("valid").groupBy("evaluation_id", "sample_index").pivot("run_condition", ["general", "cultural", "cultural_c"]).agg(F.max("prediction"))


@query(f"""WITH {LOG}, m AS (SELECT count(DISTINCT (evaluation_id, sample_index)) AS n, avg(inference_duration_s) FILTER (run_condition = 'general') AS tg, avg(inference_duration_s) FILTER (run_condition = 'cultural' AND NOT coalesce(context_passed_to_qwen, false)) AS tf,
  avg(inference_duration_s) FILTER (run_condition = 'cultural' AND coalesce(context_passed_to_qwen, false)) AS ts FROM log)
SELECT share, n, round((n * tg + n * (1 - share) * tf + n * share * ts) / 3600, 3) AS hours FROM m, (VALUES (0.2::DOUBLE), (0.4::DOUBLE), (0.6::DOUBLE)) v(share)""")
def runtime_projection(t):
    """Hours for all samples if a share of them needs the second stage."""
    df = t.log("inference_duration_s", "context_passed_to_qwen")
    ctx, s = F.coalesce("context_passed_to_qwen", F.lit(False)), F.col("inference_duration_s")
    c = F.col("run_condition")
    m = df.agg(F.countDistinct("evaluation_id", "sample_index").alias("n"), F.avg(F.when(c == "general", s)).alias("tg"), F.avg(F.when((c == "cultural") & ~ctx, s)).alias("tf"), F.avg(F.when((c == "cultural") & ctx, s)).alias("ts"))
    m = m.withColumn("share", F.explode(F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6)])))
    return m.select("share", "n", F.round((F.col("n") * F.col("tg") + F.col("n") * (1 - F.col("share")) * F.col("tf") + F.col("n") * F.col("share") * F.col("ts")) / 3600, 3).alias("hours"))
