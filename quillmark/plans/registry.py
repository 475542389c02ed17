"""Registry of queries: each name has a DataFrame plan and, where SQL can express it, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Common table expressions that the SQL of many queries starts with.
CORPUS = "corpus AS (SELECT * FROM memes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at DESC) = 1)"
LOG = """log AS (
  SELECT *, CASE WHEN isnan(humor_probability) THEN NULL ELSE humor_probability END AS p, CASE WHEN isnan(non_humor_probability) THEN NULL ELSE non_humor_probability END AS q,
    coalesce(timed_out, false) AS late, coalesce(coalesce(timed_out, false) = false AND json_error IS NULL AND prediction IN (0, 1), false) AS valid
  FROM inference_results WHERE evaluation_id IS NOT NULL AND sample_index IS NOT NULL AND run_condition IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY evaluation_id, sample_index, run_condition ORDER BY attempt DESC, result_id DESC) = 1
)"""
PAIRED = LOG + """, a AS (SELECT * FROM log WHERE run_condition = 'general'), b AS (SELECT * FROM log WHERE run_condition = 'cultural'),
paired AS (
  SELECT evaluation_id, sample_index, coalesce(a.ground_truth, b.ground_truth) AS ground_truth, a.prediction AS pred_a, b.prediction AS pred_b, a.p AS p_a, b.p AS p_b, coalesce(a.valid, false) AS valid_a, coalesce(b.valid, false) AS valid_b,
    a.inference_duration_s AS s_a, b.inference_duration_s AS s_b, b.drishtikon_matches_count AS matches, b.cultural_sources AS sources, b.retrieved_context AS context, coalesce(a.late, false) AS late_a, coalesce(b.late, false) AS late_b
  FROM a FULL JOIN b USING (evaluation_id, sample_index)
)"""


class Tables:
    """Tables of one folder, and the views most queries start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def corpus(self, *columns: str) -> DataFrame:
        """The newest delivery of every meme, with the named columns only."""
        from ..operators.log import last_wins

        return last_wins(self.memes.select("row_id", "ingested_at", *columns), ["row_id"], ["ingested_at"]).drop("ingested_at")

    def log(self, *columns: str) -> DataFrame:
        """The last attempt of every (evaluation_id, sample_index, run_condition), with probabilities p, q (NaN as null), late and valid."""
        from ..operators.log import last_wins, valid_mask

        keys = ["evaluation_id", "sample_index", "run_condition"]
        need = ["attempt", "result_id", "humor_probability", "non_humor_probability", "timed_out", "json_error", "prediction"]
        rows = self.inference_results.select(*dict.fromkeys([*keys, *need, *columns]))
        rows = last_wins(rows, keys, ["attempt", "result_id"])
        nan = lambda c: F.when(~F.isnan(c), F.col(c))
        return rows.withColumn("p", nan("humor_probability")).withColumn("q", nan("non_humor_probability")).withColumn("late", F.coalesce("timed_out", F.lit(False))).withColumn("valid", valid_mask())

    def samples(self, *columns: str) -> DataFrame:
        """The newest delivery of every sample, with the named columns only."""
        from ..operators.log import last_wins

        rows = self.sample_manifest.select(*dict.fromkeys(["sample_index", "ingested_at", *columns])).dropna(subset=["sample_index"])
        return last_wins(rows, ["sample_index"], ["ingested_at"]).drop("ingested_at")

    def paired(self, *columns: str) -> DataFrame:
        """Both runs of every sample that has one: general (a) and cultural (b), nulls and invalid where a run is missing; one pass over the log, no join."""
        log = self.log("ground_truth", "inference_duration_s", "drishtikon_matches_count", "cultural_sources", "retrieved_context")
        fields = F.struct("ground_truth", "prediction", "p", "valid", "late", "inference_duration_s", "drishtikon_matches_count", "cultural_sources", "retrieved_context")
        both = log.groupBy("evaluation_id", "sample_index").agg(F.max(F.when(F.col("run_condition") == "general", F.struct("result_id", fields.alias("v")))).alias("a"), F.max(F.when(F.col("run_condition") == "cultural", F.struct("result_id", fields.alias("v")))).alias("b"))
        both = both.where("a is not null or b is not null")
        return both.select(
            "evaluation_id", "sample_index", F.coalesce("a.v.ground_truth", "b.v.ground_truth").alias("ground_truth"), F.col("a.v.prediction").alias("pred_a"), F.col("b.v.prediction").alias("pred_b"), F.col("a.v.p").alias("p_a"), F.col("b.v.p").alias("p_b"),
            F.coalesce("a.v.valid", F.lit(False)).alias("valid_a"), F.coalesce("b.v.valid", F.lit(False)).alias("valid_b"), F.col("a.v.inference_duration_s").alias("s_a"), F.col("b.v.inference_duration_s").alias("s_b"), F.col("b.v.drishtikon_matches_count").alias("matches"),
            F.col("b.v.cultural_sources").alias("sources"), F.col("b.v.retrieved_context").alias("context"), F.coalesce("a.v.late", F.lit(False)).alias("late_a"), F.coalesce("b.v.late", F.lit(False)).alias("late_b"),
        )


def query(sql: str | None = None, name: str | None = None):
    """Register f(Tables) -> DataFrame under its name (or the given one), with the SQL over the same tables."""

    def register(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register
