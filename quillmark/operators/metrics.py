"""Classification, ranking, calibration and agreement measures over validated predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0.0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(pred: Column, truth: Column) -> list[Column]:
    """tn, fp, fn, tp as aggregates."""
    return [F.count_if((truth == t) & (pred == p)).alias(n) for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]


def rates(df: DataFrame) -> DataFrame:
    """Measures from columns tn, fp, fn, tp; null where there is no row, 0.0 where only a denominator is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    some = lambda c: F.when(n > 0, F.round(c, 6))
    return df.select(
        "*", n.alias("n"), some(ratio(tp + tn, n)).alias("accuracy"), some(ratio(tp, tp + fp)).alias("precision_1"), some(ratio(tp, tp + fn)).alias("recall_1"), some(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1_1"),
        some(ratio(tn, tn + fn)).alias("precision_0"), some(ratio(tn, tn + fp)).alias("recall_0"), some(ratio(2 * tn, 2 * tn + fp + fn)).alias("f1_0"), some((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"),
    )


#: The same measures as SQL over columns tn, fp, fn, tp.
RATES_SQL = """tn + fp + fn + tp AS n,
  CASE WHEN tn+fp+fn+tp > 0 THEN round((tp+tn) / (tn+fp+fn+tp)::DOUBLE, 6) END AS accuracy,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(tp / nullif(tp+fp, 0)::DOUBLE, 0), 6) END AS precision_1,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(tp / nullif(tp+fn, 0)::DOUBLE, 0), 6) END AS recall_1,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(2*tp / nullif(2*tp+fp+fn, 0)::DOUBLE, 0), 6) END AS f1_1,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(tn / nullif(tn+fn, 0)::DOUBLE, 0), 6) END AS precision_0,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(tn / nullif(tn+fp, 0)::DOUBLE, 0), 6) END AS recall_0,
  CASE WHEN tn+fp+fn+tp > 0 THEN round(coalesce(2*tn / nullif(2*tn+fp+fn, 0)::DOUBLE, 0), 6) END AS f1_0,
  CASE WHEN tn+fp+fn+tp > 0 THEN round((coalesce(tp / nullif(tp+fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn+fp, 0)::DOUBLE, 0)) / 2, 6) END AS balanced_accuracy"""
CONFUSION_SQL = "count(*) FILTER ({t} = 0 AND {p} = 0) AS tn, count(*) FILTER ({t} = 0 AND {p} = 1) AS fp, count(*) FILTER ({t} = 1 AND {p} = 0) AS fn, count(*) FILTER ({t} = 1 AND {p} = 1) AS tp"


def score_table(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Distinct scores per key with positives and negatives: ranking measures need no more, however many rows tie."""
    ok = df.where(F.col(score).isNotNull() & F.col(truth).isin(0, 1))
    return ok.groupBy(*keys, score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))


def cumulated(scores: DataFrame, keys: list[str], score: str, ranges: int = 1024) -> DataFrame:
    """score_table with running positives and negatives from the highest score down (tp, fp), summed in ranges of the score first.

    Scores are in [0, 1]; a range, and not a key, is what one task sorts.
    """
    at = F.least(F.floor(F.col(score) * ranges), F.lit(ranges - 1))
    df = scores.withColumn("__range", at)
    above = Window.partitionBy(*keys).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, "__range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("__p"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__n"))
    inside = Window.partitionBy(*keys, "__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.join(sums, [*keys, "__range"])
    return df.select(*keys, score, "pos", "neg", (F.col("__p") + F.sum("pos").over(inside)).alias("tp"), (F.col("__n") + F.sum("neg").over(inside)).alias("fp"))


def roc_auc(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Concordant pairs and half the ties over all pairs; no pair is formed."""
    c = cumulated(score_table(df, keys, score, truth), keys, score)
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos"))).alias("concordant")
    out = c.groupBy(*keys).agg(won, F.sum(F.col("pos") * F.col("neg")).alias("tied"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.round(F.try_divide(F.col("concordant") + F.col("tied") / 2, (F.col("n_pos") * F.col("n_neg")).cast("double")), 6)
    return out.select(*keys, "n_pos", "n_neg", "concordant", "tied", (F.col("n_pos") * F.col("n_neg") - F.col("concordant") - F.col("tied")).alias("discordant"), auc.alias("auc"))


def average_precision(df: DataFrame, keys: list[str], score: str, truth: str) -> DataFrame:
    """Sum over distinct scores of precision times the recall gained there."""
    c = cumulated(score_table(df, keys, score, truth), keys, score)
    gain = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return c.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.round(F.try_divide(gain, F.sum("pos").cast("double")), 6).alias("average_precision"))
