"""Append-only logs: newest rows, validity, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns; rows with a null key are dropped.

    A partial aggregate (max_by) and not a window: hot keys are combined before the shuffle.
    """
    df = df.dropna(subset=keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def valid_mask() -> Column:
    """A prediction counts if the run did not time out, the answer parsed and the class is 0 or 1."""
    return F.coalesce((~F.coalesce("timed_out", F.lit(False))) & F.col("json_error").isNull() & F.col("prediction").isin(0, 1), F.lit(False))


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that no completed row covers."""
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def planned(samples: DataFrame, conditions: list[str]) -> DataFrame:
    """Samples times conditions: an explode of a literal array, not a join."""
    return samples.withColumn("run_condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
