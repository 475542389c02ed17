"""Deterministic sampling and splitting by hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = "42"


def order_key(key: str, salt: str = ""):
    """A reproducible shuffle order that SQL can repeat."""
    return F.md5(F.concat(F.lit(f"{SEED}|{salt}|"), F.col(key).cast("string")))


def dense_ids(df: DataFrame, key: str, width: int = 4096, out: str = "id") -> DataFrame:
    """Number rows 0, 1, ... in the order of a unique integer key without sorting all rows in one task."""
    df = df.withColumn("__range", F.floor(F.col(key) / F.lit(width)))
    sizes = df.groupBy("__range").agg(F.count("*").alias("c"))
    sizes = sizes.select("__range", F.coalesce(F.sum("c").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return df.withColumn("n", inside).join(sizes, "__range").withColumn(out, F.col("base") + F.col("n")).drop("__range", "n", "base")


def ranked(df: DataFrame, keys: list[str], order: str, prefix: int = 2) -> DataFrame:
    """df with `place`: the rank (from 1) within keys by a hexadecimal hash column; ranks are summed per prefix of the hash, so a hot key is spread over 16^prefix tasks."""
    df = df.withColumn("__p", F.substring(order, 1, prefix))
    sizes = df.groupBy(*keys, "__p").agg(F.count("*").alias("c"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "__p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy(*keys)).alias("total"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(order))
    return df.withColumn("n", inside).join(sizes, [*keys, "__p"]).withColumn("place", F.col("base") + F.col("n")).drop("__p", "n", "base")
