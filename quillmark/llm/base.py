"""What the operators of this subpackage share: reading tables, newest deliveries, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by spark.checkpoint.dir.

    Where it is unset, a session with a local master (as in tests) gets a temporary folder; any other is refused, since
    its executors would each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillmark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage and survives lost executors.

    The table is removed by drop(), or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables made by written() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def newest(df: DataFrame, keys: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per key: the one delivered last; rows with a null key are left out. Ties are broken by the whole row's hash."""
    df = df.dropna(subset=keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in rest])))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, spread over the cluster's cores before work in Python if it has fewer partitions than those; a wide scan stays as it is, so large tables are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)
