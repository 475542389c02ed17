"""Sinks: CSV, JSONL, one JSON document, lines, staged replacement, append-only logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; one file for small reports only."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One line per row, line breaks within a value as blanks."""
    df.select(F.regexp_replace(column, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def json_document(df: DataFrame) -> DataFrame:
    """Rows as JSON texts, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def append_log(df: DataFrame, path: str) -> None:
    """Append rows as new JSONL files; the commit protocol makes them appear whole."""
    df.write.mode("append").json(path)


def replace(df: DataFrame, path: str) -> None:
    """Replace a table: written beside it, then renamed; readers see the old or the new one. A failed write leaves the old one."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    staging, old = jpath(f"{path}.{uuid.uuid4().hex}"), jpath(f"{path}.{uuid.uuid4().hex}.old")
    fs = staging.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        df.write.parquet(staging.toString())
        there = fs.exists(jpath(path))
        if there and not fs.rename(jpath(path), old):
            raise OSError(f"{path} cannot be moved aside")
        if not fs.rename(staging, jpath(path)):
            if there and not fs.rename(old, jpath(path)):
                raise OSError(f"{path} cannot be replaced; its old rows are in {old}")
            raise OSError(f"{path} cannot be replaced")
        if there:
            fs.delete(old, True)
    finally:
        fs.delete(staging, True)


def messages(df: DataFrame, user: str, assistant: str) -> DataFrame:
    """Chat records: messages as an array of (role, content)."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return df.withColumn("messages", F.array(turn("user", user), turn("assistant", assistant))).drop(user, assistant)


def latest_status(runs: DataFrame) -> DataFrame:
    """Newest status of each run of an append-only run table (run_id, status, at)."""
    return runs.groupBy("run_id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
