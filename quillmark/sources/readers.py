"""Sources: CSV, JSON, JSONL that tolerates corrupt lines, image files, run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schema of the labelled corpus.
CORPUS_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("image_url", "humour", "sarcastic", "offensive", "motivational", "overall", "ocr")], T.StructField("is_humorous", T.IntegerType()), T.StructField("image_filename", T.StringType())])
#: First bytes of readable images.
MAGIC = {"jpeg": b"\xff\xd8\xff", "png": b"\x89PNG", "gif": b"GIF8", "webp": b"RIFF"}


class MissingColumns(ValueError):
    """A source lacks required columns."""


def require(df: DataFrame, columns: set[str]) -> DataFrame:
    if missing := sorted(columns - set(df.columns)):
        raise MissingColumns(f"missing columns: {missing}")
    return df


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and a declared schema; a missing path raises."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(at)
    return found is not None and len(found) > 0


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array of records; a missing file gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of strings as rows (key, value)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, corrupt lines) of JSONL files; blank lines are neither. Both are taken from the text itself."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # a line that isn't a JSON object has no variant
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    good = lines.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")
    return good, lines.where(~ok).select(F.col("value").alias("line"))


def readable_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length, kind) of files; kind is null where the first bytes are of no known image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        kind = F.when(F.substring(F.col("content"), 1, len(magic)) == F.lit(bytearray(magic)), name).otherwise(kind)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", kind.alias("kind"))


def newest_run(spark: SparkSession, path: str, marker: str) -> str | None:
    """The folder of the newest file of that name under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", marker).load(path).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row.p.rsplit("/", 1)[0] if row and row.p else None


def run_reports(spark: SparkSession, glob: str, schema: T.StructType) -> DataFrame:
    """Reports of runs with the experiment's id from the folder that holds them."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob)
    return df.withColumn("experiment_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_text_column(df: DataFrame) -> DataFrame:
    """df with `text` from the first of ocr, text and OCR_text that it has."""
    names = [c for c in ("ocr", "text", "OCR_text") if c in df.columns]
    if not names:
        raise MissingColumns("none of ocr, text, OCR_text")
    return df.withColumn("text", F.coalesce(*[F.col(c) for c in names]))
