"""Sources, sinks and the streaming log."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.sources import readers, writers
from quillmark.streaming.log_stream import append, log_stream, once_per_run, windowed_counts


def test_csv_with_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('row_id,image_url,humour,sarcastic,offensive,motivational,overall,ocr,is_humorous,image_filename\n1,u,funny,,,,,"two\nlines ""q""",1,a.jpg\n', encoding="utf-8")
    r = readers.read_csv(spark, str(tmp_path / "a.csv"), readers.CORPUS_SCHEMA).first()
    assert r.ocr == 'two\nlines "q"' and r.is_humorous == 1


def test_json_sources(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    assert readers.read_json_array(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "a.json").write_text('[{"id": "x"}, {"id": "y"}]')
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), schema).count() == 2
    (tmp_path / "m.json").write_text('{"a": "1", "b": "2"}')
    assert {tuple(r) for r in readers.read_json_map(spark, str(tmp_path / "m.json")).collect()} == {("a", "1"), ("b", "2")}
    (tmp_path / "l.jsonl").write_text('{"id": "x"}\n\nnot json\n{"id": "y"\n[1]\n')
    good, bad = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"), schema)
    assert [r.id for r in good.collect()] == ["x"] and bad.count() == 3


def test_images_runs_and_reports(spark, tmp_path):
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "final_report.json").write_text('{"accuracy": 0.5}')
    (tmp_path / "i.jpg").write_bytes(b"\xff\xd8\xff\xe0abc")
    (tmp_path / "j.jpg").write_bytes(b"nothing")
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.readable_images(spark, str(tmp_path)).collect()}
    assert kinds["i.jpg"] == "jpeg" and kinds["j.jpg"] is None
    assert readers.newest_run(spark, str(tmp_path), "final_report.json").endswith("r1")
    r = readers.run_reports(spark, str(tmp_path / "*" / "final_report.json"), T.StructType([T.StructField("accuracy", T.DoubleType())])).first()
    assert (r.experiment_id, r.accuracy) == ("r1", 0.5)


def test_required_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(readers.MissingColumns):
        readers.require(df, {"a", "b"})
    with pytest.raises(readers.MissingColumns):
        readers.read_text_column(df)
    both = spark.createDataFrame([(None, "x"), ("o", "y")], "ocr string, text string")
    assert [r.text for r in readers.read_text_column(both).collect()] == ["x", "o"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", None), (2, "c", "d")], "id int, t string, n string")
    writers.write_lines(df, "t", str(tmp_path / "lines"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["a b", "c"]
    assert json.loads(writers.json_document(df).first().value)["n"] is None
    writers.write_csv(df, str(tmp_path / "csv"), one_file=True)
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).count() == 2
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    writers.replace(df, str(tmp_path / "t"))
    writers.replace(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1 and [p.name for p in tmp_path.glob("t*")] == ["t"]
    m = writers.messages(df.select("id", "t", "n"), "t", "n").first().messages
    assert [x.role for x in m] == ["user", "assistant"]
    runs = spark.createDataFrame([("r", "RUNNING", 1), ("r", "SUCCESS", 2)], "run_id string, status string, at int")
    assert writers.latest_status(runs).first().status == "SUCCESS"


def test_log_stream_takes_each_run_once_and_restarts(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("logged_at", T.TimestampType()), T.StructField("_corrupt_record", T.StringType())])
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "1.json").write_text('{"k": 1, "logged_at": "2025-01-01T00:00:00Z"}\n{"k": 1, "logged_at": "2025-01-01T00:00:05Z"}\nbroken\n')

    def go():
        s = log_stream(spark, src, schema).where("k is not null").select("k", "logged_at")
        append(once_per_run(s, ["k"]), out, ck).awaitTermination()
        return sorted(r.k for r in spark.read.parquet(out).collect())

    assert go() == [1]
    (tmp_path / "src" / "2.json").write_text('{"k": 1, "logged_at": "2025-01-01T00:00:09Z"}\n{"k": 2, "logged_at": "2025-01-01T00:01:00Z"}\n')
    assert go() == [1, 2]


def test_windowed_counts_in_batch(spark):
    e = spark.createDataFrame([("2025-01-01 00:10:00", "view", 1.0), ("2025-01-01 00:50:00", "view", 2.0), ("2025-01-01 01:10:00", "view", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted((r.n, r.total) for r in windowed_counts(e).collect()) == [(1, 4.0), (2, 3.0)]
