"""Queries against their SQL on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from quillmark.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")

#: A query of each family; the driver compares all of them.
SOME = ["answer_encoding", "category_tags", "preflight", "paired_alignment", "tfidf_topk", "vector_topk", "hamming_pairs", "quarantine_collisions", "quota_sample", "stratified_split", "kb_build", "threshold_sweep", "roc_auc", "avg_precision", "ece", "cohen_kappa", "macro_weighted_f1", "subset_metrics", "resume_plan", "decision_fusion", "session_window"]


def tidy(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, db, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(tidy(r[c]) for c in cols)) for r in df.collect())
    rel = db.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(repr(tuple(tidy(r[i]) for i in at)) for r in rel.fetchall())


def test_no_cartesian_or_nested_loop_in_hamming(spark):
    plan = QUERIES["hamming_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["dup_text_count"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "image_url" not in plan.split("ReadSchema")[1]
