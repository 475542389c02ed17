"""Text and record functions on adversarial fixtures."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.functions import records as R
from quillmark.functions import text as X


def values(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


SANITIZED = [
    ("on 26th January (10), 2,000 x 2000. rule no. 5", "on 26th January ( ), 2,000 x 2000. rule no. 5"),
    ("a 5 section 7 may 9", "a section 7 may"),
    ("144, 12,34 1,000,000", "144, ,"),
    ("POV: You forgot to study", "You forgot to study"),
    ("Celebrations on 15 August 2026", "Celebrations on 15 August"),
    ("Filed under Dhara 420 for fraud", "Filed under Dhara 420 for fraud"),
    ("  ", ""), (None, ""), ("", ""),
]


def test_sanitize(spark):
    assert values(spark, X.sanitize, [a for a, _ in SANITIZED]) == [b for _, b in SANITIZED]


def test_sanitize_is_idempotent_on_fixtures(spark):
    once = values(spark, X.sanitize, [a for a, _ in SANITIZED])
    assert values(spark, X.sanitize, once) == once


def test_normalize_splits_at_vowel_signs_and_keeps_ties(spark):
    assert values(spark, X.normalize, ["A, b!  c", "कि", None, "", "x" * 100_000]) == ["a b c", "क", "", "", "x" * 100_000]


def test_categories(spark):
    got = values(spark, X.categories, ["my BOSS and the wicket", "bossy", None, " ", "फिल्मी"])
    assert got == [["cricket", "workplace"], ["none"], ["none"], ["none"], ["Bollywood"]]


def test_terms_form_bigrams_after_stop_words(spark):
    assert values(spark, lambda c: X.terms(c, X.STOPWORDS), ["the cat of delhi", "cat", None]) == [["cat", "delhi", "cat delhi"], ["cat"], []]


ANSWERS = [
    ('{"humorous": true, "reason": "a"}', "direct", True, "a"),
    ('say ```json\n{"humorous": "false", "reason": "b"}\n``` end', "fenced", False, "b"),
    ('Sure! {"humorous": 1, "reason": "c"} bye', "balanced", True, "c"),
    ("{'humorous': True, 'reason': 'd',}", "cleaned", True, "d"),
    ('{"humorous": true, "reason": "cut of', "recovered", True, "cut of"),
    ("plain text", "failed", None, None),
    ("{}", "failed", None, None),
    ("", "failed", None, None),
    (None, "failed", None, None),
    ('{"humorous": "maybe", "reason": "e"}', "direct", None, "e"),
]


def test_repair(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ANSWERS)], "i int, t string")
    f, how = R.repaired(F.col("t"))
    rows = df.select("i", f.alias("f"), how.alias("how")).select("i", "how", R.truth(F.col("f.humorous")).alias("h"), F.col("f.reason").alias("r")).orderBy("i").collect()
    assert [(r.how, r.h, r.r) for r in rows] == [a[1:] for a in ANSWERS]


def test_fusion_prefers_probabilities_and_is_null_after_timeouts(spark):
    df = spark.createDataFrame([(0.7, 0.3, False, False), (None, None, True, False), (0.9, 0.1, True, True)], "p double, q double, text boolean, late boolean")
    h, c, m = R.fused(F.col("p"), F.col("q"), F.col("text"), F.col("late"))
    assert [tuple(r) for r in df.select(h, c, m).collect()] == [(True, 0.7, "probability"), (True, None, "text"), (None, None, "unavailable")]


def test_routes(spark):
    rows = [(False, True, "notes", False), (True, True, " ", False), (True, False, "notes", True), (True, True, "notes", None), (None, False, None, None), (True, True, R.NO_CONTEXT, False)]
    df = spark.createDataFrame(rows, "h boolean, c boolean, x string, f boolean")
    got = [r[0] for r in df.select(R.route(F.col("h"), F.col("c"), F.col("x"), F.col("f"))).collect()]
    assert got == ["stage2", "reuse_stage1", "stage2_fallback", "stage2", "short_circuit_nonhumor", "reuse_stage1"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_is_idempotent(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    once = values(spark, X.normalize, texts)
    assert values(spark, X.normalize, once) == once


@pytest.mark.parametrize("value,bucket", [("HIGH risk", "High"), ("medium", "Medium"), ("none", "Low"), (None, "Not analyzed"), ("odd", "Odd")])
def test_dependency(spark, value, bucket):
    assert values(spark, R.dependency, [value]) == [bucket]
