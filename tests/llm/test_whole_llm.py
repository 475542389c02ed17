"""Operators of the subpackage that cover the whole of their input."""

import datetime
import itertools

import numpy as np
import pytest

from quillmark.llm import langid, neardup, queries

DAY = datetime.datetime(2024, 1, 1)


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_forms_of_memes_and_of_results(spark, tmp_path):
    save(spark, tmp_path, "memes", [(1, "cafe\u0301", DAY), (2, None, DAY)], "row_id long, ocr string, ingested_at timestamp")
    save(spark, tmp_path, "inference_results", [(1, "caf\u00e9"), (2, "cafe\u0301 x"), (3, None), (4, "")], "result_id long, ocr_text string")
    got = {(r.field_name, r.key): r.canon for r in queries.p7_forms(spark, str(tmp_path)).collect()}
    assert got == {("ocr", 1): "caf\u00e9", ("ocr", 2): None, ("ocr_text", 1): "caf\u00e9", ("ocr_text", 2): "caf\u00e9 x", ("ocr_text", 3): None, ("ocr_text", 4): ""}


NEAR = {"hi": "mr", "mr": "hi"}


def lines_of(langs, each=3):
    """Lines of clear likelihoods in turn; Hindi and Marathi are nearly alike."""
    rng = np.random.default_rng(1)
    rows = []
    for k, lang in enumerate(langs * each):
        like = rng.uniform(-40, -38, len(langid.LANGS))
        like[langid.LANGS.index(lang)] = 0.0
        if lang in NEAR:
            like[langid.LANGS.index(NEAR[lang])] = -8.0
        rows.append((k, like, 10))
    return rows


@pytest.mark.parametrize("langs", [["en", "hi", "bn", "ta"], ["en", "hi", "bn", "ta", "ur"], ["hi", "mr", "en", "ta", "zh"], list(langid.LANGS)])
def test_lines_of_many_languages_get_their_own(langs):
    model = langid.Model(np.ones((len(langid.LANGS), langid.BUCKETS)))
    rows = lines_of(langs)
    pi, got = model.infer(rows)
    assert [langid.LANGS[j] for _, j, *_ in got] == langs * 3
    assert {langid.LANGS[j] for j in pi} == set(langs)


def test_language_set_is_the_best_of_all():
    rng = np.random.default_rng(2)
    model = langid.Model(np.ones((len(langid.LANGS), langid.BUCKETS)))
    for _ in range(40):
        like = rng.uniform(-12, 0, (rng.integers(1, 9), len(langid.LANGS)))
        n = np.full(len(like), 4.0)
        first = int(like.sum(axis=0).argmax())
        gain = np.maximum(0.0, like - like[:, [first]]).sum(axis=0)
        fits = [first, *[j for j in range(len(langid.LANGS)) if j != first and gain[j] > langid.PENALTY]]
        every = [c for k in range(1, len(fits) + 1) for c in itertools.combinations(fits, k)]
        want = max(every, key=lambda c: model._em(like[:, c], n)[2] - langid.PENALTY * len(c))
        assert set(model.infer([(i, x, 4) for i, x in enumerate(like)])[0]) == set(want)


def test_components_of_long_chains(spark):
    rows = [("f", i, i + 1) for i in range(1, 60)] + [("f", 100, 102), ("f", 102, 101), ("g", 59, 101)]
    got = {(r.s, r.u): r.root for r in neardup.components(spark.createDataFrame(rows, "s string, u long, v long"), "s").collect()}
    assert got == {("f", i): 1 for i in range(1, 61)} | {("f", i): 100 for i in (100, 101, 102)} | {("g", 59): 59, ("g", 101): 59}


def test_every_record_has_a_group(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    chain = [" ".join(words[k : k + 12]) for k in range(0, 20, 2)]  # neighbours are near, ends are not
    memes = [(i + 10, t, DAY) for i, t in enumerate(chain)] + [(1, "short text", DAY), (2, None, DAY), (3, chain[9], DAY), (3, "short text", DAY - datetime.timedelta(1))]
    save(spark, tmp_path, "memes", memes, "row_id long, ocr string, ingested_at timestamp")
    save(spark, tmp_path, "sample_manifest", [(5, chain[0], DAY), (6, chain[2], DAY), (7, chain[0], DAY)], "sample_index int, ocr_text string, ingested_at timestamp")
    got = {(r.field_name, r.key): (r.group_id, r.n_links) for r in queries.p3_groups(spark, str(tmp_path)).collect()}
    want = {("ocr", i + 10): (3, 1 if i in (0, 9) else 2) for i in range(10)} | {("ocr", 1): (1, 0), ("ocr", 2): (2, 0), ("ocr", 3): (3, 1)}
    assert got == want | {("ocr_text", 5): (5, 0), ("ocr_text", 6): (6, 0), ("ocr_text", 7): (5, 0)}
