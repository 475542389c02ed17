"""Queries that cover the whole of their input, on small tables against brute force."""

import datetime
import difflib
import random
import re

import pytest

from quillmark.catalog import QUERIES
from quillmark.operators import dedup

DAY = datetime.datetime(2024, 1, 1)


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_levenshtein_of_all_scripts(spark, tmp_path):
    texts = ["नमस्ते दुनिया", "वाह क्या बात है", "ভাড়া দাও", "வணக்கம் உலகம்", "caf\xe9 au lait", "plain text\nhere", "😂😂 done", "", None]
    save(spark, tmp_path, "sample_manifest", [(i, t, DAY) for i, t in enumerate(texts)] + [(0, "older", DAY - datetime.timedelta(1))], "sample_index int, ocr_text string, ingested_at timestamp")
    read = [(10 * i + k, i, r) for i, t in enumerate(texts) for k, r in enumerate([t, None, (t or "")[1:], "नमस्ते " + (t or ""), "cafe"])]
    save(spark, tmp_path, "inference_results", read, "result_id long, sample_index int, ocr_text string")
    want = {(n, (d := distance(r, texts[i])), round(1 - d / max(1, len(r), len(texts[i])), 6)) for n, i, r in read if r is not None and texts[i] is not None}
    assert {tuple(x) for x in QUERIES["levenshtein_sim"](spark, str(tmp_path)).collect()} == want


def normal(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", (text or "").lower())).strip()


def near(a, b):
    a, b = normal(a), normal(b)
    return min(len(a), len(b)) >= 15 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.85


def touched(rng, text):
    """The text with about an eighth of its characters changed, so that often no word stays whole."""
    out = list(text)
    for k in range(3, len(out), 8):
        if out[k] != " ":
            out[k] = rng.choice("xyz")
    return "".join(out)


def near_corpus():
    rng = random.Random(4)
    words = "monday meeting mummy papa chai exam वाह क्या बात breaking office sharma ji ka beta".split()
    texts = [" ".join(rng.choice(words) for _ in range(k)) for k in (3, 4, 6, 9, 14, 25, 40, 60) for _ in range(3)]
    texts += [touched(rng, t) for t in texts] + [t[:-2] for t in texts] + [t + " more" for t in texts]
    texts += ["abcdefgh ijklmnop qrstuvwx", "abcdxfgh ijkxmnop qrsxuvwx"]
    return [t.strip() for t in texts] + [texts[0], texts[5], "short", "", None]


@pytest.mark.parametrize("block", [16_000, 20])
def test_fuzzy_pairs_and_dupes_equal_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    texts = near_corpus()
    keys = random.Random(5).sample(range(1000), len(texts))
    save(spark, tmp_path, "sample_manifest", [(k, t, DAY) for k, t in zip(keys, texts)] + [(keys[0], "an older text that is replaced", DAY - datetime.timedelta(1))], "sample_index int, ocr_text string, ingested_at timestamp")
    save(spark, tmp_path, "memes", [(k + 5000, t, DAY) for k, t in zip(keys, texts)], "row_id long, ocr string, ingested_at timestamp")
    save(spark, tmp_path, "benchmark_memes", [(1, texts[9]), (2, texts[14]), (3, "abcdefgh ijklmnop qrstuvwx")], "sample_index int, ocr_text string")
    save(spark, tmp_path, "inference_results", [("bench_001", texts[9] + " q"), ("bench_001", texts[9]), ("other", texts[14])], "meme_id string, ocr_text string")
    rows = sorted((k, t or "") for k, t in zip(keys, texts))
    want = {(k, m) for i, (k, a) in enumerate(rows) for m, b in rows[i + 1 :] if near(a, b)}
    got = QUERIES["fuzzy_pairs"](spark, str(tmp_path)).collect()
    assert sorted((r.cand, r.ref) for r in got if r.field_name == "ocr_text") == sorted(want)
    text = dict(rows)
    assert all(r.ratio == difflib.SequenceMatcher(None, normal(text[r.cand]), normal(text[r.ref])).ratio() for r in got if r.field_name == "ocr_text")
    assert (keys[texts.index("abcdefgh ijklmnop qrstuvwx")], keys[texts.index("abcdxfgh ijkxmnop qrsxuvwx")]) in want | {(b, a) for a, b in want}
    assert len([r for r in got if r.field_name == "reading"]) == 1
    refs = {1: texts[9], 2: texts[14], 3: "abcdefgh ijklmnop qrstuvwx"}
    hits = {(k, n) for k, a in rows for n, b in refs.items() if near(a, b)}
    dupes = QUERIES["fuzzy_dupes"](spark, str(tmp_path)).collect()
    assert sorted((r.cand, r.ref) for r in dupes if r.field_name == "ocr_text") == sorted(hits) and hits
    assert sorted((r.cand - 5000, r.ref) for r in dupes if r.field_name == "ocr") == sorted(hits)
    assert len([r for r in dupes if r.field_name == "reading"]) == 2


def test_quarantine_and_manifest_rules_over_several_samples(spark, tmp_path):
    text = "the landlord wants the rent again on monday"
    one, two = "01" * 32, "0011" * 16
    rows = [
        (50, "m", "a", "f1", "p1", 1, text, "x", "1" * 64), (51, "m", "b", "f2", "p2", 1, text + "s", "y", one), (52, "m", "c", "f3", "p3", 0, "nothing like the others here", "x", two),
        (53, "m", "c", "f3", "p3", 0, "कुछ और ही बात यहाँ लिखी है", "z", one[:-1] + "0"), (54, "n", "c", "bench.png", "p3", 1, "the very bench text of a meme!", "w", "0" * 64),
    ]
    save(spark, tmp_path, "sample_manifest", [(*r, "H1", "humorous" if r[5] else "not", DAY) for r in rows], "sample_index int, manifest_id string, sample_id string, image_filename string, relative_image_path string, ground_truth int, ocr_text string, file_md5 string, ahash_bitstring string, stratum_id string, class_name string, ingested_at timestamp")
    save(spark, tmp_path, "memes", [(1, None, DAY)], "row_id long, ocr string, ingested_at timestamp")
    save(spark, tmp_path, "benchmark_memes", [(3, "bench.png", "the very bench text of a meme")], "sample_index int, image_filename string, ocr_text string")
    save(spark, tmp_path, "inference_results", [("other", None)], "meme_id string, ocr_text string")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in run("quarantine_first_hits")} == {(51, 50, 2), (52, 50, 0)}
    assert {tuple(r) for r in run("exclusion_reasons")} == {("text", 1), ("file", 1)}
    assert sorted(map(str, (tuple(r) for r in run("manifest_errors")))) == sorted(map(str, [
        ("repeated_id", "m", 53, 52), ("repeated_file", "m", 53, 52), ("repeated_path", "m", 53, 52), ("quarantined_file", "n", 54, 3), ("quarantined_text", "n", 54, 3),
        ("quarantined_sample", "m", 51, 50), ("quarantined_sample", "m", 52, 50), ("looks_alike", "m", 51, 53), ("reads_alike", "m", 50, 51), ("not_half_and_half", "n", None, None),
    ]))


def test_manifest_errors_compare_texts_of_samples_only(spark, tmp_path):
    text = "the landlord wants the rent again on monday"
    rows = [(1, "m", "a", "f1", "p1", 1, text, "x", "0" * 64), (2, "m", "b", "f2", "p2", 0, text + "s", "y", "01" * 32)]
    save(spark, tmp_path, "sample_manifest", [(*r, "H1", "humorous" if r[5] else "not", DAY) for r in rows], "sample_index int, manifest_id string, sample_id string, image_filename string, relative_image_path string, ground_truth int, ocr_text string, file_md5 string, ahash_bitstring string, stratum_id string, class_name string, ingested_at timestamp")
    save(spark, tmp_path, "benchmark_memes", [(3, "bench.png", text + "!")], "sample_index int, image_filename string, ocr_text string")
    # neither memes nor runs are there to be read
    got = QUERIES["manifest_errors"](spark, str(tmp_path)).collect()
    assert sorted((r.rule, r.sample_index, r.other) for r in got) == [("quarantined_text", 1, 3), ("quarantined_text", 2, 3), ("reads_alike", 1, 2)]
