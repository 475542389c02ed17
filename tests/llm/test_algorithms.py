"""Draws, near duplicates, overlaps and mixing against brute force."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import draw, mixing, neardup, overlap


def bag_alike(a, b, near=0.82):
    x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    n, m = sum(x.values()), sum(y.values())
    return min(n, m) >= 8 and 2 * sum((x & y).values()) >= near * (n + m) - 1e-9


def edited(rng, text, vocab):
    w = text.split()
    for _ in range(rng.randint(0, max(1, len(w) // 4))):
        k, i = rng.randint(0, 3), rng.randrange(len(w))
        if k == 0 and len(w) > 3:
            w.pop(i)
        elif k == 1:
            w.insert(i, rng.choice(vocab))
        elif k == 2:
            w[i] = rng.choice(vocab)
        else:
            j = rng.randrange(len(w))
            w[i], w[j] = w[j], w[i]
    return " ".join(w)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["the", "of", "a", "is"] * 15
    texts = []
    for _ in range(n):
        t = " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 9, 12, 20, 35, 60, 90])))
        texts += [t, edited(rng, t, vocab), edited(rng, t, vocab)]
    return texts + [texts[0], texts[0].upper(), "short text", "", None, "the " * 3000, "the " * 2990]


def test_near_pairs_equal_brute_force(spark):
    texts = corpus(1)
    rows = [("f", i, t, 1) for i, t in enumerate(texts)] + [("g", i, t, 1) for i, t in enumerate(texts[:40])] + [("f", 0, texts[0], 2)]
    df = spark.createDataFrame(rows, "field_name string, key long, text string, ingested_at int").withColumn("doc", F.lit(1)).withColumn("hash", F.lit("h"))
    got = {(r.field_name, r.key_a, r.key_b) for r in neardup.near_pairs(df.select("field_name", "key", "text", "ingested_at", "doc", "hash").drop("doc", "hash")).collect()}
    want = {(f, i, j) for f, ts in (("f", texts), ("g", texts[:40])) for i, a in enumerate(ts) for j, b in enumerate(ts) if i < j and a and b and bag_alike(a, b)}
    assert want and got == want


def test_no_documents(spark):
    df = spark.createDataFrame([("f", 1, None, 1), ("f", 2, "few words", 1)], "field_name string, key long, text string, ingested_at int")
    assert neardup.near_pairs(df).count() == 0


def test_thresholds_add_up():
    s = neardup.Scheme(0.82, np.ones(neardup.HISTOGRAM), 100, {})
    rng = np.random.default_rng(0)
    ids = np.arange(50)
    n = rng.integers(8, 120, 50)
    off = np.r_[0, np.cumsum(n)]
    rows = list(s.signatures(ids, off, rng.integers(0, 1 << 40, off[-1]).astype(np.uint64)))
    assert {r for r, *_ in rows} == {0, 1}
    for k in range(6):
        assert 2 * s.parts(k) >= int(0.36 * (s.bounds[k + 1] - 1)) + 1


def test_cross_split_equals_brute_force(spark):
    texts = corpus(2, 40)
    rng = random.Random(3)
    splits = [rng.choice(["train", "train", "test", "validation"]) for _ in texts]
    names = [None if i % 3 else f"folder/Img_{i // 6}.JPG" if i % 2 else f"https://x.example/a/img%5F{i // 6}.png?w=6" for i in range(len(texts))]
    rows = [(i, t, n, s, 1) for i, (t, n, s) in enumerate(zip(texts, names, splits))] + [(900, texts[0], " ", None, 1)]
    df = spark.createDataFrame(rows, "row_id long, ocr string, image_filename string, split string, ingested_at int")
    got = {(min(r.train_id, r.other_id), max(r.train_id, r.other_id)): (r.by_text, r.by_name) for r in overlap.cross_split(df).collect()}
    key = lambda n: n and re.sub(r"%5f", "_", re.sub(r"\?.*", "", n).rsplit("/", 1)[-1].lower()).rsplit(".", 1)[0]
    want = {}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if (splits[i] == "train") != (splits[j] == "train"):
                t = bool(texts[i] and texts[j] and bag_alike(texts[i], texts[j]))
                n = bool(names[i] and key(names[i]) == key(names[j]))
                if t or n:
                    want[i, j] = (t, n)
    assert any(t for t, _ in want.values()) and any(n for _, n in want.values()) and got == want
    covered = {r.row_id: (r.n_texts, r.coverage) for r in overlap.covered_records(df).collect()}
    assert set(covered) == {i for pair, (t, _) in want.items() if t for i in pair if splits[i] != "train"}
    assert all(0 < c <= 1 for _, c in covered.values())


def test_frequent_words_are_split(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT", 8)
    texts = corpus(7, 15)
    df = spark.createDataFrame([(i, t, None, "train" if i % 2 else "test", 1) for i, t in enumerate(texts)], "row_id long, ocr string, image_filename string, split string, ingested_at int")
    got = {(r.train_id, r.other_id) for r in overlap.cross_split(df).collect()}
    assert got == {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i % 2 and not j % 2 and a and b and bag_alike(a, b)}


def test_hot_signatures_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "COUNTED", 1)
    base = [f"w{i}" for i in range(12)]
    texts = [" ".join([*base, f"x{i}"]) for i in range(40)]
    df = spark.createDataFrame([("f", i, t, 1) for i, t in enumerate(texts)], "field_name string, key long, text string, ingested_at int")
    assert neardup.near_pairs(df).count() == 40 * 39 // 2


def test_allocation_of_a_very_long_text():
    s = neardup.Scheme(0.82, np.ones(neardup.HISTOGRAM), 100, {})
    n = 6000
    rows = list(s.signatures(np.array([0]), np.array([0, n]), np.random.default_rng(1).integers(0, 1 << 40, n).astype(np.uint64)))
    assert {r for r, *_ in rows} == {0, 1}


def test_passages_outnumber_differences():
    for s in range(8, 200):
        for rare in (0, 3, s):
            counts = np.r_[np.ones(rare), np.full(s - rare, 1000)][:s]
            cut = overlap.passages(np.arange(s), counts)
            most = int(0.18 * (s + int(s * 1.18 / 0.82 + 1e-9)) + 1e-9)
            assert len(cut) >= most + 1 and all(a < z for a, z in cut)
            assert all(z == a2 for (_, z), (a2, _) in zip(cut, cut[1:]))


MANIFEST = "manifest_id string, sample_id string, stratum_id string, ground_truth int"
TARGETS = "manifest_id string, stratum_id string, ground_truth int, target_share double, min_count int, draw_size int"


def test_draw(spark, monkeypatch):
    monkeypatch.setattr(draw, "GROUP", 64)
    rows = [("m", f"s{i}", ["H1", "h_1", "Ｈ１"][i % 3], 1) for i in range(500)] + [("m", f"t{i}", "NH-2", 0) for i in range(30)] + [("m", "s0", "H1", 1), ("m", None, "H1", 1), ("m", "u", None, 1), ("m", "v", "H1", None), ("m", "w", "H9", 1), ("n", "x", "H1", 1)]
    targets = [("m", "H1", 1, 0.5, 0, 81), ("m", "NH2", 0, 0.4, 3, 81), ("m", "H3", 1, 0.1, 2, 81), ("n", "H1", 1, 1.0, 0, 1)]
    df = spark.createDataFrame(rows, MANIFEST).withColumn("cell", F.lit(0)).withColumn("pi", F.lit("x"))
    taken, report = draw.draw(df, spark.createDataFrame(targets, TARGETS))
    got = {(r.manifest_id, r.stratum_id): (r.needed, r.pool, r.drawn, r.shortfall, r.residual) for r in report.collect()}
    n = got["m", "H1"][2]
    assert n in (40, 41) and got == {("m", "H1"): (41, 500, n, 0, n - 40.5), ("m", "NH2"): (32, 30, 30, 2, 0), ("m", "H3"): (8, 0, 0, 8, 0), ("n", "H1"): (1, 1, 1, 0, 0)}
    drawn = taken.collect()
    assert len(drawn) == len(set(drawn)) == n + 31
    none, empty = draw.draw(df.limit(0), spark.createDataFrame(targets, TARGETS))
    assert none.count() == 0 and {r.drawn for r in empty.collect()} == {0}


def test_flight_keeps_sums_and_probabilities():
    rng = np.random.default_rng(5)
    cell = np.repeat([0, 1, 2], 40)
    pi = np.repeat([0.25, 0.1, 0.5], 40)
    marks = (cell[:, None] == np.arange(3)).astype(float)
    for fly in (lambda: draw.fly_cells(pi, cell, rng), lambda: draw.fly(pi, marks, rng)):
        total = np.zeros(120)
        for _ in range(300):
            out = fly()
            assert [round(out[cell == c].sum(), 6) for c in range(3)] == [10, 4, 20]
            total += out
        assert abs(total / 300 - pi).max() < 0.13


def test_landing_rounds_cells_in_step():
    rng = np.random.default_rng(6)
    # one open candidate in each of 10 strata x 2 truths; margins are 1 and 10 (0.5 + 0.5; 10 x 0.5 twice)
    stratum, truth, pi = np.repeat(np.arange(10), 2), np.tile([0, 1], 10), np.full(20, 0.5)
    total = np.zeros(20)
    for _ in range(400):
        out = draw.land(pi, stratum, truth, rng)
        assert set(out) == {0.0, 1.0} and all(out[stratum == k].sum() == 1 for k in range(10)) and out[truth == 0].sum() == 5
        total += out
    assert abs(total / 400 - 0.5).max() < 0.13
    # margins that are no whole numbers are missed by less than one, and so is the sum
    pi = rng.uniform(0.05, 0.95, 20)
    for _ in range(50):
        out = draw.land(pi, stratum, truth, rng)
        assert abs(out.sum() - pi.sum()) < 1 and set(out) <= {0.0, 1.0}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(4)
    docs = [(i, ["big", "BIG ", "small", None, "odd"][i % 5], rng.randint(0, 20)) for i in range(2000)]
    sizes = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long").withColumn("source_key", mixing.source_key(F.col("source"))).drop("source")
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "small", 0.5, 1), ("k", "big", 0.9, 3), ("k", "gone", 0.1, 9)], "mix_id string, source_name string, target_weight double, max_uses int")
    schedule, report = mixing.mix(sizes, targets)
    r = {(x.mix_id, x.source_name): x for x in report.collect()}
    total = sum(n for *_, n in docs)
    tokens = {s: sum(n for _, k, n in docs if k and k.strip().lower() == s) for s in ("big", "small")}
    assert {k: x.short for k, x in r.items()} == {("m", "big"): False, ("m", "small"): tokens["small"] < 0.5 * total, ("k", "big"): False, ("k", "gone"): True}
    assert r["m", "small"].reached_tokens == tokens["small"]
    assert abs(r["k", "big"].reached_tokens - 0.9 * total) < 0.05 * total
    uses = schedule.groupBy("mix_id", "source_name", "doc_id").count().groupBy("mix_id", "source_name").agg(F.max("count").alias("n")).collect()
    assert {(u.mix_id, u.source_name): u.n for u in uses} == {("m", "big"): 2, ("m", "small"): 1, ("k", "big"): 3}
    assert mixing.mix(sizes.limit(0), targets)[0].count() == 0


def test_runs_are_known_wherever_they_stand():
    one, other = np.array([5, 7, 11, 13, 17], np.int64), np.array([3, 7, 11, 13, 19, 23], np.int64)
    of = lambda tok, a, z: int(overlap.runs(overlap.sums(tok), np.array([a]), np.array([z]))[0])
    assert of(one, 1, 4) == of(other, 1, 4) and of(one, 2, 4) == of(other, 2, 4)
    places = [(a, z) for a in range(5) for z in range(a + 1, 6)]
    assert len({of(one, a, z) for a, z in places}) == len(places)
    run = np.array([9, 9, 9], np.uint64)
    keys = overlap.salted(run, np.array([0, 1, 2]))
    assert keys[0] == 9 and len(set(keys.tolist())) == 3


def test_only_texts_of_different_sides_become_candidates(spark, monkeypatch):
    docs = neardup.documents_of(neardup.with_words(spark.createDataFrame([(i, t, 1) for i, t in enumerate(corpus(9, 40))], "key long, text string, ingested_at int"), "text"), ["key"])[1]
    sided = neardup.written(docs.withColumn("side", F.expr("cast(1 + doc % 3 as int)")), "sided")
    side, counts = {r.doc: r.side for r in sided.collect()}, neardup.histogram(docs)
    links = {(r.a, r.b) for r in neardup.near_links(docs).collect()}
    for few in (0, 4, 1 << 12):
        monkeypatch.setattr(neardup, "FEW", few)
        assert {(r.a, r.b) for r in neardup.near_links(docs).collect()} == links
        got = {(r.a, r.b) for r in neardup.near_candidates(sided, counts).collect()}
        assert {p for p in links if side[p[0]] | side[p[1]] == 3} <= got and all(side[a] | side[b] == 3 for a, b in got)


def test_frequent_runs_make_no_candidates(spark):
    # every text of one side shares short runs of frequent words with most of the other side
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.sample(vocab, 30)), 1) for i in range(400)]
    docs = neardup.documents_of(neardup.with_words(spark.createDataFrame(rows, "key long, text string, ingested_at int"), "text"), ["key"])[1]
    sided = neardup.written(docs.withColumn("side", F.expr("cast(1 + pmod(hash(doc), 2) as int)")), "sided")
    assert neardup.near_candidates(sided, neardup.histogram(sided)).count() < 400
