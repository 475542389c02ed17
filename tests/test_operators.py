"""Operators against brute force and golden statistics."""

import difflib
import itertools
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillmark.operators import dedup, log, metrics, sampling
from quillmark.operators.model_seam import infer, mock

# (truth, p of run a, p of run b): eleven published rows.
ROWS = [(1, 0.8354, 0.7309), (0, 0.7279, 0.5272), (0, 0.2146, 0.2146), (1, 0.8856, 0.8856), (1, 0.7879, 0.5812), (1, 0.6653, 0.6653), (0, 0.8175, 0.8175), (1, 0.4609, 0.4686), (0, 0.8991, 0.8991), (0, 0.5888, 0.5888), (0, 0.5659, 0.5659)]


def golden(spark):
    return spark.createDataFrame([(run, g, p) for g, a, b in ROWS for run, p in (("general", a), ("cultural", b))], "run string, g int, p double")


def test_auc_and_average_precision_match_published_values(spark):
    auc = {r.run: r for r in metrics.roc_auc(golden(spark), ["run"], "p", "g").collect()}
    assert round(auc["general"].auc, 4) == 0.6 and round(auc["cultural"].auc, 4) == 0.5667
    assert auc["general"].concordant == 18
    ap = {r.run: round(r.average_precision, 4) for r in metrics.average_precision(golden(spark), ["run"], "p", "g").collect()}
    assert ap == {"general": 0.5676, "cultural": 0.5343}


def test_confusion_at_half_and_rates(spark):
    c = golden(spark).groupBy("run").agg(*metrics.confusion((F.col("p") >= 0.5).cast("int"), F.col("g")))
    for r in metrics.rates(c).collect():
        assert [r.tn, r.fp, r.fn, r.tp] == [1, 5, 1, 4] and r.accuracy == 0.454545
    empty = spark.createDataFrame([(0, 0, 0, 0)], "tn int, fp int, fn int, tp int")
    assert metrics.rates(empty).first().accuracy is None


def test_auc_counts_ties_like_all_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 1), rng.randint(0, 8) / 8) for _ in range(200)]
    got = metrics.roc_auc(spark.createDataFrame([("x", g, p) for g, p in rows], "k string, g int, p double"), ["k"], "p", "g").first()
    pos, neg = [p for g, p in rows if g], [p for g, p in rows if not g]
    assert got.concordant == sum(a > b for a in pos for b in neg) and got.tied == sum(a == b for a in pos for b in neg)


def test_hamming_join_equals_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    bits = base + [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(2)]
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame([*enumerate(signed), (999, None)], "id int, h long")
    got = {(r.key_a, r.key_b, r.distance) for r in dedup.hamming_pairs(df, "id", "h").collect()}
    want = {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(bits), 2) if (d := (a ^ b).bit_count()) <= 3}
    assert got == want and want
    assert dedup.hamming_pairs(df.limit(0), "id", "h").count() == 0


def test_bits_of(spark):
    df = spark.createDataFrame([("1" + "0" * 63,), ("0" * 63 + "1",), ("01",), (None,)], "b string")
    assert [r[0] for r in df.select(dedup.bits_of(F.col("b"))).collect()] == [-(1 << 63), 1, None, None]


def test_fuzzy_finds_near_texts(spark):
    a = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "something else entirely here")], "cand int, text string")
    b = spark.createDataFrame([(7, "the quick brown fox jumped over")], "ref int, text string")
    assert [(r.cand, r.ref) for r in dedup.fuzzy_matches(a, b).collect()] == [(1, 7)]


def test_dense_ids_and_ranks(spark):
    keys = random.Random(3).sample(range(100_000), 500)
    df = spark.createDataFrame([(k, k % 3) for k in keys], "k int, g int")
    assert [r.id for r in sampling.dense_ids(df, "k", width=64).orderBy("k").collect()] == list(range(500))
    r = sampling.ranked(df.withColumn("o", sampling.order_key("k")), ["g"], "o").collect()
    for g in range(3):
        mine = sorted((x for x in r if x.g == g), key=lambda x: x.o)
        assert [x.place for x in mine] == list(range(1, len(mine) + 1)) and {x.total for x in mine} == {len(mine)}


def test_last_wins_and_validity(spark):
    df = spark.createDataFrame([(1, 1, 0, None, False), (1, 2, 1, None, None), (2, 1, None, None, False), (3, 1, 1, "bad", False), (None, 1, 1, None, False), (4, 1, 1, None, True)], "k int, attempt int, prediction int, json_error string, timed_out boolean")
    rows = {r.k: r.valid for r in log.last_wins(df, ["k"], ["attempt"]).withColumn("valid", log.valid_mask()).collect()}
    assert rows == {1: True, 2: False, 3: False, 4: False}


def test_resume(spark):
    plan = log.planned(spark.createDataFrame([(1,), (2,)], "s int"), ["a", "b"])
    done = spark.createDataFrame([(1, "a"), (1, "a")], "s int, run_condition string")
    assert {tuple(r) for r in log.remaining(plan, done, ["s", "run_condition"]).collect()} == {(1, "b"), (2, "a"), (2, "b")}


def test_model_seam(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    rows = infer(df, mock, "id int, humorous boolean, probability double").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, True, 0.8), (2, False, 0.2)]


def like(rng, text, share, alphabet):
    """The text with about this share of its characters replaced, left out or doubled."""
    out = []
    for c in text:
        x = rng.random() / share
        out += [c] if x >= 1 else [rng.choice(alphabet)] if x < 0.4 else [] if x < 0.7 else [c, c]
    return "".join(out)


def test_near_texts_hold_every_match_of_short_and_long_texts():
    rng = random.Random(11)
    texts = []
    for alphabet in ("etaoin shrdlu cmfwypvbgkjqxz", "कखगघचछजझटठडढतथदध ", "ab "):
        for n in (15, 40, 120, 190, 210, 330, 520):
            base = "".join(rng.choices(alphabet, [3.0 / (k + 1) for k in range(len(alphabet))], k=n))
            texts += [base, *(like(rng, base, share, alphabet) for share in (0.03, 0.1, 0.14, 0.2))]
    arrow = pa.array(texts)
    ratio = lambda i, j: difflib.SequenceMatcher(None, texts[i], texts[j]).ratio()
    want = {(i, j) for i in range(len(texts)) for j in range(len(texts)) if i != j and ratio(i, j) >= 0.85}
    pairs = lambda found: [(i, j) for x, y in found for i, j in zip(x.tolist(), y.tolist())]
    once = pairs(dedup.near_texts(arrow, arrow, 0.85, mutual=True, same=True))
    assert len(once) == len({frozenset(p) for p in once}) and want <= {*once, *((j, i) for i, j in once)} and len(want) > 100
    assert want <= set(pairs(dedup.near_texts(arrow, arrow, 0.85)))
    assert list(dedup.near_texts(arrow, arrow.slice(0, 0), 0.85)) == []


def test_near_texts_leave_few_pairs_of_unlike_texts_soon():
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgk", k=rng.randint(2, 8))) for _ in range(400)]
    texts = pa.array([" ".join(rng.choices(words, k=rng.randint(12, 60))) for _ in range(5000)])
    began = time.process_time()
    assert sum(len(x) for x, _ in dedup.near_texts(texts, texts, 0.85, mutual=True, same=True)) < 20
    assert time.process_time() - began < 40


def test_alike_texts_are_spread_and_given_once(spark):
    import difflib

    rng, texts = random.Random(9), set()
    while len(texts) < 280:
        t = list("the quick brown fox jumps")
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz ")
        texts.add("".join(t))
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "cand long, text string")
    got = dedup.fuzzy_matches(df, df.withColumnRenamed("cand", "ref"), mutual=True, once=True).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, j): r for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and (r := difflib.SequenceMatcher(None, x, y).ratio()) >= 0.85}
    assert len(got) == len(want) and {(g.cand, g.ref): g.ratio for g in got} == want
    assert len({g.task for g in got}) == 36
