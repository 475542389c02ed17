"""Queries on exact, perceptual and fuzzy duplicates and quarantine sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize
from ..operators.dedup import ahash, bits_of, exact_groups, first_hit, fuzzy_matches
from ..operators.dedup import hamming_pairs as hamming_join
from ..operators.log import last_wins
from .registry import CORPUS, query
from .texts import NORMAL

SAMPLES = "s AS (SELECT * FROM sample_manifest WHERE sample_index IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_index ORDER BY ingested_at DESC) = 1)"


def _samples(t, *columns):
    return last_wins(t.sample_manifest.select("sample_index", "ingested_at", *columns), ["sample_index"], ["ingested_at"]).drop("ingested_at")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT vec_id, e, list_sum(e) AS total FROM v)
SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x * 64 > total THEN '1' ELSE '0' END), '') AS ahash FROM m""")
def ahash_bits(t):
    return t.embeddings.select("vec_id", F.array_join(ahash(F.col("embedding")), "").alias("ahash"))


@query(f"""WITH {SAMPLES}, h AS (SELECT DISTINCT ahash_bitstring AS b FROM s WHERE regexp_full_match(ahash_bitstring, '[01]{{64}}')),
x AS (SELECT b, i, substr(b, (i * 16 + 1)::BIGINT, 16) AS v FROM h, range(4) r(i)),
p AS (SELECT DISTINCT a.b AS ba, c.b AS bb FROM x a JOIN x c ON a.i = c.i AND a.v = c.v AND a.b < c.b WHERE bit_count(xor(a.b::BIT, c.b::BIT)) <= 3),
d AS (SELECT ba, bb, bit_count(xor(ba::BIT, bb::BIT))::INTEGER AS distance FROM p UNION ALL SELECT b, b, 0 FROM h),
q AS (SELECT a.sample_index AS x, c.sample_index AS y, distance FROM d JOIN s a ON a.ahash_bitstring = ba JOIN s c ON c.ahash_bitstring = bb WHERE a.sample_index <> c.sample_index AND (ba <> bb OR a.sample_index < c.sample_index))
SELECT least(x, y) AS key_a, greatest(x, y) AS key_b, distance FROM q""")
def hamming_pairs(t):
    """Samples whose perceptual hashes differ in at most three bits."""
    s = _samples(t, "ahash_bitstring").select("sample_index", bits_of(F.col("ahash_bitstring")).alias("bits"))
    return hamming_join(s, "sample_index", "bits", 3)


@query(f"WITH {SAMPLES} SELECT file_md5, count(*) AS n, min(sample_index) AS first_key FROM s WHERE file_md5 IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_file_groups(t):
    return exact_groups(_samples(t, "file_md5").dropna(subset=["file_md5"]), "sample_index", "file_md5")


@query(f"WITH {CORPUS}, b AS (SELECT DISTINCT {NORMAL.format('ocr_text')} AS k FROM inference_results WHERE ocr_text IS NOT NULL AND meme_id LIKE 'bench%') SELECT row_id FROM corpus WHERE {NORMAL.format('ocr')} NOT IN (SELECT k FROM b)")
def exclude_quarantined(t):
    """Memes whose normalised text is not among the texts of benchmark runs."""
    known = t.inference_results.where("ocr_text is not null and meme_id like 'bench%'").select(F.md5(normalize(F.col("ocr_text"))).alias("k")).distinct()
    return t.corpus("ocr").select("row_id", F.md5(normalize(F.col("ocr"))).alias("k")).join(known, "k", "left_anti").select("row_id")


_QUARANTINE = f"""q AS (SELECT sample_index AS ref, file_md5, ahash_bitstring FROM s WHERE sample_index % 50 = 0), c AS (SELECT sample_index AS cand, file_md5, ahash_bitstring FROM s WHERE sample_index % 50 <> 0),
h AS (SELECT cand, ref, 0 AS test FROM c JOIN q USING (file_md5)
  UNION ALL SELECT DISTINCT cand, ref, 1 FROM (SELECT *, unnest(range(4)) AS i FROM c) x JOIN (SELECT *, unnest(range(4)) AS i FROM q) y ON x.i = y.i AND substr(x.ahash_bitstring, (x.i * 16 + 1)::BIGINT, 16) = substr(y.ahash_bitstring, (y.i * 16 + 1)::BIGINT, 16)
    WHERE bit_count(xor(x.ahash_bitstring::BIT, y.ahash_bitstring::BIT)) <= 3)"""


def _collisions(t):
    s = _samples(t, "file_md5", "ahash_bitstring").withColumn("bits", bits_of(F.col("ahash_bitstring")))
    # the stated query set: every sample whose index is divisible by 50, against all others
    q = s.where("sample_index % 50 = 0").select(F.col("sample_index").alias("ref"), "file_md5", F.col("bits").alias("rbits"))
    c = s.where("sample_index % 50 <> 0").select(F.col("sample_index").alias("cand"), "file_md5", "bits")
    exact = c.join(q, "file_md5").select("cand", "ref", F.lit(0).alias("test"))
    band = lambda b: F.posexplode(F.array(*[F.shiftrightunsigned(b, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)])).alias("i", "v")
    near = c.select("cand", "bits", band(F.col("bits"))).join(q.select("ref", "rbits", band(F.col("rbits"))), ["i", "v"]).where(F.bit_count(F.col("bits").bitwiseXOR(F.col("rbits"))) <= 3)
    return exact.unionByName(near.select("cand", "ref", F.lit(1).alias("test")))


@query(f"WITH {SAMPLES}, {_QUARANTINE} SELECT cand, ref, test::INTEGER AS test FROM h QUALIFY row_number() OVER (PARTITION BY cand ORDER BY ref, test) = 1")
def quarantine_collisions(t):
    """First collision of each candidate by the order of the quarantine set, then test (file, perceptual)."""
    return first_hit(_collisions(t), "cand", ["ref", "test"]).select("cand", "ref", "test")


@query(f"WITH {SAMPLES}, {_QUARANTINE}, f AS (SELECT cand, test FROM h QUALIFY row_number() OVER (PARTITION BY cand ORDER BY ref, test) = 1) SELECT CASE test WHEN 0 THEN 'file' ELSE 'perceptual' END AS reason, count(*) AS n FROM f GROUP BY 1")
def exclusion_summary(t):
    return first_hit(_collisions(t), "cand", ["ref", "test"]).groupBy(F.when(F.col("test") == 0, "file").otherwise("perceptual").alias("reason")).agg(F.count("*").alias("n"))


def _readings(t):
    """Distinct normalised texts that runs read of the benchmark memes, with the hash as key."""
    text = normalize(F.col("ocr_text"))
    return t.inference_results.where("ocr_text is not null and meme_id like 'bench%'").select(text.alias("text")).distinct().withColumn("cand", F.xxhash64("text"))


def _keyed(t):
    """(field_name, key, cand, text) of all memes, samples and readings: normalised text, with its hash as cand."""
    memes = t.corpus("ocr").select(F.lit("ocr").alias("field_name"), F.col("row_id").alias("key"), normalize(F.col("ocr")).alias("text"))
    readings = _readings(t).select(F.lit("reading").alias("field_name"), F.col("cand").alias("key"), "text")
    return memes.unionByName(readings).withColumn("cand", F.xxhash64("text")).unionByName(keyed_samples(t))


def keyed_samples(t):
    """The rows of _keyed that are samples."""
    samples = _samples(t, "ocr_text").select(F.lit("ocr_text").alias("field_name"), F.col("sample_index").cast("long").alias("key"), normalize(F.col("ocr_text")).alias("text"))
    return samples.withColumn("cand", F.xxhash64("text"))


def _distinct(df):
    return df.select("cand", "text").dropDuplicates(["cand"])


def same_and_near(keyed, least=0.85, shortest=15, once=False):
    """(key_a, key_b, ratio), key_a < key_b, of all keyed(key, cand, text) whose texts are within `least`: distinct texts are compared, then their keys joined. once: key is cand."""
    rows = keyed.where(F.length("text") >= shortest).select("key", "cand")
    a, b = rows.withColumnsRenamed({"key": "key_a"}), rows.withColumnsRenamed({"key": "key_b", "cand": "ref"})
    texts = _distinct(keyed)
    near = fuzzy_matches(texts, texts.withColumnRenamed("cand", "ref"), least, shortest, mutual=True, once=once)
    same = a.join(b, F.col("cand") == F.col("ref")).withColumn("ratio", F.lit(1.0))
    return same.unionByName(near.join(a, "cand").join(b, "ref").select("key_a", "cand", "key_b", "ref", "ratio")).where("key_a < key_b").select("key_a", "key_b", "ratio")


@query()
def fuzzy_dupes(t):
    """Memes (ocr, row_id), samples (ocr_text, sample_index) and texts read in benchmark runs (reading, hash) within 0.85 of a benchmark meme's text by matching blocks; no SQL has that measure."""
    return dupes_of(t, _keyed(t))


def dupes_of(t, keyed):
    """(field_name, cand, ref, ratio) of keyed(field_name, key, cand, text) near the benchmark's texts."""
    r = t.benchmark_memes.select(F.col("sample_index").alias("ref"), normalize(F.col("ocr_text")).alias("text"))
    return fuzzy_matches(_distinct(keyed), r).join(keyed.select("field_name", "key", "cand"), "cand").select("field_name", F.col("key").alias("cand"), "ref", "ratio")


@query()
def fuzzy_pairs(t):
    """Pairs of samples (ocr_text, sample_index), and of different readings (reading, hash), within 0.85 of each other by matching blocks, in the order cand < ref."""
    readings = _readings(t).withColumn("key", F.col("cand"))
    return pairs_of("ocr_text", keyed_samples(t)).unionByName(pairs_of("reading", readings, once=True))


def pairs_of(name, keyed, once=False):
    return same_and_near(keyed, once=once).select(F.lit(name).alias("field_name"), F.col("key_a").alias("cand"), F.col("key_b").alias("ref"), "ratio")


def _all_collisions(t):
    """_collisions and test 2, similar text: SQL has no such measure, so the queries it checks have the first two only."""
    s = _samples(t, "ocr_text").select(F.col("sample_index").alias("key"), normalize(F.col("ocr_text")).alias("text")).withColumn("cand", F.xxhash64("text"))
    q, c = s.where("key % 50 = 0").withColumnsRenamed({"key": "ref_key", "cand": "ref"}), s.where("key % 50 <> 0")
    texts = q.select("ref", "text").dropDuplicates(["ref"])
    hits = fuzzy_matches(_distinct(c), texts).join(c.select("key", "cand"), "cand").join(q.select("ref_key", "ref"), "ref")
    return _collisions(t).unionByName(hits.select(F.col("key").alias("cand"), F.col("ref_key").alias("ref"), F.lit(2).alias("test")))


@query()
def quarantine_first_hits(t):
    """quarantine_collisions with all three tests: file, perceptual, similar text."""
    return first_hit(_all_collisions(t), "cand", ["ref", "test"]).select("cand", "ref", "test")


@query()
def exclusion_reasons(t):
    """exclusion_summary with all three tests."""
    reason = F.when(F.col("test") == 0, "file").when(F.col("test") == 1, "perceptual").otherwise("text").alias("reason")
    return quarantine_first_hits(t).groupBy(reason).agg(F.count("*").alias("n"))


@query(f"""WITH {SAMPLES}, {CORPUS} SELECT s.sample_index, coalesce(md5(s.ocr_text) = md5(c.ocr), false) AS same_text, coalesce(s.image_filename = c.image_filename, false) AS same_file FROM s JOIN corpus c ON c.row_id = s.meme_row_id""")
def parity_check(t):
    """Whether each sample still equals the meme it was drawn from."""
    s = _samples(t, "meme_row_id", "ocr_text", "image_filename").select("sample_index", F.col("meme_row_id").alias("row_id"), F.md5("ocr_text").alias("a"), F.col("image_filename").alias("f"))
    c = t.corpus("ocr", "image_filename").select("row_id", F.md5("ocr").alias("b"), "image_filename")
    return s.join(c, "row_id").select("sample_index", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("same_text"), F.coalesce(F.col("f") == F.col("image_filename"), F.lit(False)).alias("same_file"))
