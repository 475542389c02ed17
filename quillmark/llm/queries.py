"""Queries of this subpackage by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import abuse, draw, langid, lookalike, mixing, neardup, overlap, pairs, sentences, tokens
from .base import newest, spread, table


def _memes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Every delivery of every meme, with the columns named; work on texts comes before newest(), so no text is shuffled to find it."""
    return spread(table(spark, sf_dir, "memes").select("row_id", "ingested_at", *columns))


def p1_draw(spark, sf_dir):
    """The drawn samples of every manifest."""
    return draw.draw(table(spark, sf_dir, "sample_manifest"), table(spark, sf_dir, "draw_targets"))[0]


def p1_report(spark, sf_dir):
    """Needed, available and drawn samples of every cell, with shortfall and residual imbalance."""
    return draw.draw(table(spark, sf_dir, "sample_manifest"), table(spark, sf_dir, "draw_targets"))[1]


def p1_found(spark, sf_dir):
    """Cells that need more samples than the pool has: those the draw could not fill."""
    return p1_report(spark, sf_dir).where("shortfall > 0").select("manifest_id", "stratum_id", F.col("ground_truth").cast("int").alias("ground_truth"))


def _scored(spark, sf_dir, *columns):
    weights = abuse.fit(table(spark, sf_dir, "memes").select("row_id", "ocr", "offensive"))
    return newest(abuse.scores(_memes(spark, sf_dir, "ocr", *columns), "ocr", weights), ["row_id"])


def p2_score(spark, sf_dir):
    """A score of abuse for every meme."""
    return _scored(spark, sf_dir).select("row_id", "score")


def p2_rates(spark, sf_dir):
    """Rates of abusive memes per source."""
    return abuse.rates(_scored(spark, sf_dir, "source"), "source")


def p2_found(spark, sf_dir):
    return p2_score(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("row_id")


def _texts(spark, sf_dir):
    memes = spread(table(spark, sf_dir, "memes").select(F.lit("ocr").alias("field_name"), F.col("row_id").alias("key"), F.col("ocr").alias("text"), "ingested_at"))
    samples = spread(table(spark, sf_dir, "sample_manifest").select(F.lit("ocr_text").alias("field_name"), F.col("sample_index").cast("long").alias("key"), F.col("ocr_text").alias("text"), "ingested_at"))
    return memes.unionByName(samples)


def p3_groups(spark, sf_dir):
    """(field_name, key, group_id, n_links) of every record: its group of near-same texts of its field, and how many other bags of words of the field are near its own."""
    return neardup.near_groups(_texts(spark, sf_dir))


def p3_found(spark, sf_dir):
    return neardup.near_pairs(_texts(spark, sf_dir))


def p4_found(spark, sf_dir):
    results, prompts = table(spark, sf_dir, "inference_results"), table(spark, sf_dir, "prompts")
    model = pairs.fit(results, prompts, table(spark, sf_dir, "documents"))
    samples = newest(table(spark, sf_dir, "sample_manifest").select("sample_index", F.col("ocr_text").alias("sample_text"), "ingested_at"), ["sample_index"]).drop("ingested_at")
    fixed = table(spark, sf_dir, "benchmark_memes").select("sample_index", F.col("ocr_text").alias("sample_text"))
    texts = samples.unionByName(fixed).dropDuplicates(["sample_index"])
    rows = results.select("result_id", "reasoning", "ocr_text", "sample_index", "prompt_hash")
    rows = rows.join(prompts.select("prompt_hash", "prompt_text").dropDuplicates(["prompt_hash"]), "prompt_hash", "left").join(texts, "sample_index", "left")
    return pairs.defects(rows, "result_id", "reasoning", ["ocr_text", "prompt_text", "sample_text"], model).select("result_id", "defect")


def _languages(spark, sf_dir, *columns):
    labelled = langid.labelled_texts(table(spark, sf_dir, "documents").select("lang", "text"), table(spark, sf_dir, "memes").select("ocr_lang", "ocr"))
    return langid.languages(_memes(spark, sf_dir, "ocr", *columns), "ocr", langid.counts_of(labelled))


def p5_languages(spark, sf_dir):
    """Language, confidence and segments of every meme."""
    return newest(_languages(spark, sf_dir), ["row_id"]).drop("ingested_at")


def p5_found(spark, sf_dir):
    rows = _languages(spark, sf_dir, "ocr_lang", langid.enough_pieces("ocr").alias("enough"))
    return newest(rows.drop("confidence", "segments"), ["row_id"]).where(F.col("enough") & langid.is_wrong("ocr_lang")).select("row_id", "lang_code")


def p6_pairs(spark, sf_dir):
    """Overlapping pairs across splits, by text and by name, with coverage."""
    return overlap.cross_split(spread(table(spark, sf_dir, "memes").select("row_id", "ocr", "image_filename", "split", "ingested_at")))


def p6_coverage(spark, sf_dir):
    """How much of each record outside train the texts of train cover."""
    return overlap.covered_records(spread(table(spark, sf_dir, "memes").select("row_id", "ocr", "split", "ingested_at")))


def p6_counts(spark, sf_dir):
    """Overlaps per split and source."""
    return overlap.overlap_counts(p6_pairs(spark, sf_dir), newest(table(spark, sf_dir, "memes").select("row_id", "split", "source", "ingested_at"), ["row_id"]))


def p6_found(spark, sf_dir):
    return p6_pairs(spark, sf_dir).select(F.least("train_id", "other_id").alias("key_a"), F.greatest("train_id", "other_id").alias("key_b"))


def p7_forms(spark, sf_dir):
    """(field_name, key, canon): the one consistent form of every meme's text and of every text a run read."""
    memes = newest(table(spark, sf_dir, "memes").select("row_id", "ocr", "ingested_at"), ["row_id"]).select(F.lit("ocr").alias("field_name"), F.col("row_id").alias("key"), F.col("ocr").alias("text"))
    results = table(spark, sf_dir, "inference_results").select(F.lit("ocr_text").alias("field_name"), F.col("result_id").alias("key"), F.col("ocr_text").alias("text"))
    return lookalike.with_canonical(memes.unionByName(results), "text").select("field_name", "key", "canon")


def p7_found(spark, sf_dir):
    memes = table(spark, sf_dir, "memes").select(F.lit("ocr").alias("field_name"), F.lit("").alias("scope"), F.col("row_id").alias("key"), F.col("ocr").alias("text"), "ingested_at")
    results = table(spark, sf_dir, "inference_results").where("evaluation_id is not null and sample_index is not null")
    results = results.select(F.lit("ocr_text").alias("field_name"), F.concat_ws("|", "evaluation_id", F.col("sample_index").cast("string")).alias("scope"), F.col("result_id").alias("key"), F.col("ocr_text").alias("text"), "ingested_at")
    return lookalike.lookalike_pairs(memes.unionByName(results))


def p8_ids(spark, sf_dir):
    return tokens.encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_decoded(spark, sf_dir):
    """The text of every document, decoded from its ids; nulls become empty."""
    return tokens.decode_corpus(p8_ids(spark, sf_dir), "doc_id")


def p9_mix(spark, sf_dir):
    """The schedule of every mix: which document fills which slot."""
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[0]


def p9_report(spark, sf_dir):
    """Shares reached by every source of every mix."""
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark, sf_dir):
    return p9_report(spark, sf_dir).where("short").select("mix_id", "source_name")


def p10_sentences(spark, sf_dir):
    """Every sentence of every document."""
    return sentences.sentence_ends(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), spans=True)


def p10_found(spark, sf_dir):
    return sentences.sentence_ends(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {f.__name__: f for f in (p1_found, p1_draw, p1_report, p2_found, p2_score, p2_rates, p3_found, p3_groups, p4_found, p5_found, p5_languages, p6_found, p6_pairs, p6_coverage, p6_counts, p7_found, p7_forms, p8_ids, p8_decoded, p9_found, p9_mix, p9_report, p10_found, p10_sentences)}

#: SQL of the queries that it can express over whole tables; the others are tested against brute force and fixtures.
SQL = {
    "p1_found": """
WITH t AS (SELECT *, greatest(min_count, CAST(floor(round(target_share * draw_size, 6) + 0.5) AS BIGINT)) AS needed FROM draw_targets),
pool AS (
  SELECT manifest_id, ground_truth, upper(regexp_replace(translate(stratum_id, 'ＨＮｈｎ０１２３４５６７８９', 'HNhn0123456789'), '[^0-9A-Za-z]', '', 'g')) AS k, count(DISTINCT sample_id) AS n
  FROM sample_manifest WHERE stratum_id IS NOT NULL AND ground_truth IS NOT NULL GROUP BY ALL
)
SELECT t.manifest_id, t.stratum_id, CAST(t.ground_truth AS INTEGER) AS ground_truth
FROM t LEFT JOIN pool p ON p.manifest_id = t.manifest_id AND p.k = upper(t.stratum_id) AND p.ground_truth = t.ground_truth
WHERE t.needed > coalesce(p.n, 0)
""",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
