"""Queries on labels, splits and profiles of the corpus."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.labels import HUMOUR, binary_label, flag, level, strict_label, tidy_label
from ..operators.metrics import ratio
from .registry import CORPUS, query


@query(f"WITH {CORPUS} SELECT row_id, CASE WHEN humour = 'not_funny' THEN 0 ELSE 1 END::INTEGER AS label FROM corpus WHERE humour IS NOT NULL")
def label_binarize(t):
    return t.corpus("humour").select("row_id", binary_label(F.col("humour")).alias("label")).dropna(subset=["label"])


@query(f"""WITH {CORPUS}, x AS (SELECT row_id, humour, CASE WHEN regexp_replace(lower(trim(humour)), '\\s+', '_', 'g') = 'not_funny' THEN 0
  WHEN regexp_replace(lower(trim(humour)), '\\s+', '_', 'g') IN ('funny', 'very_funny', 'hilarious') THEN 1 END::INTEGER AS label FROM corpus WHERE humour IS NOT NULL)
SELECT row_id, humour, label FROM x""")
def label_map_strict(t):
    return t.corpus("humour").where("humour is not null").select("row_id", "humour", strict_label(tidy_label(F.col("humour"))).alias("label"))


@query(f"""WITH {CORPUS}, x AS (SELECT is_humorous AS a, CASE WHEN regexp_replace(lower(trim(humour)), '\\s+', '_', 'g') = 'not_funny' THEN 0 ELSE 1 END AS b FROM corpus WHERE humour IS NOT NULL AND is_humorous IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (a <> b) AS mismatches FROM x""")
def label_crosscheck(t):
    df = t.corpus("humour", "is_humorous").dropna(subset=["humour", "is_humorous"])
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("is_humorous") != binary_label(tidy_label(F.col("humour")))).alias("mismatches"))


@query(f"""WITH {CORPUS}, c AS (SELECT is_humorous AS class, count(*) AS n FROM corpus WHERE is_humorous IS NOT NULL GROUP BY 1)
SELECT class, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct, round(max(n) OVER () / (min(n) OVER ())::DOUBLE, 6) AS imbalance FROM c""")
def class_distribution(t):
    c = t.corpus("is_humorous").dropna(subset=["is_humorous"]).groupBy(F.col("is_humorous").alias("class")).agg(F.count("*").alias("n"))
    w = Window.partitionBy()  # two rows
    return c.select("class", "n", F.round(100 * F.col("n") / F.sum("n").over(w), 6).alias("pct"), F.round(F.max("n").over(w) / F.min("n").over(w), 6).alias("imbalance"))


@query(f"""WITH {CORPUS}, c AS (SELECT split, humour AS label, count(*) AS n FROM corpus WHERE humour IS NOT NULL AND split IS NOT NULL GROUP BY ALL)
SELECT split, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6)::DOUBLE AS pct FROM c""")
def value_counts_pct(t):
    c = t.corpus("split", "humour").dropna(subset=["split", "humour"]).groupBy("split", F.col("humour").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 6))


PROFILED = ("humour", "sarcastic", "offensive", "motivational", "overall", "ocr", "image_filename", "split", "ocr_lang", "source")


@query("WITH " + CORPUS + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM corpus" for c in PROFILED))
def column_profile(t):
    """Rows, nulls and distinct values of each column; values are counted in one pass over (column, value) pairs."""
    rows = t.corpus(*PROFILED).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in PROFILED])).alias("x")).select("x.*")
    values = rows.groupBy("column_name", "v").agg(F.count("*").alias("c"))
    return values.groupBy("column_name").agg(F.sum("c").alias("n_rows"), F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("n_null"), F.count("v").alias("n_distinct"))


@query(f"WITH {CORPUS}, v AS (SELECT ocr, count(*) AS c FROM corpus GROUP BY 1) SELECT sum(c)::BIGINT AS n_rows, count(*) AS n_distinct, (sum(c) - count(*))::BIGINT AS n_duplicates FROM v")
def dup_text_count(t):
    v = t.corpus("ocr").groupBy("ocr").agg(F.count("*").alias("c"))
    return v.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), (F.sum("c") - F.count("*")).alias("n_duplicates"))


@query(f"WITH {CORPUS} SELECT row_id FROM corpus WHERE ocr IS NOT NULL AND humour IS NOT NULL AND image_filename IS NOT NULL")
def not_null_filter(t):
    return t.corpus("ocr", "humour", "image_filename").dropna(subset=["ocr", "humour", "image_filename"]).select("row_id")


@query(f"WITH {CORPUS} SELECT CASE WHEN split = 'train' THEN 'labelled' ELSE 'held' END AS part, count(*) AS n, count(DISTINCT ocr) AS n_texts FROM corpus GROUP BY 1")
def split_union(t):
    c = t.corpus("ocr", "split")
    a, b = c.where("split = 'train'").withColumn("part", F.lit("labelled")), c.where("split is distinct from 'train'").withColumn("part", F.lit("held"))
    return a.unionByName(b).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("ocr").alias("n_texts"))


@query(f"""WITH {CORPUS}, k AS (SELECT DISTINCT split, image_filename AS f FROM corpus WHERE image_filename IS NOT NULL AND split IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM k a JOIN k b ON a.f = b.f AND a.split < b.split GROUP BY ALL""")
def split_overlap(t):
    k = t.corpus("split", "image_filename").dropna().select("split", "image_filename").groupBy("image_filename").agg(F.array_sort(F.collect_set("split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("split_a"), b.alias("split_b")))))
    return k.select(F.explode(pairs).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n_shared"))


@query(f"WITH {CORPUS} SELECT DISTINCT humour AS label FROM corpus WHERE humour IS NOT NULL AND humour NOT IN ('not_funny', 'funny', 'very_funny', 'hilarious')")
def unknown_labels(t):
    return t.corpus("humour").where(F.col("humour").isNotNull() & ~F.col("humour").isin(*HUMOUR)).select(F.col("humour").alias("label")).distinct()


@query(f"""WITH {CORPUS} SELECT row_id, CASE WHEN image_filename IS NULL OR lower(image_filename) LIKE 'http://%' OR lower(image_filename) LIKE 'https://%' THEN false ELSE true END AS is_local FROM corpus""")
def url_or_local_mask(t):
    f = F.lower("image_filename")
    return t.corpus("image_filename").select("row_id", F.coalesce(~(f.startswith("http://") | f.startswith("https://")), F.lit(False)).alias("is_local"))


@query(f"WITH {CORPUS} SELECT row_id, split FROM corpus ORDER BY row_id LIMIT 25")
def head_n(t):
    return t.corpus("split").select("row_id", "split").orderBy("row_id").limit(25)


@query(f"""WITH {CORPUS}, c AS (SELECT is_humorous AS class, count(*) AS n FROM corpus WHERE is_humorous IS NOT NULL GROUP BY 1)
SELECT class, n, round((max(n) OVER ()) / n::DOUBLE, 6) AS weight FROM c""")
def class_weights(t):
    c = t.corpus("is_humorous").dropna(subset=["is_humorous"]).groupBy(F.col("is_humorous").alias("class")).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.round(F.max("n").over(Window.partitionBy()) / F.col("n"), 6))


@query(f"WITH {CORPUS} SELECT row_id, (CASE WHEN split = 'test_unlabelled' THEN 'blind_' ELSE 'train_' END) || row_id || '.jpg' AS file_key FROM corpus")
def doc_key(t):
    prefix = F.when(F.col("split") == "test_unlabelled", "blind_").otherwise("train_")
    return t.corpus("split").select("row_id", F.concat(prefix, F.col("row_id").cast("string"), F.lit(".jpg")).alias("file_key"))


@query(f"""WITH {CORPUS} SELECT row_id, concat_ws('_', CASE WHEN overall IN ('negative', 'very_negative') THEN '0' WHEN overall = 'neutral' THEN '1' ELSE '2' END,
  (CASE WHEN humour = 'not_funny' THEN '0' ELSE '1' END) || (CASE WHEN sarcastic = 'not_sarcastic' THEN '0' ELSE '1' END) || (CASE WHEN offensive = 'not_offensive' THEN '0' ELSE '1' END) || (CASE WHEN motivational = 'not_motivational' THEN '0' ELSE '1' END),
  (CASE humour WHEN 'not_funny' THEN '0' WHEN 'funny' THEN '1' WHEN 'very_funny' THEN '2' ELSE '3' END) || (CASE sarcastic WHEN 'not_sarcastic' THEN '0' WHEN 'little_sarcastic' THEN '1' WHEN 'very_sarcastic' THEN '2' ELSE '3' END)
  || (CASE offensive WHEN 'not_offensive' THEN '0' WHEN 'slight' THEN '1' WHEN 'very_offensive' THEN '2' ELSE '3' END) || (CASE WHEN motivational = 'not_motivational' THEN '0' ELSE '1' END)) AS line FROM corpus""")
def answer_encoding(t):
    """One fixed-layout line per record: sentiment, flags, levels."""
    df = t.corpus("overall", "humour", "sarcastic", "offensive", "motivational")
    sentiment = F.when(F.col("overall").isin("negative", "very_negative"), "0").when(F.col("overall") == "neutral", "1").otherwise("2")
    flags = F.concat(*[flag(F.col(c), f"not_{w}") for c, w in (("humour", "funny"), ("sarcastic", "sarcastic"), ("offensive", "offensive"), ("motivational", "motivational"))])
    levels = F.concat(level(F.col("humour"), "not_funny", "funny", "very_funny"), level(F.col("sarcastic"), "not_sarcastic", "little_sarcastic", "very_sarcastic"), level(F.col("offensive"), "not_offensive", "slight", "very_offensive"), flag(F.col("motivational"), "not_motivational"))
    return df.select("row_id", F.concat_ws("_", sentiment, flags, levels).alias("line"))


@query(f"""WITH {CORPUS} SELECT row_id, array_to_string(list_filter([CASE WHEN ocr IS NULL OR trim(ocr) = '' THEN 'no_text' END, CASE WHEN image_filename IS NULL THEN 'no_file' END, CASE WHEN source IS NULL THEN 'no_source' END], lambda x: x IS NOT NULL), ',') AS defects
FROM corpus WHERE ocr IS NULL OR trim(ocr) = '' OR image_filename IS NULL OR source IS NULL""")
def audit_defects(t):
    blank = F.col("ocr").isNull() | (F.trim("ocr") == "")
    df = t.corpus("ocr", "image_filename", "source").withColumn("defects", F.concat_ws(",", F.when(blank, "no_text"), F.when(F.col("image_filename").isNull(), "no_file"), F.when(F.col("source").isNull(), "no_source")))
    return df.where("defects <> ''").select("row_id", "defects")


@query(f"""WITH {CORPUS}, s AS (SELECT split, is_humorous, count(*) AS n FROM corpus WHERE split IS NOT NULL AND is_humorous IS NOT NULL GROUP BY ALL)
SELECT split, is_humorous, n, round(n / (sum(n) OVER (PARTITION BY split))::DOUBLE, 6) AS share FROM s""")
def label_share_by_split(t):
    s = t.corpus("split", "is_humorous").dropna().groupBy("split", "is_humorous").agg(F.count("*").alias("n"))
    return s.withColumn("share", F.round(ratio(F.col("n"), F.sum("n").over(Window.partitionBy("split"))), 6))


@query("WITH " + CORPUS + ", v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS v, count(*) AS n FROM corpus WHERE {c} IS NOT NULL GROUP BY 2" for c in PROFILED) + ") SELECT column_name, v AS value, n FROM v WHERE column_name IN (SELECT column_name FROM v GROUP BY 1 HAVING count(*) < 20)")
def profile_values(t):
    """Counts of the values of each column that has fewer than twenty."""
    rows = t.corpus(*PROFILED).select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in PROFILED])).alias("x")).select("x.*").dropna()
    values = rows.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    few = values.groupBy("column_name").count().where("count < 20").select("column_name")
    return values.join(few, "column_name", "left_semi").select("column_name", "value", "n")


@query(f"WITH {CORPUS} SELECT row_id, is_humorous FROM corpus WHERE ocr IS NOT NULL AND is_humorous IS NOT NULL ORDER BY row_id LIMIT 1000")
def max_records(t):
    """A bound on the number of records that is applied after the filters, in order of row_id."""
    return t.corpus("ocr", "is_humorous").where("ocr is not null and is_humorous is not null").select("row_id", "is_humorous").orderBy("row_id").limit(1000)
