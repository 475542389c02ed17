"""Queries on text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import BEFORE_NUMBER, BOILERPLATE, CATEGORIES, KEPT_NUMBERS, MONTHS, STATES, STOPWORDS, STRUCTURAL, any_word, categories, content_tokens, keywords, normalize, sanitize, terms, words
from .registry import CORPUS, query

_W = r"[^\p{L}\p{N}_]"
NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _sql_any(column: str, ws: list[str]) -> str:
    import re

    return f"coalesce(regexp_matches({column}, '(?i)(?:^|{_W})(?:{'|'.join(re.escape(w) for w in ws)})(?:$|{_W})'), false)"


def _sql_list(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


TAGS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_sql_any('{0}', keywords(c))} THEN '{c}' END" for c in CATEGORIES) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {CORPUS} SELECT row_id, {NORMAL.format('ocr')} AS text FROM corpus")
def normalize_text(t):
    return t.corpus("ocr").select("row_id", normalize(F.col("ocr")).alias("text"))


@query()
def sanitize_query(t):
    """Queries without boilerplate and meaningless numbers. Word boundaries differ between the engines on non-ASCII text, so this is tested on fixtures."""
    return t.corpus("ocr").select("row_id", sanitize(F.col("ocr")).alias("query"))


@query(f"WITH {CORPUS}, x AS (SELECT row_id, {TAGS_SQL.replace("{0}", "ocr")} AS tags FROM corpus) SELECT row_id, CASE WHEN len(tags) = 0 THEN 'none' ELSE array_to_string(tags, '|') END AS tags FROM x")
def category_tags(t):
    return t.corpus("ocr").select("row_id", F.array_join(categories(F.col("ocr")), "|").alias("tags"))


@query(f"""WITH {CORPUS}, x AS (SELECT row_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce(ocr, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}') AND NOT list_contains({_sql_list([*STOPWORDS, *STATES, *STRUCTURAL])}, w)))) AS w FROM corpus)
SELECT row_id, len(w)::INTEGER AS n, array_to_string(w, ' ') AS tokens FROM x""", name="content_tokens")
def content_tokens_of(t):
    df = t.corpus("ocr").withColumn("w", content_tokens(F.col("ocr"), STOPWORDS))
    return df.select("row_id", F.size("w").alias("n"), F.array_join("w", " ").alias("tokens"))


TERMS = ["sharma", "password", "bill", "office", "exam", "kta"]


@query(f"WITH {CORPUS} SELECT row_id FROM corpus WHERE regexp_matches(lower(ocr), '{'|'.join(TERMS)}')")
def term_any_match(t):
    """Any of the terms as a plain substring, no word boundary."""
    return t.corpus("ocr").where(F.lower("ocr").rlike("|".join(TERMS))).select("row_id")


@query(f"""WITH {CORPUS}, w AS (SELECT row_id, list_filter(regexp_extract_all(lower(coalesce(ocr, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_sql_list(STOPWORDS)}, w)) AS w FROM corpus),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term, row_id FROM w)
SELECT term, count(*) AS tf, count(DISTINCT row_id) AS df FROM g GROUP BY 1""")
def tfidf_terms(t):
    rows = t.corpus("ocr").select("row_id", F.explode(terms(F.col("ocr"), STOPWORDS)).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("c"))
    return rows.groupBy("term").agg(F.sum("c").alias("tf"), F.count("*").alias("df"))


@query(f"WITH {CORPUS} SELECT row_id, md5({NORMAL.format('ocr')}) AS text_md5, substr(sha256(ocr), 1, 16) AS sha16 FROM corpus WHERE ocr IS NOT NULL")
def content_hash(t):
    return t.corpus("ocr").where("ocr is not null").select("row_id", F.md5(normalize(F.col("ocr"))).alias("text_md5"), F.substring(F.sha2("ocr", 256), 1, 16).alias("sha16"))


@query("""SELECT prompt_hash, substr(sha256('{"prompt_text":"' || prompt_text || '","run_condition":"' || run_condition || '"}'), 1, 16) AS config_hash FROM prompts""")
def config_hash(t):
    """Hash of the canonical JSON (keys sorted) of each prompt's settings."""
    return t.prompts.select("prompt_hash", F.substring(F.sha2(F.to_json(F.struct("prompt_text", "run_condition")), 256), 1, 16).alias("config_hash"))


@query()
def levenshtein_sim(t):
    """Edit similarity of the text a run read to the sample's text, in code points and over all scripts; tested against brute force."""
    from ..operators.log import last_wins

    m = last_wins(t.sample_manifest.select("sample_index", F.col("ocr_text").alias("ref"), "ingested_at"), ["sample_index"], ["ingested_at"])
    df = t.inference_results.select("result_id", "sample_index", "ocr_text").join(m, "sample_index").where("ocr_text is not null and ref is not null")
    d = F.levenshtein("ocr_text", "ref")
    return df.select("result_id", d.alias("distance"), F.round(1 - d / F.greatest(F.lit(1), F.length("ocr_text"), F.length("ref")), 6).alias("similarity"))


@query("SELECT row_id, array_to_string(list_filter(list_transform(string_split(ocr, chr(10)), lambda s: trim(s)), lambda s: s <> ''), ' ') AS joined FROM (SELECT * FROM memes QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at DESC) = 1) WHERE ocr IS NOT NULL")
def segment_join(t):
    seg = F.filter(F.transform(F.split("ocr", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return t.corpus("ocr").where("ocr is not null").select("row_id", F.array_join(seg, " ").alias("joined"))


@query(f"WITH {CORPUS}, w AS (SELECT row_id, regexp_extract_all(lower(coalesce(ocr, '')), '[\\p{{L}}\\p{{N}}_]+') AS w FROM corpus) SELECT row_id, list_min(list_filter([list_position(w, 'the'), list_position(w, 'hai'), list_position(w, 'my')], lambda p: p > 0))::BIGINT AS first_marker FROM w")
def first_marker(t):
    """Place of the first of a set of marker words."""
    df = t.corpus("ocr").withColumn("w", words(F.col("ocr")))
    at = F.array_min(F.filter(F.array(*[F.array_position("w", m) for m in ("the", "hai", "my")]), lambda p: p > 0))
    return df.select("row_id", at.alias("first_marker"))


@query(f"WITH {CORPUS} SELECT row_id, list_sort(list_distinct(string_split(coalesce(humour, 'none'), '_') || string_split(coalesce(overall, 'none'), '_')))[1] AS first_part, len(list_distinct(string_split(coalesce(humour, 'none'), '_') || string_split(coalesce(overall, 'none'), '_')))::INTEGER AS n_parts FROM corpus")
def array_ops(t):
    u = F.array_union(F.split(F.coalesce("humour", F.lit("none")), "_"), F.split(F.coalesce("overall", F.lit("none")), "_"))
    return t.corpus("humour", "overall").select("row_id", F.array_min(u).alias("first_part"), F.size(u).alias("n_parts"))


@query(f"WITH {CORPUS} SELECT source, count(*) AS n, count(*) FILTER ({_sql_any('ocr', keywords('workplace'))}) AS n_workplace FROM corpus WHERE source IS NOT NULL GROUP BY 1")
def tag_rate_by_source(t):
    df = t.corpus("ocr", "source").where("source is not null")
    return df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(any_word(F.col("ocr"), keywords("workplace"))).alias("n_workplace"))


@query(f"WITH {CORPUS} SELECT row_id, replace(substr(ocr, 1, 100), chr(10), ' ') AS preview FROM corpus WHERE ocr IS NOT NULL")
def text_preview(t):
    """The first hundred characters on one line, for lists."""
    return t.corpus("ocr").where("ocr is not null").select("row_id", F.replace(F.substring("ocr", 1, 100), F.lit("\n"), F.lit(" ")).alias("preview"))


# Signs that stand for something in HTML, and how they are written.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def _escaped_sql(column: str) -> str:
    for ch, name in ESCAPES:
        column = f"replace({column}, chr({ord(ch)}), '{name}')"
    return column


@query(f"WITH {CORPUS} SELECT row_id, {_escaped_sql('ocr')} AS html FROM corpus WHERE ocr IS NOT NULL")
def html_escaped(t):
    html = F.col("ocr")
    for ch, name in ESCAPES:
        html = F.replace(html, F.lit(ch), F.lit(name))
    return t.corpus("ocr").where("ocr is not null").select("row_id", html.alias("html"))


@query(f"WITH {CORPUS} SELECT row_id, regexp_extract(image_filename, '[^/]*$') AS base FROM corpus WHERE image_filename IS NOT NULL")
def path_basename(t):
    """File names without the folders before them."""
    return t.corpus("image_filename").where("image_filename is not null").select("row_id", F.regexp_extract("image_filename", r"[^/]*$", 0).alias("base"))
