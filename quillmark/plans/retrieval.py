"""Queries on retrieval and context assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STATES, STOPWORDS, STRUCTURAL, categories, content_tokens, is_structural, sanitize, state_tokens
from ..operators.retrieval import idf, nearest, postings, sparse_scores, top_k, weights
from .registry import CORPUS, query
from .texts import TAGS_SQL, _sql_list

#: Documents of a query, least similarity, similarity from which no shared words are asked for, greatest distance of vectors.
K, LEAST, SURE, FAR = 3, 0.25, 0.45, 0.65

_TERMS = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({stop}, w))"
_POST = "(SELECT {k}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM (SELECT {k}, " + _TERMS + " AS w FROM {t}))"


def _post(k, c, t):
    return _POST.format(k=k, c=c, t=t, stop=_sql_list(STOPWORDS))


_INDEX = f"""{CORPUS}, dp AS (SELECT entry_id, term, count(*) AS tf FROM {_post('entry_id', 'content', 'cultural_documents')} GROUP BY ALL), n AS (SELECT count(*) AS n FROM cultural_documents),
i AS (SELECT term, ln((1 + n) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dp, n GROUP BY term, n), dw AS (SELECT entry_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY entry_id)) AS w FROM dp JOIN i USING (term)),
qp AS (SELECT row_id, term, count(*) AS tf FROM {_post('row_id', 'ocr', 'corpus')} GROUP BY ALL), qw AS (SELECT row_id, term, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY row_id)) AS w FROM qp JOIN i USING (term)),
s AS (SELECT row_id, entry_id, round(sum(qw.w * dw.w), 6) AS score FROM qw JOIN dw USING (term) GROUP BY ALL)"""


def _scores(t):
    """Scores of all memes against the knowledge documents, by TF-IDF of words and bigrams."""
    docs = t.cultural_documents
    post = postings(docs, "entry_id", "content", STOPWORDS)
    idfs = idf(post, docs.count())
    dw = weights(post, idfs, "entry_id").withColumnRenamed("entry_id", "d")
    return sparse_scores(t.corpus("ocr").select(F.col("row_id").alias("q"), "ocr"), "ocr", STOPWORDS, idfs, dw)


@query(f"WITH {_INDEX} SELECT row_id, entry_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, entry_id DESC)::INTEGER AS rank FROM s WHERE score >= {LEAST} QUALIFY rank <= {K}")
def tfidf_topk(t):
    return top_k(_scores(t), "q", "d", "score", K, LEAST).select(F.col("q").alias("row_id"), F.col("d").alias("entry_id"), "score", "rank")


_LATIN = "list_distinct(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{2,}}')))"


def _latin(c):
    """SQL of content words and state words of a column."""
    ws = _LATIN.format(c=c)
    return f"list_filter({ws}, lambda w: NOT list_contains({_sql_list([*STOPWORDS, *STATES, *STRUCTURAL])}, w))", f"list_intersect({ws}, {_sql_list(STATES)})"


@query(f"""WITH {_INDEX}, qt AS (SELECT row_id, {_latin('ocr')[0]} AS a, {_latin('ocr')[1]} AS sa, list_has_any({_LATIN.format(c='ocr')}, {_sql_list(STRUCTURAL)}) AS asks FROM corpus), dt AS (SELECT entry_id, {_latin('content')[0]} AS b, {_latin('content')[1]} AS sb FROM cultural_documents),
g AS (SELECT s.*, len(list_intersect(a, b)) AS shared, len(list_intersect(sa, sb)) AS places, asks FROM s JOIN qt USING (row_id) JOIN dt USING (entry_id) WHERE score >= {LEAST})
SELECT row_id, entry_id, score, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, entry_id DESC)::INTEGER AS rank FROM g WHERE score >= {SURE} OR (CASE WHEN asks THEN shared >= 2 OR (shared >= 1 AND places >= 1) ELSE shared >= 1 END) QUALIFY rank <= {K}""")
def tfidf_gated_topk(t):
    """Scores under SURE need a shared word of content; queries with words of questions need two, or one and a shared state. What the gate rejects takes no place among the k."""
    text = F.col("ocr")
    q = t.corpus("ocr").select(F.col("row_id").alias("q"), content_tokens(text, STOPWORDS).alias("a"), state_tokens(text).alias("sa"), is_structural(text).alias("asks"))
    d = t.cultural_documents.select(F.col("entry_id").alias("d"), content_tokens(F.col("content"), STOPWORDS).alias("b"), state_tokens(F.col("content")).alias("sb"))
    s = _scores(t).where(F.col("score") >= LEAST).join(q, "q").join(d, "d")
    shared, places = F.size(F.array_intersect("a", "b")), F.size(F.array_intersect("sa", "sb"))
    s = s.where((F.col("score") >= SURE) | F.when(F.col("asks"), (shared >= 2) | (shared >= 1) & (places >= 1)).otherwise(shared >= 1))
    return top_k(s, "q", "d", "score", K).select(F.col("q").alias("row_id"), F.col("d").alias("entry_id"), "score", "rank")


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT vec_id AS q, v AS qv FROM e WHERE vec_id % 50 = 0),
s AS (SELECT q, vec_id AS d, round(list_cosine_similarity(qv, v), 6) AS score FROM q JOIN e ON vec_id <> q), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d DESC)::INTEGER AS rank FROM s QUALIFY rank <= 3)
SELECT q, d, score, rank FROM r WHERE 1 - score <= {FAR}""")
def vector_topk(t):
    """Three nearest vectors of every vector whose id is divisible by 50 (the stated query set, against all rows in blocks), then a bound on the distance."""
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e, e.where("id % 50 = 0"), 3).where(1 - F.col("score") <= FAR).select("q", "d", "score", "rank")


_DOC_CAT = {"JEE/exams": "exams", "Bollywood": "cinema", "marriage/wedding": "marriage"}


def _category(c):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _DOC_CAT.items() for x in kv]), c), c)


@query(f"""WITH {CORPUS}, x AS (SELECT row_id, {TAGS_SQL.replace('{0}', 'ocr')} AS tags FROM corpus), y AS (SELECT row_id, unnest(tags) AS tag, unnest(range(len(tags))) AS pos FROM x)
SELECT row_id, string_agg('- ' || upper(tag) || ': ' || title, chr(10) ORDER BY pos) AS context FROM y JOIN cultural_documents d ON d.category = CASE tag WHEN 'JEE/exams' THEN 'exams' WHEN 'Bollywood' THEN 'cinema' WHEN 'marriage/wedding' THEN 'marriage' ELSE tag END GROUP BY 1""")
def category_context(t):
    """Bullets of the knowledge titles of a meme's categories, in their order."""
    tags = t.corpus("ocr").select("row_id", F.posexplode(categories(F.col("ocr"))).alias("pos", "tag"))
    docs = t.cultural_documents.select(F.col("category").alias("key"), "title")
    hit = tags.withColumn("key", _category(F.col("tag"))).join(docs, "key")
    line = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), F.upper("tag"), F.lit(": "), F.col("title")).alias("x")))), lambda s: s["x"])
    return hit.groupBy("row_id").agg(F.array_join(line, "\n").alias("context"))


@query()
def build_context(t):
    """Search text, context section and sources of each meme: sanitised text and categories, best documents, attribution. Composed of tested parts."""
    q = t.corpus("ocr").select("row_id", sanitize(F.col("ocr")).alias("clean"), F.array_except(categories(F.col("ocr")), F.array(F.lit("none"))).alias("tags"))
    hits = tfidf_topk(t).join(t.cultural_documents.select("entry_id", "title", "content"), "entry_id")
    per = hits.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("rank", "entry_id", F.concat_ws(": ", "title", "content").alias("text")))).alias("h"))
    out = q.join(per, "row_id", "left")
    return out.select("row_id", F.concat_ws(" ", "clean", F.array_join("tags", " ")).alias("search_text"), F.array_join(F.transform("h", lambda x: x["text"]), "\n\n").alias("context"), F.array_join(F.transform("h", lambda x: x["entry_id"]), "|").alias("sources"))


@query("""WITH d AS (SELECT *, trim(lower(concat_ws(' ', nullif(trim(text), ''), nullif(trim(lang), ''), nullif(trim(source), '')))) AS search_text FROM documents WHERE text IS NOT NULL AND trim(text) <> '')
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, doc_id, md5(search_text) AS search_md5 FROM d WHERE doc_id IS NOT NULL""")
def kb_build(t):
    """Search texts of documents with a dense id in order of doc_id: rows are numbered within ranges of ids, whose sizes are summed first."""
    from ..operators.sampling import dense_ids

    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    d = t.documents.where("trim(text) <> '' and doc_id is not null").select("doc_id", F.trim(F.lower(F.concat_ws(" ", part("text"), part("lang"), part("source")))).alias("search_text"))
    return dense_ids(d.select("doc_id", F.md5("search_text").alias("search_md5")), "doc_id")


TAUS = (0.15, 0.25, 0.45)


@query(f"""WITH c AS (SELECT run_condition, tau, count(*) AS n, count(*) FILTER (drishtikon_matches_count > 0) AS hits, count(*) FILTER (prediction = ground_truth) AS right_rows, count(*) FILTER (s >= tau) AS kept, count(*) FILTER (s >= tau AND prediction = ground_truth) AS right_kept
FROM (SELECT *, (drishtikon_diagnostics::JSON->0->>'score')::DOUBLE AS s FROM inference_results WHERE json_valid(drishtikon_diagnostics)), (VALUES {", ".join(f"({x}::DOUBLE)" for x in TAUS)}) v(tau) WHERE run_condition IS NOT NULL GROUP BY ALL)
SELECT run_condition, tau, hits, kept, right_kept, round(coalesce(right_kept / nullif(kept, 0)::DOUBLE, 0), 6) AS precision_kept, round(coalesce(right_kept / nullif(right_rows, 0)::DOUBLE, 0), 6) AS recall_kept, round((kept - right_kept) / n::DOUBLE, 6) AS false_match_rate FROM c""")
def retrieval_pr(t):
    """Precision, recall and rate of false matches of what score thresholds keep: a match is right where the run that used it was."""
    s = F.get_json_object("drishtikon_diagnostics", "$[0].score").cast("double")
    df = t.inference_results.where("run_condition is not null and try_parse_json(drishtikon_diagnostics) is not null").withColumn("s", s)
    right = F.col("prediction") == F.col("ground_truth")
    counts = [F.count("*").alias("n"), F.count_if(F.col("drishtikon_matches_count") > 0).alias("hits"), F.count_if(right).alias("right_rows")]
    for i, x in enumerate(TAUS):
        counts += [F.count_if(F.col("s") >= x).alias(f"k{i}"), F.count_if((F.col("s") >= x) & right).alias(f"r{i}")]
    each = [F.struct(F.lit(x).alias("tau"), F.col(f"k{i}").alias("kept"), F.col(f"r{i}").alias("right_kept")) for i, x in enumerate(TAUS)]
    g = df.groupBy("run_condition").agg(*counts).select("run_condition", "n", "hits", "right_rows", F.explode(F.array(*each)).alias("x")).select("*", "x.*").drop("x")
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    kept, right_kept = F.col("kept"), F.col("right_kept")
    return g.select("run_condition", "tau", "hits", "kept", "right_kept", rate(right_kept, kept).alias("precision_kept"), rate(right_kept, F.col("right_rows")).alias("recall_kept"), rate(kept - right_kept, F.col("n")).alias("false_match_rate"))
