"""Lexical and dense retrieval: TF-IDF over postings, cosine over vectors, top-k per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms


def postings(docs: DataFrame, key: str, text: str, stop: list[str]) -> DataFrame:
    """(key, term, tf) of words and bigrams."""
    return docs.select(key, F.explode(terms(F.col(text), stop)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def idf(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(post: DataFrame, idfs: DataFrame, key: str) -> DataFrame:
    """(key, term, w): tf-idf of length one; terms outside the vocabulary are dropped before the length is taken."""
    w = post.join(idfs, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("w"))


def top_k(scores: DataFrame, query: str, doc: str, score: str, k: int, least: float | None = None) -> DataFrame:
    """The k best documents of each query with score >= least; equal scores: the greater id first."""
    df = scores if least is None else scores.where(F.col(score) >= least)
    w = Window.partitionBy(query).orderBy(F.desc(score), F.desc(doc))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, text: str, stop: list[str], idfs: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, d, score) of queries(q, text) against docs(d, term, w).

    Words are cut down to the vocabulary before they are shuffled, once, by query: counts, lengths and scores of a query are made where its words are.
    """
    hits = queries.select("q", F.explode(terms(F.col(text), stop)).alias("term")).join(idfs, "term").repartition("q")
    hits = hits.groupBy("q", "term").agg((F.count("*") * F.first("idf")).alias("qw"))
    norm = F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("q")))
    hits = hits.withColumn("qw", F.col("qw") / norm)
    return hits.join(docs.withColumnRenamed("w", "dw"), "term").groupBy("q", "d").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score"))


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 1 << 14) -> DataFrame:
    """(q, d, score, rank): of rows(id, vector) the k nearest by cosine to each of queries(id, vector), itself left out; equal scores: the greater id first.

    The queries are cut into blocks of bounded size. Each is broadcast in turn and scored against all rows by matrix
    products; a task keeps the k best of each query, so only those are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    spark = rows.sparkSession

    def unit(column):
        m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    def best(q, d, score):
        order = np.lexsort((-d, -score, q))
        q, d, score = q[order], d[order], score[order]
        start = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        at = np.arange(len(q))
        keep = at - np.maximum.accumulate(np.where(start, at, 0)) < k
        return q[keep], d[keep], score[keep]

    def scorer(sent):
        def run(it):
            ids, matrix = sent.value
            top = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for b in it:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    d = part.column(0).to_numpy()
                    for at in range(0, len(ids), 1024):
                        s = np.round(matrix[at : at + 1024] @ unit(part.column(1)).T, 6)
                        s[ids[at : at + 1024, None] == d[None, :]] = -np.inf
                        least = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
                        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
                        top = tuple(np.concatenate(x) for x in zip(top, best(i + at, d[j], s[i, j])))
                top = best(*top)
            yield pa.RecordBatch.from_arrays([pa.array(ids[top[0]]), pa.array(top[1]), pa.array(top[2])], names=["q", "d", "score"])

        return run

    blocks = max(1, -(-queries.count() // block))
    numbered = queries.select(F.col("id").cast("long").alias("id"), "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    found = None
    for b in range(blocks):
        some = numbered.where(F.col("b") == b).toArrow()
        if some.num_rows:
            sent = spark.sparkContext.broadcast((some.column("id").to_numpy(), unit(some.column("vector").combine_chunks())))
            part = rows.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(scorer(sent), "q long, d long, score double")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "q long, d long, score double")
    return top_k(found, "q", "d", "score", k)
