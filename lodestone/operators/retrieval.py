"""Lexical, BM25 and vector retrieval over inverted postings and blocks of a stated query set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import rounded, tokens
from lodestone.operators.series import top_k


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term, n_terms)."""
    t = queries.select(F.col(key).alias("query"), F.array_distinct(tokens(F.col(text))).alias("t"))
    return t.select("query", F.size("t").alias("n_terms"), F.explode("t").alias("term"))


#: Distinct query words up to which they are sent to all tasks; more are joined.
SMALL = 200_000


def query_postings(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(doc, term, tf, doc_len) of the words that any query holds: other words are dropped where they are read, before any shuffle."""
    asked = terms.select("term").distinct()
    words = docs.select(F.col(key).alias("doc"), tokens(F.col(text)).alias("t")).select("doc", F.size("t").alias("doc_len"), F.explode("t").alias("term"))
    met = words.join(F.broadcast(asked) if asked.count() <= SMALL else asked, "term", "left_semi")
    return met.groupBy("doc", "term", "doc_len").agg(F.count("*").alias("tf"))


def lexical_scores(docs: DataFrame, key: str, text: str, queries: DataFrame, q_key: str, q_text: str) -> DataFrame:
    """(query, doc, score): three quarters of the capped hits a term plus 2.5 times their density, at most 1. Only pairs that share a term."""
    terms = query_terms(queries, q_key, q_text)
    met = query_postings(docs, key, text, terms).join(terms, "term")
    hits = met.groupBy("query", "doc").agg(F.sum(F.least("tf", F.lit(5))).alias("hits"), F.first("n_terms").alias("n"), F.first("doc_len").alias("len"))
    return hits.select("query", "doc", F.least(F.lit(1.0), rounded(0.75 * F.col("hits") / F.col("n") + 2.5 * F.col("hits") / F.col("len"))).alias("score"))


def bm25_scores(docs: DataFrame, key: str, text: str, queries: DataFrame, q_key: str, q_text: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, doc, score) of Okapi BM25 with statistics over the whole corpus. Only pairs that share a term."""
    terms = query_terms(queries, q_key, q_text)
    index = query_postings(docs, key, text, terms)
    length = F.size(tokens(F.col(text)))
    stats = docs.agg(F.avg(F.when(length > 0, length)).alias("avg_len"), F.count("*").alias("n_docs"))  # one row
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    met = index.join(terms.join(df, "term"), "term").crossJoin(F.broadcast(stats))
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return met.groupBy("query", "doc").agg(F.sum(weight).alias("score"))


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2_000) -> DataFrame:
    """(query, neighbour, similarity): the k rows of highest cosine for each query, exactly, ties to the smaller key.

    Queries are a stated set, gathered in blocks of bounded size; each block meets every row once, and every batch keeps
    its own best k, so what is shuffled is k rows a query and batch.  Null, empty or zero vectors and those of another
    length meet nothing.
    """
    kind = vectors.schema[key].dataType.simpleString()
    sound = lambda df: df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    spark, out, part = vectors.sparkSession, None, []

    def scan(shared):
        def run(batches):
            names, matrix = shared.value
            for batch in batches:
                same = batch[batch["v"].map(len) == matrix.shape[1]]
                if not len(same):
                    continue
                m = np.stack(same["v"].to_list()).astype(np.float64)
                norm = np.linalg.norm(m, axis=1)
                m, keys = m[norm > 0] / norm[norm > 0, None], same["key"].to_numpy()[norm > 0]
                order = np.argsort(keys, kind="stable")
                m, keys = m[order], keys[order]
                sims = matrix @ m.T
                best = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]  # a query may meet itself
                yield pd.DataFrame({"query": np.repeat(names, best.shape[1]), "neighbour": keys[best].ravel(), "similarity": np.take_along_axis(sims, best, axis=1).ravel()})

        return run

    def close(rows):
        m = np.array([r["v"] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(m, axis=1)
        kept = norm > 0
        names = np.array([r["key"] for r in rows])[kept]
        return sound(vectors).mapInPandas(scan(spark.sparkContext.broadcast((names, m[kept] / norm[kept, None]))), f"query {kind}, neighbour {kind}, similarity double")

    for row in sound(queries).toLocalIterator():
        part.append(row)
        if len(part) == block:
            out, part = close(part) if out is None else out.unionByName(close(part)), []
    if part or out is None:
        if not part:
            return spark.createDataFrame([], f"query {kind}, neighbour {kind}, similarity double, rank int")
        out = close(part) if out is None else out.unionByName(close(part))
    return top_k(out.where("query <> neighbour"), ["query"], [F.desc("similarity"), F.asc("neighbour")], k)
