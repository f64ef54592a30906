"""Ranking: two-field BM25 with recency, TF-IDF cosine, and weighted reciprocal-rank fusion.

Ties, which are frequent with copies, go to the smaller doc_id; scores are compared at nine decimals, so that the
order of a sum cannot change a ranking.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the ranking functions.
K1, B, TITLE_WEIGHT = 1.5, 0.75, 8.0
HALF_LIFE_DAYS, BASE = 30.0, 0.3
RRF_K = 60
COMPARED = 9


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_tf(tf: Column, length: Column, average: Column) -> Column:
    norm = 1 - B + B * length / F.greatest(average, F.lit(1.0))
    return F.when(tf == 0, 0.0).otherwise(tf * (K1 + 1) / (tf + K1 * norm))


def recency(created_at: Column, now: Column) -> Column:
    """From 1 for new (or future) documents down to BASE, half the way down every HALF_LIFE_DAYS."""
    days = F.greatest(now - created_at, F.lit(0)) / 86400.0
    return BASE + (1 - BASE) * F.exp(-math.log(2) / HALF_LIFE_DAYS * days)


def top(scored: DataFrame, k: int | None) -> DataFrame:
    """scored (qid, doc_id, score, ...) with rank from 1; of each query the k first, all for None.

    Each task keeps its own k first before the shuffle.
    """
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", COMPARED)), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def bm25(terms: DataFrame, postings: DataFrame, df: DataFrame, stats: DataFrame, corpus: DataFrame, now: int, k: int | None = 10) -> DataFrame:
    """qid, doc_id, score, matched_terms, rank. terms: qid, pos, term; a term that is repeated counts as often.

    Terms are grouped first, so a posting is read once for each query that has its term.
    """
    wanted = terms.groupBy("qid", "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos")).join(df.select("term", "df"), "term")
    hits = postings.select("term", "doc_id", "title_tf", "body_tf").join(wanted, "term").join(stats, "doc_id").join(F.broadcast(corpus))
    length = lambda c: F.coalesce(F.col(c), F.lit(1))
    title = TITLE_WEIGHT * bm25_tf(F.col("title_tf"), length("title_len"), F.col("avg_title_length"))
    body = bm25_tf(F.col("body_tf"), length("body_len"), F.col("avg_body_length"))
    part = hits.select("qid", "doc_id", "created_at", "pos", "term", (F.col("times") * smooth_idf(F.col("total_docs"), F.col("df")) * (title + body)).alias("part"))
    matched = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    summed = part.groupBy("qid", "doc_id").agg(F.sum("part").alias("raw"), F.first("created_at").alias("created_at"), matched.alias("matched_terms"))
    scored = summed.select("qid", "doc_id", (F.col("raw") * recency(F.coalesce("created_at", F.lit(now)), F.lit(now))).alias("score"), "matched_terms")
    return top(scored, k)


def query_vectors(terms: DataFrame, df: DataFrame, corpus: DataFrame) -> DataFrame:
    """qid, term, weight, norm: as for documents; the largest count is over all terms of the query, indexed or not."""
    counted = terms.groupBy("qid", "term").agg(F.count("*").alias("n"))
    scaled = counted.withColumn("most", F.max("n").over(Window.partitionBy("qid")))
    weighed = scaled.join(df.select("term", "df"), "term").join(F.broadcast(corpus)).select(
        "qid", "term", ((0.5 + 0.5 * F.col("n") / F.col("most")) * F.log(F.col("total_docs") / F.col("df"))).alias("weight")
    )
    return weighed.withColumn("norm", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("qid"))))


def cosine(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """qid, doc_id, score for all pairs that share a term of positive weight; other pairs have similarity 0."""
    asked = queries.select("qid", "term", F.col("weight").alias("q_weight"), F.col("norm").alias("q_norm")).filter("q_weight > 0")
    shared = vectors.join(asked, "term").groupBy("qid", "doc_id").agg(
        F.sum(F.col("weight") * F.col("q_weight")).alias("dot"), F.first("norm").alias("norm"), F.first("q_norm").alias("q_norm")
    )
    return shared.filter("norm > 0 AND q_norm > 0").select("qid", "doc_id", (F.col("dot") / (F.col("norm") * F.col("q_norm"))).alias("score")).filter("score > 0")


def similar_ranks(similar: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, rank by similarity, of each query's k most similar documents and of its hits (few a query): all that fusing needs.

    A document that is no hit can be among the k first of the fused list only if it is among the k most similar. A
    hit's rank is how many documents come no later than it. The hits' places cut each query's list into stretches; rows
    are counted by stretch, partly before the shuffle, so the list of a query is never sorted in one task.
    """
    place = F.struct((-F.round("score", COMPARED)).alias("near"), "doc_id")
    placed = similar.select("qid", "doc_id", place.alias("place"))
    marks = placed.join(hits.select("qid", "doc_id"), ["qid", "doc_id"]).groupBy("qid").agg(F.sort_array(F.collect_list("place")).alias("marks"))
    before = F.size(F.filter("marks", lambda m: m < F.col("place")))
    counted = placed.join(marks, "qid").groupBy("qid", before.alias("stretch")).agg(F.count("*").alias("n"))
    until = counted.withColumn("rank", F.sum("n").over(Window.partitionBy("qid").orderBy("stretch")).cast("int"))
    of_hits = marks.select("qid", F.posexplode("marks").alias("stretch", "mark")).join(until, ["qid", "stretch"]).select("qid", "mark.doc_id", "rank")
    return top(similar, k).select("qid", "doc_id", "rank").unionByName(of_hits).distinct()


def rrf(first: DataFrame, second: DataFrame, first_weight: float, second_weight: float, k: int | None = 10) -> DataFrame:
    """qid, doc_id, score, rank of two ranked lists (qid, doc_id, rank from 1): sums of weight / (RRF_K + rank)."""
    part = lambda ranked, weight: ranked.select("qid", "doc_id", (F.lit(float(weight)) / (RRF_K + F.col("rank"))).alias("part"))
    both = part(first, first_weight).unionByName(part(second, second_weight))
    return top(both.groupBy("qid", "doc_id").agg(F.sum("part").alias("score")), k)
