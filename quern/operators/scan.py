"""BM25 over documents without an index: texts are read for the terms of a batch of queries, and scored where they are read.

The queries of the batch go to every task. A task keeps each query's best documents, so what is shuffled grows with tasks
and queries, not with the documents that share a term. Formulas and order are those of quern.operators.rank.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.stem import stem_word
from quern.operators import rank
from quern.operators.index import corpus_stats, doc_stats
from quern.operators.terms import SIZES, WEIGHTS, _cut, _runs, _Stems, _stems, _texts

HITS = pa.schema([("qid", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("matched_terms", pa.list_(pa.string()))])
#: A query's list is cut to its best when it is so many times as long.
SLACK = 4


def frequencies(docs: DataFrame, wanted: frozenset[str], sizes: tuple[int, ...]) -> dict[str, int]:
    """How many documents have each of the wanted terms that any has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = _Stems(stem_word), Counter()
        for batch in batches:
            for _, title, body in _texts(batch):
                cut = [_stems(text, known) for text in (title, body)]
                counted.update({t for stems in cut for size in sizes for t in _runs(stems, size) if t in wanted})
        yield pa.record_batch([pa.array(list(counted), pa.string()), pa.array(list(counted.values()), pa.int64())], names=["term", "df"])

    found = _cut(docs).mapInArrow(each, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}


def bm25(terms: DataFrame, docs: DataFrame, now: int, k: int = 10) -> DataFrame:
    """qid, doc_id, score, matched_terms, rank as rank.bm25() gives them. terms: qid, pos, term, the batch; docs: doc_id, title, body, created_at."""
    grouped = terms.groupBy("qid", "term").agg(F.count("*").alias("times"), F.min("pos").alias("pos")).orderBy("qid", "pos").collect()
    sizes = tuple(size for size in SIZES if size in {r.term.count(X.JOINER) + 1 for r in grouped})
    corpus = corpus_stats(doc_stats(docs)).first()
    df = frequencies(docs, frozenset(r.term for r in grouped), sizes)
    qids = sorted({r.qid for r in grouped})
    place = {qid: n for n, qid in enumerate(qids)}
    listed, order = defaultdict(list), defaultdict(list)
    for r in grouped:
        if r.term in df:
            idf = np.log((corpus.total_docs - df[r.term] + 0.5) / (df[r.term] + 0.5) + 1)
            listed[r.term].append((place[r.qid], r.times * idf))
            order[place[r.qid]].append(r.term)
    weights = {term: (np.array([q for q, _ in pairs]), np.array([w for _, w in pairs])) for term, pairs in listed.items()}
    means = max(corpus.avg_title_length, 1.0), max(corpus.avg_body_length, 1.0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Stems(stem_word)
        best: list[list] = [[] for _ in qids]
        floor = np.full(len(qids), 5e-324)

        def cut(q: int) -> None:
            best[q] = sorted(best[q])[:k]
            if len(best[q]) == k:
                floor[q] = max(floor[q], -best[q][-1][0] - 10.0**-rank.COMPARED)

        for batch in batches:
            for doc_id, title, body, fresh in _texts(batch):
                scores = np.zeros(len(qids))
                parts: dict[str, float] = defaultdict(float)
                for field, text, mean, weight in (("title", title, means[0], rank.TITLE_WEIGHT), ("body", body, means[1], 1.0)):
                    stems = _stems(text, known)
                    length = sum(w * max(len(stems) - n, 0) for n, w in enumerate(WEIGHTS[field]))
                    norm = rank.K1 * (1 - rank.B + rank.B * length / mean)
                    for size in sizes:
                        for term, n in Counter(_runs(stems, size)).items():
                            if term in weights:
                                tf = n * WEIGHTS[field][size - 1]
                                parts[term] += weight * tf * (rank.K1 + 1) / (tf + norm)
                for term, part in parts.items():
                    queries, idfs = weights[term]
                    scores[queries] += idfs * part
                scores *= fresh
                matched = frozenset(parts)
                for q in np.flatnonzero(scores >= floor).tolist():
                    score = float(scores[q])
                    best[q].append((-round(score, rank.COMPARED), doc_id, score, matched))
                    if len(best[q]) >= SLACK * k:
                        cut(q)
        for q, qid in enumerate(qids):
            cut(q)
            rows = [(doc_id, score, [t for t in order[q] if t in matched]) for _, doc_id, score, matched in best[q]]
            if rows:
                ids, found, shown = zip(*rows)
                yield pa.record_batch([pa.array([qid] * len(rows), pa.int64()), pa.array(ids, pa.int64()), pa.array(found, pa.float64()), pa.array(shown, pa.list_(pa.string()))], schema=HITS)

    fresh = rank.recency(F.coalesce("created_at", F.lit(now)), F.lit(now)).alias("fresh")
    texts = _cut(docs.withColumn("fresh", fresh), "fresh")
    return rank.top(texts.mapInArrow(each, "qid long, doc_id long, score double, matched_terms array<string>"), k)
