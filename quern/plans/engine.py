"""The engine: search, suggest, index, statistics and health over one index."""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Callable, Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import lexicon, query, rank
from quern.operators import suggest as suggesting
from quern.operators.index import Index
from quern.operators.snippet import snippet_column
from quern.sources import store
from quern.sources.scratch import Scope, scratch_path, written

LIMIT, BLEND, LEAST_BLEND, SUGGESTIONS, KEPT_LATENCIES = 10, 0.4, 0.01, 6, 50
SCORE_DECIMALS = 5


def statistics(df: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: total_docs, vocab_size, title_vocab_size, avg_title_length, avg_body_length."""
    terms = df.agg(F.count("*").alias("vocab_size"), F.count_if(F.col("title_df") > 0).alias("title_vocab_size"))
    return corpus.join(terms).select(
        "total_docs", "vocab_size", "title_vocab_size", F.round("avg_title_length", 2).alias("avg_title_length"), F.round("avg_body_length", 2).alias("avg_body_length")
    )


def upper_median(latencies: Sequence[int]) -> int:
    """The middle value, of an even number the upper one; 0 for none."""
    return sorted(latencies)[len(latencies) // 2] if latencies else 0


def latest_median(log: DataFrame, order: str, value: str, last: int = KEPT_LATENCIES) -> DataFrame:
    """The same over a log table: one row p50 of the `last` rows by `order`."""
    kept = log.orderBy(F.desc(order)).limit(last)
    values = F.array_sort(F.collect_list(value))
    return kept.agg(F.coalesce(F.get(values, F.floor(F.count(value) / 2).cast("int")), F.lit(0)).alias("p50"))


def rank_queries(
    index: Index, queries: DataFrame, phrases: Sequence[str], synonyms: DataFrame, now: int,
    limit: int = LIMIT, typo_tolerance: bool = True, semantic_blend: float = BLEND, restem: bool = True, hold: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(processed queries, ranked hits: qid, doc_id, score, rank, matched_terms). hold says how what is read more than once is held; else in memory, for good."""
    hold = hold or (lambda df: df.persist(StorageLevel.MEMORY_AND_DISK))
    processed = hold(query.process_queries(queries, index.vocabulary, phrases, synonyms))
    tokens = processed.select("qid", "tokens")
    if typo_tolerance:
        tokens = query.fuzzy_terms(tokens, index.vocabulary, index.trigrams, index.trigram_counts, restem)
    terms = hold(query.final_terms(tokens, restem))
    hits = hold(rank.bm25(terms, index.postings, index.df, index.stats, index.corpus, now, 2 * limit))
    blend = min(max(semantic_blend, 0.0), 1.0)
    if semantic_blend > LEAST_BLEND:
        similar = rank.cosine(rank.query_vectors(terms, index.df, index.corpus), index.vectors)  # its shuffle is reused, so nothing is kept
        near = rank.similar_ranks(similar, hits, limit)
    else:
        near = hits.select("qid", "doc_id", "rank").limit(0)
    fused = rank.rrf(hits, near, 1 - blend, blend, limit)
    return processed, fused.join(hits.select("qid", "doc_id", "matched_terms"), ["qid", "doc_id"], "left")


def search_results(index: Index, ranked: DataFrame) -> DataFrame:
    """qid, rank, doc_id, title, score, snippet: documents are fetched for ranked rows only."""
    words = F.filter(F.coalesce("matched_terms", F.array().cast("array<string>")), lambda t: ~F.contains(t, F.lit("~")))
    found = index.documents.select("doc_id", "title", "body").join(ranked, "doc_id")
    return found.select("qid", "rank", "doc_id", "title", F.round("score", SCORE_DECIMALS).alias("score"), snippet_column(F.col("body"), words).alias("snippet"))


class SearchEngine:
    """Holds an index and the dictionaries. Queries come as a table (qid, raw); one query is a table of one row."""

    def __init__(
        self, spark: SparkSession, index: Index | None = None, path: str | None = None, phrases: Sequence[str] | None = None,
        synonyms: Mapping[str, Sequence[str]] | None = None,
    ) -> None:
        self.spark, self.path = spark, path
        self._index = index
        if index is None:
            self.path = path or scratch_path(spark, "index")
            self._index = store.load_or_new(spark, self.path)
        self.phrases = lexicon.phrase_terms(lexicon.default_phrases() if phrases is None else phrases)
        pairs = lexicon.synonym_pairs(lexicon.default_synonyms() if synonyms is None else synonyms)
        self.synonyms = spark.createDataFrame(pairs, "stem string, synonym string")
        self.latencies: deque[int] = deque(maxlen=KEPT_LATENCIES)

    @property
    def held(self) -> Index:
        """The index; what follows from all documents is made anew when it is first read after some were added."""
        if self._index is None:
            self._index = store.load(self.spark, self.path)
        return self._index

    def search(self, queries: DataFrame, now: int | None = None, limit: int = LIMIT, typo_tolerance: bool = True, semantic_blend: float = BLEND, restem: bool = True) -> DataFrame:
        """qid, rank, doc_id, title, score, snippet of the best documents for each query, as a finished table; all else that was made for it is released."""
        with Scope() as scope:
            _, ranked = rank_queries(self.held, queries, self.phrases, self.synonyms, self._now(now), limit, typo_tolerance, semantic_blend, restem, scope.hold)
            return scope.kept(search_results(self.held, ranked), "results")

    def process(self, queries: DataFrame) -> DataFrame:
        return query.process_queries(queries, self.held.vocabulary, self.phrases, self.synonyms)

    def ask(self, raw: str, **options) -> dict:  # noqa: ANN003
        """One query as a dictionary: query, processed_query, corrections, expansions, results, total_results, latency_ms."""
        began = time.perf_counter()
        one = self.spark.createDataFrame([(0, raw)], "qid long, raw string")
        options = {"now": None, **options}
        with Scope() as scope:
            processed, ranked = rank_queries(self.held, one, self.phrases, self.synonyms, self._now(options.pop("now")), **options, hold=scope.hold)
            results = [r.asDict() for r in search_results(self.held, ranked).orderBy("rank").drop("qid", "rank").collect()]
            row = processed.first()
        took = round((time.perf_counter() - began) * 1e6)
        self.latencies.append(took)
        return {
            "query": raw, "processed_query": list(row.tokens), "corrections": [tuple(c) for c in row.corrections], "expansions": [(e.term, list(e.synonyms)) for e in row.expansions],
            "results": results, "total_results": len(results), "latency_ms": took / 1000,
        }

    def suggest(self, inputs: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
        return suggesting.suggest(inputs, self.held.completions, limit)

    def index(self, docs: DataFrame, now: int | None = None, batch: str = "") -> DataFrame:
        """Add documents (title, body and perhaps created_at); returns their ids (doc_id), which follow the largest one.

        They become a part of the index of their own, so this costs what they are worth, however large the index is. A batch
        ("stream.number") that was added before isn't added again, and has no new ids.
        """
        if self.path is None:  # held in memory until now
            self.path = scratch_path(self.spark, "index")
            store.save(self.held, self.path)
        if store.has_batch(self.spark, self.path, batch):
            return self.spark.createDataFrame([], "doc_id long")
        first = store.next_id(self.spark, self.path)
        added, total = number_documents(docs, first, self._now(now))
        store.add(added, self.path, first + total, batch)
        self._index = None
        return self.spark.range(first, first + total).select(F.col("id").alias("doc_id"))

    def stats(self) -> DataFrame:
        return statistics(self.held.df, self.held.corpus)

    def health(self) -> dict:
        counts = self.stats().first()
        return {
            "status": "ok", "rss_mb": self._rss_mb(), "total_docs": counts.total_docs,
            "p50_latency_us": upper_median(self.latencies), "vocab_size": counts.vocab_size,
        }

    @staticmethod
    def _now(now: int | None) -> int:
        return int(time.time()) if now is None else now

    def _rss_mb(self) -> float:
        """Memory that the driver holds now: its Python process and its JVM."""
        pages = 0
        for pid in {os.getpid(), self.spark._jvm.java.lang.ProcessHandle.current().pid()}:
            with open(f"/proc/{pid}/statm") as file:
                pages += int(file.read().split()[1])
        return round(pages * os.sysconf("SC_PAGE_SIZE") / 2**20, 2)


def number_documents(docs: DataFrame, first: int, now: int) -> tuple[DataFrame, int]:
    """docs with ids from `first` on, and how many they are. The order of a batch is that of its rows."""
    spark = docs.sparkSession
    created = F.coalesce(F.col("created_at").cast("long"), F.lit(now)) if "created_at" in docs.columns else F.lit(now)
    rows = written(docs.select("title", "body", created.cast("long").alias("created_at"), F.monotonically_increasing_id().alias("row")), "arrived")
    part = F.shiftright("row", 33)
    counts = [(r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()]
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, first + total))
        total += n
    placed = rows.withColumn("part", part).join(F.broadcast(spark.createDataFrame(starts, "part long, start long")), "part")
    return placed.select((F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)).alias("doc_id"), "title", "body", "created_at"), total
