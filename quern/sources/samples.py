"""A small corpus to try the engine with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: title, body, age in days
SAMPLES = (
    ("Inverted index basics", "An inverted index maps each term to the documents that hold it. Lookups are fast. Building it takes one pass over the text.", 2),
    ("Machine learning for ranking", "Ranking models learn from clicks. A machine learning model scores each candidate. Simple features go far!", 5),
    ("Neural networks in search engines", "Deep learning changed retrieval. Neural networks embed a query and a document; cosine similarity compares them.", 9),
    ("Garbage collection explained", "A garbage collection cycle frees memory. Does it pause the program? Often for a moment only.", 14),
    ("Distributed systems and data structures", "Distributed systems split data over machines. A hash table per shard keeps lookups quick. Race conditions are the hard part.", 21),
    ("Writing a web server", "A web server accepts connections and answers requests. Error handling matters. Use an event loop or threads.", 30),
    ("Unit tests that help", "Good unit tests check one thing. They run in milliseconds & fail with a clear message. Keep <slow> tests apart.", 33),
    ("Edit distance and spelling", "Edit distance counts insertions, deletions and changes. It finds the right word for a typo.", 40),
    ("Query expansion with synonyms", "Query expansion adds synonyms to a search. It finds more, and sometimes too much.", 47),
    ("Time series storage", "A time series database stores points by time. Compression makes it small. Reads are sequential.", 60),
)


def sample_corpus(spark: SparkSession, now: int) -> DataFrame:
    """doc_id, title, body, created_at."""
    rows = [(i, t, b, now - days * 86400) for i, (t, b, days) in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "doc_id long, title string, body string, created_at long")

#: Queries over the sample corpus, whose phrases and synonyms are English.
ASKED = (
    "machine learning", "machine learning models", "natural language processing data base", "big O notation", "fast fast search", "lokups", "garbage colection",
    "neural networks in search engines", "", "!? 42", "time series storage", "inverted index lookup",
)
