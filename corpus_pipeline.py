"""A training corpus from raw documents: score, drop repeated lines, drop near copies, mix sources, tokenise.

Each stage takes (spark, docs, sf_dir), docs having the columns of `documents`, and returns a DataFrame. run() writes
what a stage returns as Parquet to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, line_dedup, near_copies, quality, source_mixing
from quern.llm.common import table, written


#: Rows that go to a Python worker at a time: whole texts of a few MB in all, held by Spark and by the worker.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def small_batches(spark: SparkSession) -> None:
    """Set for the session by the stages that run Python, also when they are called one by one; run() restores what was set before."""
    spark.conf.set(BATCH, BATCH_ROWS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, scores 0.5 or more."""
    small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, keep=True).filter("quality_score >= 0.5").select(docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates but for their first occurrence."""
    deduped = line_dedup.dedup_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return deduped.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the least doc_id; of rows that share it, one."""
    small_batches(spark)
    return near_copies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice: a document for each use that the mix makes of it."""
    return source_mixing.mix(docs).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each use of a document, their number, and digests of them and of the decoded text."""
    small_batches(spark)
    return bpe.tokenise(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: A trained classifier and SimHash have no SQL; the tests hold run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over documents."""
    docs, before = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    finally:
        spark.conf.set(BATCH, before)
    return docs
