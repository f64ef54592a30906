"""What the operators of this subpackage share: reading tables, sampling, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import Scope as Scope  # what releases their tables
from quern.sources.scratch import written as written  # what the operators cut lineage with


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark's reader ever opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column in `taken` has it (whatever the case of its letters)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled_ids(rows: DataFrame, by: str, per_class: int, doc_id: str = "doc_id") -> DataFrame:
    """At most per_class ids of each value of `by`: of each of per_class hash slots the id with the least hash.

    A plain aggregate, so it is combined before the shuffle and no value of `by` is gathered in one task.
    """
    hashed = F.xxhash64(F.col(doc_id), F.lit("sample"))
    return (
        rows.select(F.col(doc_id).alias("doc_id"), F.col(by).alias("class"), hashed.alias("h"))
        .groupBy("class", F.pmod("h", F.lit(per_class)).alias("slot"))
        .agg(F.min(F.struct("h", "doc_id")).alias("least"))
        .select("class", F.col("least.doc_id").alias("doc_id"))
    )
