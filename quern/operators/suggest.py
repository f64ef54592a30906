"""Autocomplete over titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.stem import query_stems


def complete(prefixes: DataFrame, completions: DataFrame, limit: int = 6) -> DataFrame:
    """qid, term, weight, rank for prefixes(qid, prefix): the heaviest terms with the prefix; ties to the smaller term.

    Joined on the first character, so prefixes meet only terms that share it.
    """
    first = lambda c: F.substring(c, 1, 1)
    asked = prefixes.filter("prefix <> ''").select("qid", "prefix", first("prefix").alias("head"))
    met = completions.withColumn("head", first("term")).join(asked, "head").filter(F.startswith("term", F.col("prefix")))
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "term")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "term", "weight", "rank")


def suggest(inputs: DataFrame, completions: DataFrame, limit: int = 6) -> DataFrame:
    """qid, term, weight, rank for inputs(qid, raw): several words complete whole titles, one word completes stems as well.

    Phrase terms are left out after the limit, so fewer may come back. Empty inputs give nothing.
    """
    plain = F.lower(X.collapse(F.col("raw")))
    one_word = F.get(query_stems(F.array("plain")), 0)
    asked = inputs.select("qid", plain.alias("plain")).select("qid", F.when(F.contains("plain", F.lit(" ")), F.col("plain")).otherwise(one_word).alias("prefix"))
    return complete(asked, completions, limit).filter(~F.contains("term", F.lit(X.JOINER)))
