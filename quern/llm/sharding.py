"""Sharding by jump consistent hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import text_of, written


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last jump below `shards` in the key's own pseudo-random sequence of jumps.

    Appending a shard can only add one more jump, to the new shard; no table is kept.
    """
    state = keys.astype(np.uint64).copy()
    at = np.zeros(len(state), np.int64)
    then = np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while len(moving):
        at[moving] = then[moving]
        with np.errstate(over="ignore"):
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        then[moving] = ((at[moving] + 1) * (2147483648.0 / draw)).astype(np.int64)
        moving = moving[then[moving] < shards]
    return at


def shard_of(shards: int):
    """An Arrow-batched function from a long key to its shard; a null key goes to shard 0."""

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        known = keys.notna().to_numpy()
        out = np.zeros(len(keys), np.int32)
        out[known] = jump_hash(keys[known].to_numpy().astype(np.int64), shards)
        return pd.Series(out)

    return place


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Put each row into a shard by its id alone, and number the rows of each shard from 0 without gaps.

    Slots follow (doc_id, size, text_crc32). Rows are dealt by range of (shard, doc_id, ...), with the row's own number
    last so that a repeated id is split too. In a sorted partition the rows of a shard stand together, so a slot is
    the row's offset in its run plus the lengths of the runs before; that table has a line for each partition and shard
    at most. Only ids and numbers move, never texts.

    Null ids go to shard 0 and come first; null texts have size 1 and the CRC of the empty text. Other columns are ignored.
    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard.
    """
    spark = docs.sparkSession
    data = text_of(text_col).cast("binary")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("bytes"), F.crc32(data).alias("text_crc32"))
    placed = narrow.select(
        "doc_id", (F.col("bytes") + 1).alias("size"), "text_crc32", shard_of(shards)("doc_id").alias("shard"), shard_of(shards + 1)("doc_id").alias("grown_shard")
    )
    order = ["shard", "doc_id", "size", "text_crc32", "given"]
    dealt = written(placed.withColumn("given", F.monotonically_increasing_id()), "shards")
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = written(
        dealt.repartitionByRange(count, *order).sortWithinPartitions(*order).drop("given").withColumn("row", F.monotonically_increasing_id()), "shard-runs"
    )
    part = F.shiftright("row", 33)
    lengths = runs.groupBy("shard", part.alias("part")).agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = lengths.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).select("shard", "part", "base")
    return (
        runs.withColumn("part", part)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("row") + F.col("base")).alias("slot"), "grown_shard")
    )


def oracle(shards: int = 16) -> str:
    """DuckDB SQL for shard(): the jumps as a recursive query, in 128-bit arithmetic taken modulo 2^64."""
    law = """
  jumps{n}(doc_id, state, shard, nxt) AS (
    SELECT DISTINCT doc_id, (doc_id::HUGEINT + CASE WHEN doc_id < 0 THEN 18446744073709551616 ELSE 0 END)::UHUGEINT, 0::BIGINT, 0::BIGINT FROM documents
    UNION ALL
    SELECT doc_id, s, nxt, floor((nxt + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT doc_id, nxt, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM jumps{n} WHERE nxt < {n})
  ), law{n} AS (SELECT doc_id, max(shard) AS shard FROM jumps{n} GROUP BY doc_id)"""
    return f"""WITH RECURSIVE {law.format(n=shards)}, {law.format(n=shards + 1)},
  rule AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS line),
  sized AS (
    SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
           xor(4294967295, list_reduce(
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, b: xor(c // 256, line[xor(c, b) % 256 + 1]), 4294967295::BIGINT)) AS text_crc32
    FROM documents, rule)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, a.shard::INT AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY d.doc_id, d.size) - 1 AS slot, b.shard::INT AS grown_shard
FROM sized d JOIN law{shards} a USING (doc_id) JOIN law{shards + 1} b USING (doc_id)"""
