"""Exact deduplication with two passes of Bloom filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_of, written

#: Bits in one block of the filter: what bitmap_construct_agg packs into one binary value.
BLOCK = 1 << 15


def filter_cells(rows: int, bits_per_row: int = 16, max_bytes: int = 1 << 26) -> int:
    """Cells of a filter for so many rows: a power of two that max_bytes bounds."""
    wanted = max(BLOCK, rows * bits_per_row)
    return min(1 << (wanted - 1).bit_length(), 1 << ((max_bytes * 8).bit_length() - 1))


def filter_blocks(cells: DataFrame) -> DataFrame:
    """block, bits: the filter in which the cells of a table (column cell) are set."""
    return cells.groupBy(F.shiftright("cell", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("cell") % BLOCK).alias("bits"))


def is_set(bits: Column, at: Column) -> Column:
    """Whether bit `at` of a block is set; not, where there is no block."""
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def may_hold(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with a boolean column again: false only where the key, a 64-bit hash, is in no row of keys (a written table with a column of that name).

    By a Bloom filter of the keys, whose bound filter_cells() sets, broadcast; nothing of rows moves.
    """
    cells = filter_cells(keys.count())
    blocks = filter_blocks(keys.select(F.pmod(key, F.lit(cells)).alias("cell")))
    cell = F.pmod(key, F.lit(cells))
    probed = rows.join(F.broadcast(blocks), F.shiftright(cell, 15) == F.col("block"), "left")
    return probed.withColumn("again", is_set(F.col("bits"), cell % BLOCK)).drop("block", "bits")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_filter_bytes: int = 1 << 26) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    Pass 1 counts, for each cell of a Bloom filter (bits_per_row cells a row), how many rows hash to it. Only cell
    numbers move, summed in each task first. The cells that two or more rows hit are packed into bitmaps. Pass 2
    probes these bitmaps, which are broadcast; they never exceed max_filter_bytes. Rows that miss are alone and pass
    straight through; only rows that hit shuffle, for an exact grouping by SHA-256. Where the bound on the filter
    makes it too small for the rows, more rows shuffle and the result is the same.

    Null texts count as empty. Null ids are smaller than all others. Of rows with equal text and equal id exactly one
    stays. Texts may be of any length: only their digests move. Other columns of docs are ignored.
    Returns doc_id, keep_id, group_size, kept, text_sha256; a row for each row of docs.
    """
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_of(text_col).cast("binary"), 256).alias("text_sha256"))
        .withColumn("row", F.monotonically_increasing_id()),
        "exact-dedup-hashes",
    )
    cells = filter_cells(rows.count(), bits_per_row, max_filter_bytes)
    cell = F.pmod(F.xxhash64("text_sha256"), F.lit(cells))
    repeated = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).filter("n > 1")
    probed = (
        rows.withColumn("cell", cell)
        .withColumn("block", F.shiftright("cell", 15))
        .join(F.broadcast(filter_blocks(repeated)), "block", "left")
        .withColumn("again", is_set(F.col("bits"), F.col("cell") % BLOCK))
        .select("doc_id", "text_sha256", "row", "again")
    )
    alone = probed.filter(~F.col("again")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = probed.filter("again")
    groups = maybe.groupBy("text_sha256").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("group_size"))
    groups = written(groups, "exact-dedup-groups")  # so that both sides of the join are plain exchanges, of which a hot one is split
    grouped = maybe.join(groups, "text_sha256").select(
        "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(grouped)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
