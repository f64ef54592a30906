"""The near-duplicate stage: one row stays of the texts that SimHash links whole, or by a passage and an exact look at their similarity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import Scope, free_name, written
from quern.llm.exact_dedup import BLOCK, filter_blocks, filter_cells, is_set
from quern.llm.near_dedup import Joined, components, links, majority, shingle_hashes

#: Words of a shingle.
SHINGLE = 5
#: Passages of a text that are fingerprinted, and shingles of a passage.
PASSAGES, PASSAGE = 8, 8
#: Bits of a text's two-word signature in which candidates may differ: at a similarity of 0.8 some 19 of 128 do, give or take 4; of unlike texts 64 do.
APART = 40


def mixed(hashes: np.ndarray) -> np.ndarray:
    """A second hash of each hash: multiplied and folded, so that its bits are independent of the first one's."""
    out = hashes * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


@dataclass
class Sketch:
    fp: int  # SimHash of all shingles, repeats included
    sign: tuple[int, int]  # SimHashes of the distinct shingles, by two hashes
    size: int  # distinct shingles
    passages: np.ndarray  # SimHashes of passages


def sketch(text: str | None) -> Sketch:
    """What the search for near copies needs of a text.

    A passage starts at each of the PASSAGES shingles of least hash and is PASSAGE shingles long (less at the end of
    the text). Which ones these are depends on the shingles alone, so near copies mostly agree on them, however
    long the text, whatever stands before.
    """
    hashes = shingle_hashes(text, SHINGLE)
    if not len(hashes):
        return Sketch(0, (0, 0), 0, np.zeros(0, np.int64))
    distinct, first = np.unique(hashes, return_index=True)
    sign = majority(distinct), majority(mixed(distinct))
    at = first[:PASSAGES, None] + np.arange(PASSAGE)
    inside = at < len(hashes)
    bits = np.unpackbits(hashes[np.minimum(at, len(hashes) - 1)].view(np.uint8).reshape(*at.shape, 8), axis=2, bitorder="little")
    votes = (bits * inside[:, :, None]).sum(1, dtype=np.int64)
    passages = np.packbits(2 * votes > inside.sum(1)[:, None], axis=1, bitorder="little").view(np.int64).ravel()
    return Sketch(sign[0] if len(distinct) == len(hashes) else majority(hashes), sign, len(distinct), np.unique(passages))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have at least this Jaccard similarity."""
    common = np.intersect1d(a, b, assume_unique=True).size
    return common >= similarity * (len(a) + len(b) - common)


def near_pairs(sign: np.ndarray, size: np.ndarray, block: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose sizes and signatures (two words a row) allow this similarity; of two blocks, only the pairs between them."""
    many = block.min() != block.max()
    for i in range(0, len(size), 1024):
        for j in range(i, len(size), 1024):
            p, q = slice(i, i + 1024), slice(j, j + 1024)
            apart = np.bitwise_count(sign[p, None, 0] ^ sign[None, q, 0]) + np.bitwise_count(sign[p, None, 1] ^ sign[None, q, 1])
            less, more = np.minimum(size[p, None], size[None, q]), np.maximum(size[p, None], size[None, q])
            x, y = np.nonzero((apart <= APART) & (less >= similarity * more))
            x, y = x + i, y + j
            wanted = (x < y) & (block[x] != block[y]) if many else x < y
            yield x[wanted], y[wanted]


def tasks(rows: DataFrame, group: str, blocks: str, bundles: int) -> GroupedData:
    """rows, dealt so that two rows of a group meet in one task, by (group, low, high), with their own block in column block.

    Groups of one block are bundled, as most are small; of larger ones each pair of blocks is a task, so a row goes to as many as its group has blocks.
    """
    own = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col(blocks)))
    each = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)))
    each = each.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")
    task = F.when(F.col(blocks) == 1, F.pmod(F.xxhash64(group), F.lit(bundles))).otherwise(F.xxhash64(group, "low", "high"))
    # A number of partitions that is named stays: these rows are few bytes and much work.
    return each.withColumn("task", task).drop(blocks).repartition(min(bundles + 8, 10_000), "task").groupBy("task")


def met(rows: pd.DataFrame, group: str) -> Iterator[pd.DataFrame]:
    """The rows of a task by (group, low, high)."""
    rows = rows.sort_values([group, "low", "high"], kind="stable", ignore_index=True)
    keys = rows[[group, "low", "high"]].to_numpy(np.int64)
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(rows)], strict=True):
        if stop - start > 1:
            yield rows.iloc[start:stop]


def _signs(rows: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(rows[["sign", "sign2"]].to_numpy(np.int64)).view(np.uint64)


def candidates(nodes: DataFrame, similarity: float, most: int, block_rows: int = 2048) -> DataFrame:
    """Edges (a, b) over the fingerprints of nodes (fp, sign, sign2, size, passages), by which all candidates hang together.

    Passages whose fingerprints hang together by links at `most` bits or fewer (found by the vantage-point trees) are
    one class. Rows of one class are candidates if their sizes and signatures allow the similarity. A class of
    more than block_rows rows is dealt to blocks, of which each pair is a task of its own, so a passage may be
    in any number of texts; a task returns a spanning forest of its pairs.
    """
    held = written(nodes.select("fp", "sign", "sign2", "size", F.explode("passages").alias("passage")), "passages")
    distinct = written(held.groupBy("passage").agg(F.count("*").alias("rows")).select(F.col("passage").alias("fp"), "rows"), "passage-fingerprints")
    linked = components(links(distinct, most))
    classes = distinct.join(linked, distinct.fp == linked.node, "left").select(F.col("fp").alias("passage"), F.coalesce("component", "fp").alias("class"), "rows")
    sizes = classes.groupBy("class").agg(F.sum("rows").alias("in_class")).filter("in_class > 1")
    shared = written(classes.join(sizes, "class").select("passage", "class", "rows", F.ceil(F.col("in_class") / block_rows).alias("blocks")), "passage-classes")
    bundles = 1 + (shared.agg(F.sum("rows")).first()[0] or 0) // block_rows

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        ends = []
        for own in met(rows, "class"):
            fp, first = np.unique(own["fp"].to_numpy(np.int64), return_index=True)
            sets, sign = Joined(len(fp)), _signs(own)[first]
            for x, y in near_pairs(sign, own["size"].to_numpy()[first], own["block"].to_numpy()[first], similarity):
                sets.add(x, y)
            ends += [(fp[x], fp[y]) for x, y in sets.kept]
        none = [np.zeros(0, np.int64)]
        return pd.DataFrame({"a": np.concatenate([x for x, _ in ends] or none), "b": np.concatenate([y for _, y in ends] or none)})

    wanted = held.join(shared.drop("rows"), "passage").select("class", "blocks", "fp", "sign", "sign2", "size")
    return tasks(wanted, "class", "blocks", bundles).applyInPandas(pairs, "a long, b long")


def verified(texts: DataFrame, similarity: float, block_rows: int = 256, block_shingles: int = 1 << 21) -> DataFrame:
    """Edges (a, b) that connect all rows of texts (fp, component, sign, sign2, size, text) of one component whose Jaccard similarity over the sets of five-word shingles is at least this.

    Sets are compared by 64-bit hashes. Components with more rows or shingles than a block has go to pairs of blocks; in a task, rows that
    are connected already aren't compared again, so copies of one text cost little more than their number.
    """
    many = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_shingles))
    sizes = written(texts.groupBy("component").agg(many.alias("blocks")), "candidate-blocks")
    rows, shingles = texts.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bundles = 1 + max(rows // block_rows, shingles // block_shingles)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for own in met(rows, "component"):
            fp, text, sets = own["fp"].to_numpy(np.int64), own["text"].to_numpy(), Joined(len(own))
            hashes: dict[int, np.ndarray] = {}
            for x, y in near_pairs(_signs(own), own["size"].to_numpy(), own["block"].to_numpy(), similarity):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if sets.root[i] == sets.root[j]:
                        continue
                    for k in (i, j):
                        if k not in hashes:
                            hashes[k] = np.unique(shingle_hashes(text[k], SHINGLE))
                    if alike(hashes[i], hashes[j], similarity):
                        sets.add(np.array([i]), np.array([j]))
                        found.append((fp[i], fp[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    wanted = texts.join(sizes, "component").select("component", "blocks", "fp", "sign", "sign2", "size", "text")
    return tasks(wanted, "component", "blocks", bundles).applyInPandas(pairs, "a long, b long")


def probed(rows: DataFrame, row: str, few: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose number (column row) isn't in few (a written table with that column), and those whose number may be.

    By a Bloom filter of the numbers, bounded in size, which is broadcast: nothing of rows moves.
    """
    cells = filter_cells(few.count())
    blocks = filter_blocks(few.select(F.pmod(F.xxhash64(row), F.lit(cells)).alias("cell")))
    block, bits = free_name("block", rows.columns), free_name("bits", rows.columns)
    blocks = blocks.select(F.col("block").alias(block), F.col("bits").alias(bits))
    cell = F.pmod(F.xxhash64(row), F.lit(cells))
    looked = rows.withColumn(block, F.shiftright(cell, 15)).join(F.broadcast(blocks), block, "left")
    hit = is_set(F.col(bits), cell % BLOCK)
    return looked.filter(~hit).select(rows.columns), looked.filter(hit).select(rows.columns)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates: the one with the least id, a null id coming last; of rows that share it, one.

    Texts are linked if their SimHash fingerprints over five-word shingles differ in `most` bits or fewer, or if they are
    similar: the Jaccard similarity of their sets of five-word shingles is `similarity` or more. A group is what hangs together by links.
    Similar texts mostly differ in more bits than any tree could prune by, so they are found by their passages: eight
    short ones a text, whose fingerprints meet in the same vantage-point trees; of texts that share one, signatures
    and sizes leave candidates, and those are compared exactly. A similar pair is missed only if none of the eight passages of
    each is left whole, or if another text has the same fingerprint and stands for one of the two.

    Rows are written once with their sketch and a number of their own, from which everything else is read; only
    ids, numbers and sketches are grouped. Texts move for the exact look alone, those of candidates only. A Bloom filter of
    the numbers of the rows that go, bounded in size, is broadcast; rows that miss it stay where they are, and only those
    that hit it shuffle. Null texts count as empty; texts without words are one group. Other columns may have any names. An empty table gives an empty one.
    """
    names: list[str] = []
    for name in ("fp", "sign", "sign2", "size", "passages", "row"):
        names.append(free_name(name, [*docs.columns, *names]))
    fp, sign, sign2, size, passages, row = names
    long = T.LongType()
    added = [T.StructField(n, t) for n, t in ((fp, long), (sign, long), (sign2, long), (size, long), (passages, T.ArrayType(long)))]
    schema, where = T.StructType([*docs.schema.fields, *added]), docs.columns.index(text_col)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sketch(x.as_py()) for x in batch.column(where)]
            words = np.array([(s.fp, *s.sign) for s in found], np.uint64).reshape(-1, 3).view(np.int64)
            columns = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(3)]
            columns += [pa.array([s.size for s in found], pa.int64()), pa.array([s.passages for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names[:5]])

    with Scope() as scope:
        rows = scope.kept(docs.mapInArrow(sketched, schema).withColumn(row, F.monotonically_increasing_id()), "near-copies-rows")
        narrow = rows.select(F.col(id_col).alias("doc_id"), *(F.col(n).alias(m) for n, m in zip(names, ("fp", "sign", "sign2", "size", "passages", "row"), strict=True)))
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
        firsts = narrow.groupBy("fp").agg(F.min(F.struct(order.alias("first"), "sign", "sign2", "size", "passages")).alias("least"))
        nodes = written(firsts.select("fp", "least.*"), "near-copies-nodes")

        near = components(written(candidates(nodes, similarity, most), "near-copies-candidates"))
        looked_at = nodes.join(near, nodes.fp == near.node).select("fp", F.col("first.row").alias(row), "sign", "sign2", "size", "component")
        looked_at = written(looked_at, "near-copies-looked-at")
        texts = probed(rows.select(row, F.col(text_col).alias("text")), row, looked_at)[1].join(looked_at, row).drop(row)
        edges = links(nodes.select("fp"), most).unionByName(verified(written(texts, "near-copies-texts"), similarity))
        group = components(written(edges, "near-copies-links"))

        named = nodes.join(group, nodes.fp == group.node, "left").select(F.coalesce("component", "fp").alias("component"), "first")
        stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
        gone = scope.kept(rows.select(row).join(stay, row, "left_anti"), "near-copies-gone")
    alone, maybe = probed(rows.select(*docs.columns, row), row, gone)
    return alone.select(docs.columns).unionByName(maybe.join(gone, row, "left_anti").select(docs.columns))
