"""Exact inner-product search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

#: Scaled components beyond this are added as Python's whole numbers, which don't overflow.
SAFE = 1 << 24
NO_FLOOR = -(1 << 63)


def scaled(vector: Column) -> Column:
    """floor(1024 * x) of each component, as a double, which is whole."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024).cast("double"))


def usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def _steps(dims: int, step: int) -> list[slice]:
    return [slice(a, a + step) for a in range(0, dims, step)] or [slice(0, 0)]


def block_masses(columns: np.ndarray, step: int = 16) -> np.ndarray:
    """Squared length of each candidate in each block of dimensions."""
    return np.stack([(columns[s].astype(np.float64) ** 2).sum(0) for s in _steps(len(columns), step)])


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, columns: np.ndarray, ids: np.ndarray, k: int, step: int = 16, floors: np.ndarray | None = None, masses: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the k best candidates of a block that reach its floor, if floors are given: (its place, ids, scores).

    columns: the candidates' components, one row a dimension. Dimensions are taken a block of `step` at a time, those
    where the query has most mass first. A candidate stays only while its sum so far plus the product of both
    remaining norms (no inner product exceeds that) can still reach the k-th best; survivors are compacted.
    The k candidates that lead after the first block are scored in full to have that k-th best early. masses: of block_masses(), if known.
    """
    dims, many = columns.shape
    steps = _steps(dims, step)
    masses = block_masses(columns, step) if masses is None else masses
    whole = masses.sum(0)
    for place, (query, own) in enumerate(zip(queries, query_ids, strict=True)):
        parts = [query[s] for s in steps]
        weight = np.array([(p.astype(np.float64) ** 2).sum() for p in parts])
        order = np.argsort(-weight, kind="stable")
        alive = np.flatnonzero(ids != own)
        sums = np.zeros(len(alive), np.int64)
        left = whole[alive]
        given = NO_FLOOR if floors is None else int(floors[place])
        floor = None
        for nth, b in enumerate(order):
            rows = columns[steps[b]]
            sums += parts[b] @ (rows if len(alive) == many else rows[:, alive])
            left = left - masses[b][alive]
            if nth + 1 == len(order) or len(alive) <= k:
                continue
            if floor is None:
                lead = alive[np.argpartition(-sums, k - 1)[:k]]
                floor = max(given, int((query @ columns[:, lead]).min()))
            bound = np.sqrt(np.maximum(left, 0) * weight[order[nth + 1 :]].sum()) * (1 + 1e-9) + 1
            stays = sums + bound >= floor
            alive, sums, left = alive[stays], sums[stays], left[stays]
        reached = sums >= given
        alive, sums = alive[reached], sums[reached]
        if len(alive) > k:
            least = np.partition(-sums, k - 1)[k - 1]
            tied = -sums <= least
            alive, sums = alive[tied], sums[tied]
            best = np.lexsort((ids[alive], -sums))[:k]
            alive, sums = alive[best], sums[best]
        yield place, ids[alive], sums


def _plain(queries: list, query_ids: np.ndarray, rows: list, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same for components of any size, one pair after the other; scores beyond 64 bits are held at their ends."""
    most = (1 << 63) - 1
    for place, (query, own) in enumerate(zip(queries, query_ids, strict=True)):
        q = [int(x) for x in query]
        found = sorted((-sum(a * int(b) for a, b in zip(q, row, strict=True)), i) for row, i in zip(rows, ids, strict=True) if i != own)[:k]
        yield place, np.array([i for _, i in found], np.int64), np.array([max(-most - 1, min(most, -s)) for s, _ in found], np.int64)


class Block:
    """Candidates of one block and one length, laid out vertically once for all queries that stream past."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int) -> None:
        self.ids, self.rows = ids, rows
        self.safe = np.abs(rows).max(initial=0) < SAFE
        self.columns = np.ascontiguousarray(rows.T.astype(np.int64)) if self.safe else None
        self.masses = block_masses(self.columns) if self.safe else None
        # So many rows hold k different ids, however often one is repeated.
        self.k = k * (int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1)

    def search(self, ids: np.ndarray, rows: np.ndarray, floors: np.ndarray) -> pa.RecordBatch:
        if not len(self.ids):
            found = []
        elif self.safe and np.abs(rows).max(initial=0) < SAFE:
            found = list(search_block(rows.astype(np.int64), ids, self.columns, self.ids, self.k, floors=floors, masses=self.masses))
        else:
            found = list(_plain(rows.tolist(), ids, self.rows.tolist(), self.ids, self.k))
        many = [len(i) for _, i, _ in found]
        columns = [np.repeat(ids[[p for p, _, _ in found]], many), np.concatenate([i for _, i, _ in found]), np.concatenate([s for _, _, s in found])] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])


def meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come in order of block, length and role: a block's candidates, then the queries for it, a batch of them at a time."""
    at, held, block = None, [], None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cb", "dim", "asks")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = batch.slice(a, b - a)
            cb, dim, asks = keys[a].tolist()
            if at != (cb, dim):
                at, held, block = (cb, dim), [], None
            ids = own.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
            rows = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)
            if not asks:
                held.append((ids, rows))
                continue
            if block is None:
                block = Block(np.concatenate([i for i, _ in held] or [np.zeros(0, np.int64)]), np.concatenate([r for _, r in held] or [np.zeros((0, dim))]), k)
                held = []
            yield block.search(ids, rows, own.column("floor").to_numpy(zero_copy_only=False).astype(np.int64))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", candidate_block: int = 16_384) -> DataFrame:
    """The k vectors with the largest integer inner product for each query; ties to the smaller id.

    Candidates are dealt once, by a hash of the id, into blocks of about candidate_block rows, as many as the table needs. A task lays a
    block out vertically and lets the queries stream past it, so it holds one block and a batch of queries. All queries first meet block 0,
    a random part of the candidates; the k-th best score there goes with each query to all other blocks, as a floor that
    bounds prune by from the start and below which nothing is handed on. Of each block at most k rows a query go on (more only if ids are
    repeated); these are ranked per query. Every query has to be compared with every candidate, so queries are copied once for each block.

    Vectors null or holding a null, NaN or infinite component take no part; neither do rows with a null id. Only vectors
    of the same length are compared; two empty ones have score 0. A query's own id is no candidate, and an id that is
    repeated counts once, with its best score. Other columns are ignored, whatever their names. Empty tables give an empty one. Returns query_id, rank, vec_id, score.
    """
    pick = lambda df: df.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col)).alias("v"), F.size(vector_col).alias("dim"))
    rows, asked = written(pick(vectors), "vectors"), written(pick(queries), "query-vectors")
    blocks = max(1, -(-rows.count() // candidate_block))
    dealt = rows.withColumn("cb", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(0)).withColumn("floor", F.lit(NO_FLOOR))
    columns = ["cb", "dim", "asks", "id", "v", "floor"]

    def search(first: int, until: int, asked: DataFrame) -> DataFrame:
        asking = asked.withColumn("cb", F.explode(F.sequence(F.lit(first), F.lit(until - 1)))).withColumn("asks", F.lit(1))
        both = dealt.filter(F.col("cb").between(first, until - 1)).select(columns).unionByName(asking.select(columns))
        ordered = both.repartition("cb", "dim").sortWithinPartitions("cb", "dim", "asks")
        return ordered.mapInArrow(lambda batches: meet(batches, k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda near: near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = written(ranked(search(0, 1, asked.withColumn("floor", F.lit(NO_FLOOR)))), "nearest-first")
    if blocks > 1:
        floors = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        floored = written(asked.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR))), "query-floors")
        near = found.select("query_id", "vec_id", "score").unionByName(search(1, blocks, floored))
        found = ranked(near)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
