"""SimHash near-duplicates: exact pairs by vantage-point trees, then connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import written

WIDTH = 64
#: Hashes that are voted on at a time.
CHUNK = 1 << 16
LANES = np.uint64(0x0101010101010101)
#: Edges of which the driver makes components: 4 MB.
FEW = 250_000
COMPONENTS = pa.schema([("node", pa.int64()), ("component", pa.int64())])


def _votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, lowest bit first: bits are added up in the eight byte lanes of a word, 255 words at a time."""
    out = np.zeros((8, 8), np.int64)
    starts = np.arange(0, len(hashes), 255)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, starts)
        out[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(0)
    return out.reshape(WIDTH)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, in order of the text, repeats included.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; shingles are `width` words joined by
    spaces. Fewer words make one shingle; none at all give none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    begins = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - width + 1)
    starts, stops = begins[:count].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], 42) for i, j in zip(starts, stops, strict=True)), np.uint64, count)


def majority(hashes: np.ndarray) -> int:
    """The word whose bit b is set if it is set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    votes = np.zeros(WIDTH, np.int64)
    for a in range(0, len(hashes), CHUNK):
        votes += _votes(hashes[a : a + CHUNK])
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of a text over its word shingles, repeats included; 0 without words."""
    return majority(shingle_hashes(text, width))


def _column_of(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts)).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row; texts are hashed where they are read."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _column_of(batch.column("text"))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


@dataclass
class Tree:
    """A vantage-point tree over part of the bits: node n has children 2n+1 (within its radius) and 2n+2 (beyond it)."""

    mask: int
    reach: int  # two linked fingerprints differ in so many of these bits at most, or the other tree has them
    points: np.ndarray
    radii: np.ndarray

    @property
    def leaves(self) -> int:
        return len(self.points) + 1


def grow(sample: np.ndarray, depth: int, mask: int, reach: int) -> Tree:
    """Choose vantage points and median radii from a sample; the depth fixes the number of leaves."""
    nodes = (1 << depth) - 1
    points, radii = np.zeros(nodes, np.uint64), np.full(nodes, WIDTH, np.int64)
    held = {0: sample & np.uint64(mask)}
    for n in range(nodes):
        own = held.pop(n, np.zeros(0, np.uint64))
        if len(own):
            # Of a few, the one whose distances cross the boundary least is the vantage point.
            best = None
            for candidate in own[:: max(1, len(own) // 8)][:8]:
                far = np.bitwise_count(own ^ candidate).astype(np.int64)
                radius = int(np.median(far))
                crossing = np.mean((far > radius - reach) & (far <= radius + reach)) + abs(np.mean(far <= radius) - 0.5)
                if best is None or crossing < best[0]:
                    best = (crossing, candidate, radius, far)
            _, points[n], radii[n], far = best
            held[2 * n + 1], held[2 * n + 2] = own[far <= radii[n]], own[far > radii[n]]
    return Tree(mask, reach, points, radii)


def route(tree: Tree, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, leaf) for every leaf that can hold a fingerprint within `reach`; with reach 0, the home leaf alone.

    At a vantage point v of radius r, triangle bounds leave out a side: what is within r of v can be near x only if
    d(x, v) - reach <= r, what is beyond only if d(x, v) + reach > r.
    """
    masked = fps & np.uint64(tree.mask)
    todo, found = [(0, np.arange(len(fps)))], []
    while todo:
        n, own = todo.pop()
        if not len(own):
            continue
        if n >= len(tree.points):
            found.append((own, np.full(len(own), n - len(tree.points))))
            continue
        far = np.bitwise_count(masked[own] ^ tree.points[n]).astype(np.int64)
        todo.append((2 * n + 1, own[far - reach <= tree.radii[n]]))
        todo.append((2 * n + 2, own[far + reach > tree.radii[n]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Joined:
    """Disjoint sets over 0..n-1; keeps the pairs that joined two sets, a spanning forest of all pairs seen."""

    def __init__(self, n: int) -> None:
        self.root, self.kept = np.arange(n), []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Merge many pairs at once: each round hangs larger roots below smaller ones, then flattens."""
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            high, low = np.maximum(x, y), np.minimum(x, y)
            _, first = np.unique(high, return_index=True)
            self.kept.append((a[first], b[first]))
            self.root[high[first]] = low[first]
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def linked_in(home: np.ndarray, asking: np.ndarray, most: int, mask: int = (1 << WIDTH) - 1, reach: int | None = None, leaf: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (asking, home) at `most` or fewer differing bits, of which the bits of mask hold `reach` (all, if None) at most.

    By a tree over the shard's own rows and these bits; where they are so alike that it has a leaf of over a quarter of the rows, by one over all bits.
    """
    reach = most if reach is None else reach
    depth = max(0, (max(1, len(home)) // leaf).bit_length())
    sample = home[:: max(1, len(home) // max(4096, 4 << depth))]
    tree = grow(sample, depth, mask, reach)
    if depth > 2 and np.bincount(route(tree, sample, 0)[1]).max() > len(sample) / 4:
        tree, reach = grow(sample, depth, (1 << WIDTH) - 1, most), most
    both = np.unique(np.concatenate([home, asking]))
    sets = Joined(len(both))
    at_home, home_leaf = route(tree, home, 0)
    ask, ask_leaf = route(tree, asking, reach)
    at_home, ask = at_home[np.argsort(home_leaf, kind="stable")], ask[np.argsort(ask_leaf, kind="stable")]
    home_ends = np.cumsum(np.bincount(home_leaf, minlength=tree.leaves))
    ask_ends = np.cumsum(np.bincount(ask_leaf, minlength=tree.leaves))
    for h0, h1, a0, a1 in zip(np.r_[0, home_ends[:-1]], home_ends, np.r_[0, ask_ends[:-1]], ask_ends, strict=True):
        for h in range(h0, h1, 1024):
            own = home[at_home[h : min(h + 1024, h1)]]
            for a in range(a0, a1, 1024):
                other = asking[ask[a : min(a + 1024, a1)]]
                x, y = np.nonzero(np.bitwise_count(other[:, None] ^ own[None, :]) <= most)
                x, y = np.searchsorted(both, other[x]), np.searchsorted(both, own[y])
                apart = x < y  # each pair is met from both ends
                sets.add(x[apart], y[apart])
    if not sets.kept:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return both[np.concatenate([a for a, _ in sets.kept])], both[np.concatenate([b for _, b in sets.kept])]


def links(fps: DataFrame, most: int = 3, shard_rows: int = 32_768, sample_rows: int = 16_384, sampled_a_leaf: int = 16) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) at `most` or fewer differing bits; no link is lost.

    The bits are halved. Of `most` differences one half has most // 2 at most, so each half has a vantage-point tree
    of its own, over the Hamming distance on that half, with that as its search reach: the smaller it is, the fewer
    fingerprints lie near a boundary. A tree of a sample deals the fingerprints to shards of about shard_rows; each one goes to its
    home shard and, as a query, to all shards whose side of every boundary overlaps its reach. What the trees copy grows with
    their depth, so shards are as large as one task holds with ease, and are searched through a tree of their own over the same half. A shard
    returns a spanning forest of its pairs, so edges are fewer than its rows however many near copies it holds.

    The sample has sample_rows fingerprints or, if that is more, sampled_a_leaf for each shard: of a thousand million fingerprints half a million.
    """
    rows = fps.count()
    depth = max(0, (rows // shard_rows).bit_length())
    taken = fps.orderBy(F.xxhash64("fp")).limit(max(sample_rows, sampled_a_leaf << depth)).collect() if depth else []
    sample = np.array([r.fp for r in taken], np.int64).view(np.uint64)
    reach = most // 2
    trees = [grow(sample, depth, mask, reach) for mask in ((1 << 32) - 1, ((1 << 32) - 1) << 32)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            for k, tree in enumerate(trees):
                home = np.zeros(len(own), np.int64)
                at, leaf = route(tree, own.view(np.uint64), 0)
                home[at] = leaf
                at, leaf = route(tree, own.view(np.uint64), reach)
                yield pd.DataFrame({"shard": k * tree.leaves + leaf, "fp": own[at], "home": home[at] == leaf})

    leaves, masks = trees[0].leaves, [t.mask for t in trees]

    def search(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        own = shard["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = linked_in(own[shard["home"].to_numpy()], own, most, masks[int(key[0]) // leaves], reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = fps.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a long, b long")


def _joined(edges: DataFrame) -> DataFrame:
    """What components() gives, from edges that the driver holds."""
    ends = edges.toArrow()
    a, b = (ends[c].to_numpy() for c in ("a", "b"))
    nodes = np.unique(np.concatenate([a, b]))
    sets = Joined(len(nodes))
    sets.add(np.searchsorted(nodes, a), np.searchsorted(nodes, b))
    found = pa.table({"node": nodes, "component": nodes[sets.root]}, schema=COMPONENTS)
    return edges.sparkSession.createDataFrame(found)


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, component for each node of the edges (a, b): the least node that it is connected with.

    Up to `few` edges are joined by the driver, as each round's plans and broadcasts cost it more memory than these. With more, each
    round every node takes the least label among its own, its neighbours' and its label's label, so labels travel
    twice as far each time; sums and minima are combined before each shuffle. A round's table is written, and the
    rounds end when no label changed.
    """
    edges = written(edges.select("a", "b").distinct(), "links")
    if edges.count() <= few:
        return written(_joined(edges), "labels")
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = edges.select(ends.alias("e")).select("e.a", "e.b")
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")), "labels")
    while True:
        offered = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label")
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        hung = labels.join(above, "label").select("node", F.col("up").alias("label"))
        # The root of a node whose neighbour knows a smaller label learns of it as well.
        roots = offered.withColumnRenamed("label", "offer").join(labels, "node").select(F.col("label").alias("node"), F.col("offer").alias("label"))
        then = offered.union(hung).union(roots).groupBy("node").agg(F.min("label").alias("label"))
        new = written(then.join(labels.withColumnRenamed("label", "old"), "node").select("node", F.least("label", "old").alias("label"), (F.col("label") < F.col("old")).alias("moved")), "labels")
        moved = not new.filter("moved").isEmpty()
        labels = new.select("node", "label")
        if not moved:
            break
    return labels.select("node", F.col("label").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3) -> DataFrame:
    """The fingerprint of each row and the component it belongs to, by links at `most` or fewer differing bits.

    Equal fingerprints are one node from the start, so a group of copies of any size is one row in every search and
    edge table. component_id is the least doc_id of all rows reachable. Null texts count as empty; empty texts have
    fingerprint 0 and link like all others. Null ids are kept, and only make a component_id if nothing else does. Rows
    with the same id and different texts are rows of their own. Other columns are ignored.
    Returns doc_id, fingerprint (16 lower-case hexadecimal digits), component_id; a row for each row of docs.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    named = written(named_components(rows, most), "fingerprint-names")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named_components(rows: DataFrame, most: int = 3) -> DataFrame:
    """fp, component (a fingerprint of it) and component_id for each fingerprint of rows (doc_id, fp)."""
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fingerprint-nodes")
    comp = components(links(nodes, most))
    tied = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    tied = written(tied, "fingerprint-components")
    least = written(tied.groupBy("component").agg(F.min("least_id").alias("component_id")), "component-ids")  # so that a giant component is split in the join
    return tied.join(least, "component").select("fp", "component", "component_id")
