"""Quality classifier: gated-attention multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import free_name, held_out, sampled_ids, written

#: Bytes of a passage, hashed pairs of bytes, bins in which runs of four bytes are told apart, bytes that are encoded at a time.
PASSAGE, PAIRS, RUNS, STRETCH = 512, 256, 1024, 1 << 18
#: Kinds of bytes whose parts are features: a-z, A-Z, digits, white space, line feeds, two groups of marks, bytes of other letters.
KINDS = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'-", b"!?\"()", bytes(range(128, 256)))
_KIND = np.full(256, len(KINDS), np.uint8)  # all other bytes
for _n, _bytes in enumerate(KINDS):
    _KIND[list(_bytes)] = _n
WIDTH = PAIRS + len(KINDS) + 3


def encode(block: np.ndarray) -> np.ndarray:
    """Features of passages (rows of PASSAGE bytes, 0 behind the end): pairs of bytes, kinds of bytes, variety, length."""
    rows = len(block)
    there = block != 0
    long = np.maximum(there.sum(1, keepdims=True), 1).astype(np.float32)
    at = np.arange(rows, dtype=np.int64)[:, None]

    def bins(hashes: np.ndarray, many: int, valid: np.ndarray) -> np.ndarray:
        place = at * (many + 1) + np.where(valid, hashes, many)
        return np.bincount(place.ravel(), minlength=rows * (many + 1)).reshape(rows, many + 1)[:, :many]

    b = block.astype(np.uint32)
    pair = ((b[:, :-1] << np.uint32(8) | b[:, 1:]) * np.uint32(2654435761)) >> np.uint32(24)
    pairs = bins(pair, PAIRS, there[:, 1:])
    four = (b[:, :-3] << np.uint32(24) | b[:, 1:-2] << np.uint32(16) | b[:, 2:-1] << np.uint32(8) | b[:, 3:]) * np.uint32(2654435761) >> np.uint32(22)
    runs = bins(four, RUNS, there[:, 3:])
    kinds = bins(_KIND[block], len(KINDS) + 1, there)
    out = np.empty((rows, WIDTH), np.float32)
    out[:, :PAIRS] = np.sqrt(pairs / long)
    out[:, PAIRS : PAIRS + len(KINDS) + 1] = kinds / long
    out[:, -2] = np.count_nonzero(runs, axis=1) / long[:, 0]
    out[:, -1] = long[:, 0] / PASSAGE
    return out


def bags(texts: list[str | None]) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """(first text, passages of each text, features) for runs of texts of about STRETCH bytes; an empty text has one empty passage."""
    held: list[bytes] = []
    first, size = 0, 0

    def flush() -> tuple[int, list[int], np.ndarray]:
        counts = [max(1, -(-len(d) // PASSAGE)) for d in held]
        padded = b"".join(d + bytes(n * PASSAGE - len(d)) for d, n in zip(held, counts, strict=True))
        block = np.frombuffer(padded, np.uint8).reshape(-1, PASSAGE)
        step = STRETCH // PASSAGE
        return first, counts, np.concatenate([encode(block[a : a + step]) for a in range(0, len(block), step)])

    for n, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "replace").replace(b"\0", b"\x01"))
        size += len(held[-1])
        if size >= STRETCH:
            yield flush()
            held, size, first = [], 0, n + 1
    if held:
        yield flush()


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    """Encoder (one layer over scaled features), gated attention (content and gate layers) and the head over the weighted passage."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Score of each document from the features of its passages, which stand together."""
        w = self.weights
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        scaled = (x - self.mean) / self.scale
        h = np.tanh(scaled @ w["encode"] + w["encode0"])
        content, gate = np.tanh(h @ w["content"]), _squash(h @ w["gate"])
        e = (content * gate) @ w["attend"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        p = _squash(z @ w["head"] + w["head0"])
        if cache is not None:
            cache |= {"starts": starts, "scaled": scaled, "h": h, "content": content, "gate": gate, "a": a, "z": z}
        return p

    def gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted mean log loss."""
        w, c = self.weights, {}
        p = self.forward(x, counts, c)
        d_logit = (p - label) * weight / weight.sum()
        d_z = d_logit[:, None] * w["head"]
        far = np.repeat(d_z, counts, axis=0)
        d_a = (far * c["h"]).sum(1)
        d_e = c["a"] * (d_a - np.repeat(np.add.reduceat(c["a"] * d_a, c["starts"]), counts))
        d_both = d_e[:, None] * w["attend"]
        d_content = d_both * c["gate"] * (1 - c["content"] ** 2)
        d_gate = d_both * c["content"] * c["gate"] * (1 - c["gate"])
        d_h = (c["a"][:, None] * far + d_content @ w["content"].T + d_gate @ w["gate"].T) * (1 - c["h"] ** 2)
        return {
            "head": c["z"].T @ d_logit, "head0": d_logit.sum(keepdims=True), "attend": (c["content"] * c["gate"]).T @ d_e,
            "content": c["h"].T @ d_content, "gate": c["h"].T @ d_gate, "encode": c["scaled"].T @ d_h, "encode0": d_h.sum(0),
        }


def constant(share: float) -> Model:
    """Scores every document with the share of label 1: for labels that have one class only, or none."""
    shapes = {"encode": (WIDTH, 1), "encode0": (1,), "content": (1, 1), "gate": (1, 1), "attend": (1,), "head": (1,)}
    zero = {k: np.zeros(s, np.float32) for k, s in shapes.items()}
    odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
    return Model(np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), zero | {"head0": np.array([odds], np.float32)})


def fit(x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray, hidden: int = 32, gates: int = 16, epochs: int = 40, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4) -> Model:
    """Adam over batches of documents, from a fixed seed."""
    rng = np.random.default_rng(7)
    draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    w = {
        "encode": draw(WIDTH, hidden), "encode0": np.zeros(hidden, np.float32), "content": draw(hidden, gates), "gate": draw(hidden, gates),
        "attend": draw(gates, 1)[:, 0], "head": draw(hidden, 1)[:, 0], "head0": np.zeros(1, np.float32),
    }
    model = Model(x.mean(0), x.std(0) + 1e-2, w)
    ends = np.cumsum(counts)
    spans = [np.arange(e - n, e) for e, n in zip(ends, counts, strict=True)]
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(counts))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            g = model.gradients(x[np.concatenate([spans[k] for k in own])], counts[own], label[own], weight[own])
            step += 1
            for k, v in w.items():
                d = g[k] + decay * v * (v.ndim > 1)
                first[k] += 0.1 * (d - first[k])
                second[k] += 0.001 * (d * d - second[k])
                v -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = 2000, most_passages: int = 60_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled documents that aren't held out.

    At most docs_per_label documents of each label, chosen by hash, are read and encoded on the executors; the driver
    takes them in order of their hashes as long as most_passages holds. Classes count by their share of all labels. Null
    labels and ids are left out; an id that is labelled more than once has its mean label, 0.5 or more counting as 1.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if len(shares) < 2:
        return constant(float(max(shares, default=1)))
    chosen = sampled_ids(known, "label", docs_per_label).select("doc_id", F.col("class").alias("label"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, counts, x in bags(batch.column("text").to_pylist()):
                parts = np.split(x, np.cumsum(counts)[:-1])
                own = batch.slice(first, len(counts))
                columns = [own.column("doc_id"), own.column("label"), pa.array(counts, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "label", "passages", "x"])

    sample = written(rows.select("doc_id", "label", "text").mapInArrow(encoded, "doc_id long, label int, passages long, x binary"), "quality-sample")
    sizes = sample.select("doc_id", "passages", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    taken, total = [], 0
    for r in sizes:
        if total + r.passages <= most_passages:
            taken.append(r.doc_id)
            total += r.passages
    fits = docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")
    found = sorted(sample.join(F.broadcast(fits), "doc_id").select("doc_id", "label", "passages", "x").collect(), key=lambda r: r.doc_id)
    have = {k: sum(r.label == k for r in found) for k in (0, 1)}
    if not all(have.values()):
        return constant(shares[1] / sum(shares.values()))
    label = np.array([r.label for r in found], np.float32)
    weight = np.array([shares[r.label] / have[r.label] for r in found], np.float32)
    x = np.concatenate([np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in found])
    return fit(x, np.array([r.passages for r in found]), label, weight / weight.mean())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, from its whole text alone; with keep, all columns of docs, then score.

    Null texts count as empty; empty texts are scored as one empty passage. A null id isn't held out. Each row gives a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = [model.forward(x, np.array(counts)) for _, counts, x in bags(batch.column(where).to_pylist())]
            p = pa.array(np.concatenate(found).astype(np.float64) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], p], names=names)

    if keep:
        whole, where = docs, docs.columns.index(text_col)
        names = [*docs.columns, free_name("quality_score", docs.columns)]
        return whole.mapInArrow(scores, T.StructType([*docs.schema.fields, T.StructField(names[-1], T.DoubleType())]))
    whole, where, names = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")), 2, ["doc_id", "held_out", "score"]
    found = whole.mapInArrow(scores, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
