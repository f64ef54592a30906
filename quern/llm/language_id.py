"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import held_out, sampled_ids

#: Longest context in bytes; symbols of the small alphabet that code_lengths() is written out for; windows of bytes scored at a time.
ORDER, SYMBOLS, CHUNK = 3, 48, 1 << 18
BYTES = 256
UNKNOWN = "und"
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and each other ASCII character as a space, after a context of spaces."""
    return b" " * ORDER + text.encode("utf-8", "replace").translate(_LETTERS)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def windows(data: bytes) -> np.ndarray:
    """Each byte with the ORDER bytes before it, as one 32-bit number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    out = np.zeros(max(0, len(b) - ORDER), np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | b[k : k + len(out)]
    return out


class Contexts:
    """The probabilities of one language, held sparsely: what was seen, and what a seen context adds for an escape.

    A context that was seen T times before U different symbols gives a seen symbol count / (T + U) and escapes with
    U / (T + U) to the context one byte shorter, where symbols it has seen itself are left out. Below the empty context
    all symbols are alike. What has no counts at all escapes for sure. The probabilities of a context add up to 1.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, symbols: int = BYTES) -> None:
        self.symbols, self.orders = symbols, []
        for order in range(ORDER + 1):
            seen, place = np.unique(codes.astype(np.int64) % symbols ** (order + 1), return_inverse=True)
            n = np.bincount(place, weights=counts, minlength=len(seen))
            contexts, of = np.unique(seen // symbols, return_inverse=True)
            total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
            below = np.exp2(-self.bits(seen % symbols**order))
            # Where a context has seen all symbols there is none to escape to.
            rest = np.where(kinds < symbols, 1 - np.bincount(of, weights=below, minlength=len(contexts)), 0)
            escape = np.where(rest > 0, kinds, 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                more = np.where(escape > 0, np.log2(rest) - np.log2(escape / (total + escape)), np.inf)
            self.orders.append((seen, np.log2((total + escape)[of]) - np.log2(n), contexts, more))

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """-log2 of the probability of the last symbol of each window after the symbols before it."""
        out, todo = np.zeros(len(windows)), np.arange(len(windows))
        for order in reversed(range(len(self.orders))):
            seen, bits, contexts, more = self.orders[order]
            own = windows[todo] % self.symbols ** (order + 1)
            at, found = _places(seen, own)
            out[todo[found]] += bits[at[found]]
            todo, own = todo[~found], own[~found]
            at, found = _places(contexts, own // self.symbols)
            out[todo[found]] += more[at[found]]
        out[todo] += np.log2(self.symbols)
        return out


def _places(held: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked number is in the sorted held ones, and whether it is there."""
    if not len(held):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
    return at, held[at] == asked


@dataclass
class Model:
    """Window counts by language, from which each worker builds its contexts once."""

    languages: list[str]
    symbol: np.ndarray  # of each byte: each has one of its own
    codes: list[np.ndarray]
    counts: list[np.ndarray]
    _contexts: list[Contexts] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_contexts": None}

    @property
    def contexts(self) -> list[Contexts]:
        if self._contexts is None:
            self._contexts = [Contexts(c, n) for c, n in zip(self.codes, self.counts, strict=True)]
        return self._contexts

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Bits that each language's statistics need for each whole text (none of them empty): a row for each text.

        Windows are scored some CHUNK at a time, each different one once.
        """
        total = np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []

        def score() -> None:
            all_windows = np.concatenate([w for _, w in held])
            kinds = np.unique(all_windows)
            place, starts = np.searchsorted(kinds, all_windows), np.cumsum([0, *(len(w) for _, w in held[:-1])])
            for k, contexts in enumerate(self.contexts):
                np.add.at(total[:, k], [i for i, _ in held], np.add.reduceat(contexts.bits(kinds.astype(np.int64))[place], starts))
            held.clear()

        waiting = 0
        for i, text in enumerate(texts):
            data = plain(text)
            for a in range(0, len(data) - ORDER, CHUNK):
                held.append((i, windows(data[a : a + CHUNK + ORDER])))
                waiting += len(held[-1][1])
                if waiting >= CHUNK:
                    score()
                    waiting = 0
        if held:
            score()
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language of the shortest code, and its probability if all were equally likely before."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, text in enumerate(texts) if text and self.languages and has_letter(text)]
        for i, bits in zip(known, self.lengths([texts[i] for i in known]), strict=True):
            best = int(np.argmin(bits))
            out[i] = self.languages[best], float(1 / np.exp2(np.minimum(bits[best] - bits, 0)).sum())
        return out


def code_lengths(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Contexts.bits() of all windows over the small alphabet."""
    return Contexts(codes, counts, SYMBOLS).bits(np.arange(SYMBOLS ** (ORDER + 1))).astype(np.float32)


def train(docs: DataFrame, docs_per_language: int = 400, most_languages: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from the text and lang of documents that aren't held out.

    Every language has a model; more than most_languages of them raise an error, as the driver holds their counts.
    At most docs_per_language documents of each are read, chosen by hash;
    their windows of bytes are counted on the executors, and only the counts reach the driver.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    languages = sorted(r[0] for r in known.select(lang_col).distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    chosen = sampled_ids(known, lang_col, docs_per_language, id_col)
    rows = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("class"), F.col(text_col).alias("text")).join(F.broadcast(chosen), ["doc_id", "class"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, text in zip(batch.column("class").to_pylist(), batch.column("text"), strict=True):
                codes, counts = np.unique(windows(plain(text.as_py())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["class", "code", "n"])

    counted = rows.select("class", "text").mapInArrow(count, "class string, code long, n long").groupBy("class", "code").agg(F.sum("n").alias("n")).toPandas()
    of = {x: (own["code"].to_numpy(np.uint32), own["n"].to_numpy(np.float64)) for x, own in counted.groupby("class")}
    return model_from(languages, [of.get(x, (np.zeros(0, np.uint32), np.zeros(0))) for x in languages])


def model_from(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of windows and their counts, a pair for each language."""
    return Model(languages, np.arange(BYTES, dtype=np.uint8), [c for c, _ in counted], [n for _, n in counted])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of each whole text: doc_id, held_out, lang_pred, score.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing could be learned. Long texts
    are scored to their end, a stretch at a time. Equal code lengths go to the smaller language name. A null id isn't held
    out. Each row gives a row; other columns are ignored, lang among them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, docs_per_language: int = 400) -> DataFrame:
    """train() on the documents that aren't held out, then identify() all."""
    return identify(docs, train(docs, docs_per_language))
