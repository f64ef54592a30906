"""Byte-level BPE: a memory-mapped minimal transducer for frequent words, exact merges for all others."""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import struct
import tempfile
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import text_of

#: White space as Unicode has it; fixed value of the tokenizer's pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern that cuts a text into words before the merges.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def _latin_words() -> re.Pattern:
    """WORDS for texts of Latin-1 characters, with each class written out: what Python's own expressions take, which are faster."""
    kind = lambda initial: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c)).startswith(initial))
    space = r"\t-\r \x85\xa0"
    letters, numbers = kind("L"), kind("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


MAGIC = b"MATX"
SHORT = 128  # bytes of a word up to which merges look at all pairs
ROWS = 500  # encoded at a time
LONGEST = 64  # bytes of a word of the lexicon; longer ones are merged


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    """Token bytes, merge ranks and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        back = {letter: b for b, letter in enumerate(byte_letters())}
        plain = lambda token: bytes(back[c] for c in token)
        self.ids = {plain(t): i for t, i in spec["model"]["vocab"].items() if all(c in back for c in t)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content in self.special:
            self.ids.pop(content.encode(), None)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        #: Pair of ids, as one number, to the rank of its merge; ids that merges make, by rank.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for a, b in pairs:
            left, right = plain(a), plain(b)
            self.ranks.setdefault(self.ids[left] << 20 | self.ids[right], len(self.made))
            self.made.append(self.ids[left + right])
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.tokens[i] = token
        for content, i in self.special.items():
            self.tokens[i] = content.encode()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word: the pair of least rank merges, leftmost first, until none is left."""
        if len(word) > SHORT:
            return self._merge_long(word)
        parts, rank_of, never = [self.byte_ids[b] for b in word], self.ranks.get, len(self.made)
        ranks = [rank_of(a << 20 | b, never) for a, b in pairwise(parts)]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            parts[i : i + 2] = [new] = [self.made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | new, never)
            if i < len(ranks):
                ranks[i] = rank_of(new << 20 | parts[i + 1], never)
        return parts

    def _merge_long(self, word: bytes) -> list[int]:
        """The same in n log n steps for n bytes."""
        parts = [self.byte_ids[b] for b in word]
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (rank := self.ranks.get(parts[i] << 20 | parts[j])) is not None:
                heappush(waiting, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while waiting:
            rank, i, a, b = heappop(waiting)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p >= 0]


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """A minimal acyclic transducer from words to their ids, as one block of bytes to be mapped.

    Words are added in byte order; when a word leaves a branch, the branch's states are replaced by equal ones that
    exist already, so that suffixes are shared. A state holds how many words lie below each of its arcs and before it,
    so the sum along a word's path is its number among all words, which indexes the ids. Thus outputs don't keep states
    apart. Layout: header, then arrays of 32-bit numbers: first arc of each state, arc label, arc target, words before
    the arc, final flag of each state, first id of each word, ids.
    """
    words = sorted({w: ids for w, ids in entries if w}.items())
    known: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]  # of the word added last: final flag, arcs (label, target; the last one still open)

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            shape = (final, tuple(arcs))
            if shape not in known:
                known[shape] = len(states)
                states.append(shape)
            path[-1][1][-1] = (path[-1][1][-1][0], known[shape])

    last = b""
    for word, _ in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        freeze(same)
        for label in word[same:]:
            path[-1][1].append((label, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    states.append((path[0][0], tuple(path[0][1])))
    below = [0] * len(states)
    first, label, target, skipped = [0], [], [], []
    for n, (final, arcs) in enumerate(states):  # targets come before the states that lead to them
        count = int(final)
        for c, t in arcs:
            label.append(c)
            target.append(t)
            skipped.append(count)
            count += below[t]
        below[n] = count
        first.append(len(label))
    starts = np.cumsum([0, *(len(ids) for _, ids in words)])
    flat = [i for _, ids in words for i in ids]
    arrays = [first, label, target, skipped, [int(f) for f, _ in states], starts, flat]
    packed = [np.asarray(a, np.int32).tobytes() for a in arrays]
    return MAGIC + struct.pack("<7i", *(len(p) // 4 for p in packed)) + b"".join(packed)


class Lexicon:
    """Reads a compiled transducer from memory that is mapped, not loaded."""

    def __init__(self, block) -> None:  # noqa: ANN001  anything with the buffer protocol
        if bytes(block[:4]) != MAGIC:
            raise ValueError("not a compiled lexicon")
        at, views = 32, []
        for n in struct.unpack("<7i", block[4:32]):
            views.append(memoryview(block)[at : at + 4 * n].cast("i"))
            at += 4 * n
        self.first, self.label, self.target, self.skipped, self.final, self.starts, self.flat = views
        self.root = len(self.final) - 1

    @classmethod
    def mapped(cls, data: bytes) -> Lexicon:
        """Through a file without a name, gone with the process."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def ids(self, word: bytes) -> memoryview | None:
        """The word's ids, or None if it isn't in the lexicon."""
        first, label, state, number = self.first, self.label, self.root, 0
        for c in word:
            end = first[state + 1]
            arc = bisect_left(label, c, first[state], end)
            if arc == end or label[arc] != c:
                return None
            number += self.skipped[arc]
            state = self.target[arc]
        return self.flat[self.starts[number] : self.starts[number + 1]] if self.final[state] else None


class Tokenizer:
    """Encodes and decodes whole texts. Words met are remembered in two memories of bounded size: when the newer is full it becomes the older, from which words met again are taken over."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, remembered: int = 128_000) -> None:
        self.vocabulary, self.lexicon, self.remembered = vocabulary, lexicon, remembered
        self.words, self.latin = regex.compile(WORDS).findall, _latin_words().findall
        specials = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _packed(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            data = word.encode("utf-8", "replace")
            found = self.lexicon.ids(data) if self.lexicon is not None else None
            out = array("i", self.vocabulary.merge(data)).tobytes() if found is None else found.tobytes()
        if len(word) < 64:
            if len(self.memory) >= self.remembered:
                self.older, self.memory = self.memory, {}
            self.memory[word] = out
        return out

    def cut(self, piece: str) -> list[str]:
        """The words that merges stay inside."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            return self.words(piece)
        return self.latin(piece)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; the contents of special tokens become their ids, as in the tokenizers library."""
        out = []
        for n, piece in enumerate(self.special.split(text) if self.special else [text]):
            if n % 2:
                out.append(np.int32(self.vocabulary.special[piece]).tobytes())
            else:
                known, packed = self.memory.get, self._packed
                out += [known(w) or packed(w) for w in self.cut(piece)]
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids, those of special tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids)).decode("utf-8", "replace")


def frequent_words(docs: DataFrame, most: int = 50_000, text_col: str = "text") -> list[str]:
    """The words of up to LONGEST bytes of which each makes up 1 / most of all bytes or more, counted over all texts.

    There can be no more than `most` of them, so the driver gets a bounded list whatever the corpus, without a sort.
    """
    text = text_of(text_col)
    whole = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first().bytes
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))).alias("word"))
    counted = words.filter(F.octet_length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))
    return sorted(r.word for r in counted.filter(F.col("n") * F.octet_length("word") * most >= whole).collect())


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def _tokenizer(path: str, data: bytes) -> Tokenizer:
    """One for each worker process, kept between its tasks."""
    key = path, hashlib.sha256(data).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(_vocabulary(path), Lexicon.mapped(data))
    return _tokenizers[key]


def tokenise(
    docs: DataFrame, vocabulary_path: str, lexicon_words: int = 50_000, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_decoded: bool = False
) -> DataFrame:
    """Encode every whole text and decode it again.

    The words that are frequent in the whole corpus are found first (in Spark), merged once on the driver and
    compiled into a minimal transducer, whose size the number of words bounds; it is broadcast and memory-mapped by
    each worker. Words outside it are merged exactly. Which words it holds changes the speed alone, never the ids.

    Null texts count as empty, which have no tokens. Texts of any length are encoded whole. Rows are independent: repeated rows and null ids come back as they
    are, other columns, whatever their names, don't. An empty table gives an empty one. Returns doc_id, n_tokens, ids_sha256 (of decimal ids joined by
    commas), decoded_sha256, with keep_ids also ids (array<int>), with keep_decoded also decoded (string).
    """
    spark = docs.sparkSession
    vocabulary = _vocabulary(vocabulary_path)
    entries = ((w, vocabulary.merge(w)) for w in (x.encode() for x in frequent_words(docs, lexicon_words, text_col)))
    shared = spark.sparkContext.broadcast(compile_lexicon(entries))
    decimal = [str(i) for i in range(len(vocabulary.tokens))]
    more = (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_decoded else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(vocabulary_path, shared.value)
        names = decimal
        # A few rows at a time, so that the ids of a whole batch are never held at once.
        for batch in (whole.slice(a, ROWS) for whole in batches for a in range(0, max(1, whole.num_rows), ROWS)):
            counts, digests, backs, kept, texts = [], [], [], [], []
            for text in batch.column("text"):
                found = tokenizer.encode(text.as_py() or "")
                ids = found.tolist()
                decoded = tokenizer.decode(ids)
                counts.append(len(ids))
                digests.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                backs.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    kept.append(found)
                if keep_decoded:
                    texts.append(decoded)
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(backs, pa.string())}
            if keep_ids:
                flat = np.concatenate([np.zeros(0, np.int32), *kept])
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(flat, pa.int32()))
            if keep_decoded:
                columns["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
