"""Terms nearest to misspelt tokens by trigrams, without a vocabulary: terms are compared in the task that reads the documents.

The tokens go to every task. A task keeps each token's best terms, so what is shuffled grows with tasks and tokens, not with
the terms, of which those of two and three words outgrow the documents. Measure and order are those of quern.operators.typo.

A token has no joiner, so no trigram with one is common to it and a term: what they have in common is the sum over the
term's words, of which the first lacks the trigram that ends it and the last the one that begins it. A term of n words
and m letters, joiners included, reaches the similarity t with a token of q trigrams only with t / (1 + t) * (q + m) in common.
Dealt out to its words by their letters, t / (1 + t) * (q + n - 1) is left over, and one word at least has its part (PARTS) of it.
So single words are compared first, which gives each token a t, and then only those runs of words in which one is so near.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.stem import stem_word
from quern.operators.terms import ROWS, _cut, _Rows, _Stems, _texts
from quern.operators.typo import TRIGRAM_THRESHOLD

#: Words in a row that are compared at a time, tokens at a time, cells of a table of words and tokens, and pairs of terms and tokens.
WORDS, TOKENS, CELLS, PAIRS = 4_000_000, 4096, 500_000, 250_000
#: Different words at which a row ends before, which keeps three of them within 64 bits, and words that are added at a time.
DIFFERENT, STEP = 1_000_000, 100_000
#: Of so many different words one is looked at before all are.
FIRST = 8
FOUND = pa.schema([("token", pa.string()), ("term", pa.string()), ("jaccard", pa.float64())])
#: How a run's words share what is left over; one that stands inside has fewer trigrams in common with a token, so it needs less to be rare.
PARTS = {2: (0.5, 0.5), 3: (0.4, 0.2, 0.4)}
#: For rounding; numbers of common trigrams are whole.
SLIGHTLY = 1e-6


def _trigrams(words: list[str]) -> tuple[np.ndarray, ...]:
    """Of all words in a row: the trigrams as numbers, whose each is, and whether it is the word's first, its last."""
    codes = np.frombuffer(("$" + "$\n$".join(words) + "$").encode("utf-32-le"), "<u4").astype(np.int64)
    end = codes == ord("\n")
    whole = ~(end[:-2] | end[1:-1] | end[2:])
    first, last = np.append(True, end[:-3])[: len(whole)], np.append(end[3:], True)[: len(whole)]
    keys = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
    return tuple(x[whole] for x in (keys, np.cumsum(end)[:-2], first, last))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its size says."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _best(k: int, token: np.ndarray, jaccard: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of each token's k best, sorted by token and from the best on; ties go to the smaller order."""
    by = np.lexsort((order, -jaccard, token))
    token = token[by]
    begins = np.flatnonzero(np.append(True, token[1:] != token[:-1])[: len(token)])
    return by[np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by)))) < k]


class _Tokens:
    """Tokens, their numbers of different trigrams, and whether they have each trigram that any has."""

    def __init__(self, tokens: list[str]) -> None:
        self.tokens = tokens
        keys, owner, _, _ = _trigrams(tokens)
        self.keys, gram = np.unique(keys, return_inverse=True)
        self.has = np.zeros((len(self.keys) + 1, len(tokens)), np.uint8)  # the last trigram is one that none has
        self.has[gram, owner] = 1
        self.size = self.has.sum(0, dtype=np.int64)


class _Words:
    """Words in ascending order with their lengths and those of their trigrams that any token has."""

    def __init__(self, words: list[str], near: _Tokens) -> None:
        self.near = near
        keys, owner, first, last = _trigrams(words)
        self.length = np.bincount(owner, minlength=len(words))
        place = np.minimum(np.searchsorted(near.keys, keys), len(near.keys) - 1)
        known = near.keys[place] == keys
        self.grams, owner = place[known], owner[known]
        self.count = np.bincount(owner, minlength=len(words))
        self.start = np.cumsum(self.count) - self.count
        self.first = np.bincount(owner[first[known]], minlength=len(words))
        self.last = np.bincount(owner[last[known]], minlength=len(words))
        self.most = self.count.copy()  # that any token has, as far as scan() saw

    def scan(self, least, every: int = 1) -> Iterator[tuple[np.ndarray, ...]]:  # noqa: ANN001
        """word, token, trigrams in common where these are no fewer than least(length) says by token, up to what a cell holds; of every so many words the first."""
        many = len(self.near.tokens)
        for length in np.unique(self.length).tolist():
            words = np.flatnonzero((self.length == length) & (self.count >= least(length).min()))[::every]
            for n in range(0, len(words), step := max(1, CELLS // many)):
                some = words[n : n + step]
                grams = np.full((len(some), length), len(self.near.keys))
                counts = self.count[some]
                grams[np.arange(length) < counts[:, None]] = self.grams[_ranges(self.start[some], counts)]
                hits = np.zeros((len(some), many), np.uint8 if length < 256 else np.int32)
                for place in range(counts.max()):
                    hits += self.near.has[grams[:, place]]
                self.most[some] = hits.max(1)
                found = np.flatnonzero(hits >= np.minimum(least(length), np.iinfo(hits.dtype).max).astype(hits.dtype))
                if len(found):
                    word, token = np.divmod(found, many)
                    yield some[word], token, hits.ravel()[found].astype(np.int64)

    def ends(self, word: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the token has the trigram that begins the word, and the one that ends it."""
        most = len(self.grams) - 1
        first = (self.first[word] > 0) & (self.near.has[self.grams[np.minimum(self.start[word], most)], token] > 0)
        return first, (self.last[word] > 0) & (self.near.has[self.grams[np.clip(self.start[word] + self.count[word] - 1, 0, most)], token] > 0)

    def common(self, word: np.ndarray, token: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
        """Trigrams of the word that the token has, as the word begins the term, ends it or lies inside."""
        start = self.start[word] + (0 if begins else self.first[word])
        sizes = np.maximum(self.count[word] - (0 if begins else self.first[word]) - (0 if ends else self.last[word]), 0)
        has = np.cumsum(np.append(0, self.near.has[self.grams[_ranges(start, sizes)], np.repeat(token, sizes)]), dtype=np.int64)
        to = np.cumsum(sizes)
        return has[to] - has[to - sizes]


class _Kept:
    """Each token's k best terms of so many words, and the similarity that a term has to reach to be among them."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k, self.floor = k, floor
        self.columns: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, token: np.ndarray, common: np.ndarray, letters: np.ndarray, size: np.ndarray, order: np.ndarray) -> None:
        """order: a number for each term, ascending with it."""
        jaccard = common / (size[token] + letters - common)
        enough = jaccard >= self.floor[token]
        self.waiting.append((token[enough], jaccard[enough], order[enough]))
        if sum(len(x[0]) for x in self.waiting) >= PAIRS // 4:
            self.settle()

    def settle(self) -> None:
        token, jaccard, order = (np.concatenate(x) for x in zip(self.columns, *self.waiting))
        if len(token):
            by = np.lexsort((order, token))  # a term may have been met in each of its words
            again = np.append(False, (token[by][1:] == token[by][:-1]) & (order[by][1:] == order[by][:-1]))
            token, jaccard, order = (x[by][~again] for x in (token, jaccard, order))
            best = _best(self.k, token, jaccard, order)
            token, jaccard, order = token[best], jaccard[best], order[best]
            full = np.flatnonzero(token[self.k - 1 :] == token[: max(len(token) - self.k + 1, 0)])
            self.floor[token[full]] = np.maximum(self.floor[token[full]], jaccard[full + self.k - 1])
        self.columns, self.waiting = [token, jaccard, order], []


def _nearest(tokens: list[str], words: list[str], runs: dict[int, np.ndarray], k: int, floor: np.ndarray) -> Iterator[tuple[str, str, float]]:
    """token, term, jaccard: each token's k best of the words, which ascend, and of the runs of words, given by number as digits to the base of all words.

    floor: the similarity from which a token takes terms, raised where it has k.
    """
    near = _Tokens(tokens)
    if not len(near.keys):
        return
    each, size, base = _Words(words, near), near.size, len(words)
    share = lambda: floor / (1 + floor)
    whole = lambda x: np.maximum(np.ceil(x - SLIGHTLY), 1).astype(np.int64)
    found: list[tuple[int, float, str]] = []
    alone = _Kept(k, floor)
    # Some words first, so that the similarities are high when all are looked at for what they give, alone or in runs.
    for word, token, common in each.scan(lambda length: whole(share() * (size + length)), FIRST):
        alone.add(token, common, each.length[word], size, word)
    alone.settle()
    least = min(x for shares in PARTS.values() for x in shares)
    parts = [(np.zeros(0, np.int64),) * 3]
    for word, token, common in each.scan(lambda length: whole(share() * (length + least * (size + 1)))):
        alone.add(token, common, each.length[word], size, word)
        parts.append((word, token, common))
    alone.settle()
    found += [(t, -j, words[w]) for t, j, w in zip(*(c.tolist() for c in alone.columns))]
    # Terms in their order as numbers: a word that another follows counts with the joiner.
    joined = np.empty(base, np.int64)
    joined[sorted(range(base), key=lambda n: words[n] + X.JOINER)] = np.arange(base)
    word, token, common = (np.concatenate(x) for x in zip(*parts))
    del parts
    by = np.argsort(word, kind="stable")
    word, token, common = word[by], token[by], common[by]
    first, last = each.ends(word, token) if len(word) else (common, common)
    for n, terms in runs.items():
        kept = _Kept(k, floor)
        for place in range(n):
            begins, ends = place == 0, place == n - 1
            own = np.maximum(common - (0 if begins else first) - (0 if ends else last), 0)
            strong = own - share()[token] * each.length[word] >= share()[token] * (size[token] + n - 1) * PARTS[n][place] - SLIGHTLY
            whose, own = token[strong], own[strong]
            often = np.bincount(word[strong], minlength=base)
            at = np.cumsum(often) - often
            here = terms[often[terms // base ** (n - 1 - place) % base] > 0]
            ends_at = np.cumsum(often[here // base ** (n - 1 - place) % base])
            begin = 0
            while begin < len(here):
                done = ends_at[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends_at, done + PAIRS, "right")))
                some = here[begin:stop]
                begin = stop
                members = [some // base ** (n - 1 - p) % base for p in range(n)]
                letters = sum(each.length[m] for m in members) + n - 1
                pairs = _ranges(at[members[place]], often[members[place]])
                term = np.repeat(np.arange(len(some)), often[members[place]])
                to, both = whose[pairs], own[pairs]
                needed = share()[to] * (size[to] + letters[term]) - SLIGHTLY
                others = [p for p in range(n) if p != place]
                most = [np.minimum(np.maximum(each.count[m] - (0 if p == 0 else each.first[m]) - (0 if p == n - 1 else each.last[m]), 0), each.most[m]) for p, m in enumerate(members)]
                for i, p in enumerate(others):
                    left = both + sum(most[q][term] for q in others[i:]) >= needed
                    term, to, both, needed = term[left], to[left], both[left], needed[left]
                    both = both + each.common(members[p][term], to, p == 0, p == n - 1)
                left = both >= needed
                term, to, both = term[left], to[left], both[left]
                order = np.zeros(len(term), np.int64)
                for p, m in enumerate(members):
                    order = order * base + (joined[m[term]] if p < n - 1 else m[term])
                kept.add(to, both, letters[term], size, order)
        kept.settle()
        back = np.argsort(joined)
        for t, j, o in zip(*(c.tolist() for c in kept.columns)):
            ids = [o // base ** (n - 1 - p) % base for p in range(n)]
            found.append((t, -j, X.JOINER.join([*(words[back[i]] for i in ids[:-1]), words[ids[-1]]])))
    found.sort()
    seen, last_token = 0, -1
    for t, j, term in found:
        seen = seen + 1 if t == last_token else 1
        last_token = t
        if seen <= k:
            yield tokens[t], term, -j


class _Numbers(dict):
    """Numbers of words by their stems, from 0 on as they come; words too short to keep have -2."""

    def __init__(self, known: _Stems) -> None:
        super().__init__()
        self.known, self.stems = known, {}

    def __missing__(self, word: str) -> int:
        stem = self.known[word]
        self[word] = number = -2 if stem is None else self.stems.setdefault(stem, len(self.stems))
        return number


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted in place; np.unique() is slower."""
    numbers.sort()
    return numbers[np.append(True, numbers[1:] != numbers[:-1])[: len(numbers)]]


class _Chunk:
    """Words of documents by number, in the order in which they stand, -1 between fields."""

    def __init__(self, known: _Stems) -> None:
        self.known, self.numbers, self.row = known, _Numbers(known), array("i")

    def add(self, *fields: str) -> Iterator[tuple[list[str], dict[int, np.ndarray]]]:
        """Yields what take() gives whenever there is enough of it."""
        for text in fields:
            words = text.split()
            for n in range(0, len(words), STEP):
                self.row.extend(map(self.numbers.__getitem__, words[n : n + STEP]))
                if len(self.row) >= WORDS or len(self.numbers.stems) >= DIFFERENT:
                    yield self.take()
            self.row.append(-1)

    def take(self) -> tuple[list[str], dict[int, np.ndarray]]:
        """The words in ascending order, and the different runs of two and three, as digits to the base of all words. Those of a field that isn't over go on."""
        stems = self.numbers.stems
        words, base = sorted(stems), len(stems)
        place = np.full(base + 1, -1)  # the last is that of -1
        place[[stems[w] for w in words]] = np.arange(base)
        row = np.array(self.row, np.int32)
        row = place[row[row > -2]]
        runs, whole = {}, row
        for n in (2, 3):
            whole = np.where((whole[:-1] >= 0) & (row[n - 1 :] >= 0), whole[:-1] * base + row[n - 1 :], -1)
            runs[n] = _distinct(whole[whole >= 0])
        after = [words[n] if n >= 0 else None for n in row[-2:].tolist()]
        self.numbers, self.row = _Numbers(self.known), array("i")
        self.row.extend([-1 if w is None else self.numbers.stems.setdefault(w, len(self.numbers.stems)) for w in after])
        return words, runs


def nearest(tokens: list[str], docs: DataFrame, k: int, threshold: float = TRIGRAM_THRESHOLD, correct: bool = False) -> DataFrame:
    """token, term, jaccard: among others the k best terms of each token. tokens: the different ones asked for; docs: doc_id, title, body.

    With correct, a token that is a term comes with itself as term and no jaccard, and needs no others.
    """
    if any(X.JOINER in t for t in tokens):
        raise ValueError("tokens with joiners have trigrams in common with the places where terms are joined")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = _Stems(stem_word), _Rows(FOUND)
        chunk, have, floors = _Chunk(known), set(), np.full(len(tokens), threshold)

        def compared(words: list[str], runs: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if not words:
                return
            if correct:
                there = set(words)
                have.update(t for t in tokens if t in there)
            rest = [n for n, t in enumerate(tokens) if t not in have]
            for n in range(0, len(rest), TOKENS):
                some = rest[n : n + TOKENS]
                floor = floors[some]
                for row in _nearest([tokens[i] for i in some], words, runs, k, floor):
                    for column, value in zip(rows.columns, row):
                        column.append(value)
                    if len(rows) >= ROWS:
                        yield rows.take()
                floors[some] = floor

        for batch in batches:
            for _, title, body in _texts(batch):
                for taken in chunk.add(title, body):
                    yield from compared(*taken)
        yield from compared(*chunk.take())
        for column, value in zip(rows.columns, (sorted(have), sorted(have), [None] * len(have))):
            column.extend(value)
        yield rows.take()

    return _cut(docs).mapInArrow(each, "token string, term string, jaccard double")


def _tokens(asked: DataFrame) -> list[str]:
    return sorted(r.token for r in asked.select("token").distinct().collect() if r.token is not None)


def suggest(asked: DataFrame, docs: DataFrame, threshold: float = TRIGRAM_THRESHOLD, limit: int = 5) -> DataFrame:
    """token, rank, term, jaccard as typo.trigram_suggest() gives them."""
    found = nearest(_tokens(asked), docs, limit, threshold).groupBy("token", "term").agg(F.first("jaccard").alias("jaccard"))
    order = Window.partitionBy("token").orderBy(F.desc("jaccard"), "term")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("token", "rank", "term", "jaccard")


def correct_tokens(tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """tokens (with a column token) with term and corrected as typo.correct_tokens() gives them."""
    found = nearest(_tokens(tokens), docs, 1, correct=True)
    best = F.min(F.when(F.col("jaccard").isNotNull(), F.struct((-F.col("jaccard")).alias("order"), F.col("term"))))
    best = found.groupBy("token").agg(F.bool_or(F.col("jaccard").isNull()).alias("known"), best.alias("best"))
    joined = tokens.join(best.filter("NOT known").select("token", F.col("best.term").alias("better")), "token", "left")
    return joined.select(*tokens.columns, F.coalesce("better", "token").alias("term"), F.col("better").isNotNull().alias("corrected"))
