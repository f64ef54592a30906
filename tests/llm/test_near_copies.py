import random

import numpy as np
import pytest

from quern.llm import near_copies
from quern.llm.near_copies import alike, keep_one, sketch
from quern.llm.near_dedup import fingerprint


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows, most=3):
    """The ids that stay, by all pairs: texts hang together by fingerprints at `most` bits or fewer, or by similar sets of shingles."""
    fps, sets, root = [fingerprint(t, 5) for _, t in rows], [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most or similar(sets[i], sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc_id)
    return sorted(min(g) for g in groups.values())


def changed(words, rng, every):
    return [rng.choice("abcdefgh") * 4 if rng.random() < 1 / every else w for w in words]


def made(rng, n, extra=()):
    return [*extra, *(f"w{rng.randrange(5000)}" for _ in range(n))]


@pytest.fixture
def few_rows_a_block(monkeypatch):
    """Blocks of a few rows, so that groups of the test's size are dealt to pairs of them."""
    whole, exact = near_copies.candidates, near_copies.verified
    monkeypatch.setattr(near_copies, "candidates", lambda nodes, similarity, most: whole(nodes, similarity, most, block_rows=8))
    monkeypatch.setattr(near_copies, "verified", lambda texts, similarity: exact(texts, similarity, block_rows=4))


def corpus(seed):
    """Texts of 20 to 400 words; near copies and copies of them; and a passage of 60 words that a third of all texts share."""
    rng = random.Random(seed)
    passage = made(rng, 60)
    texts = [made(rng, rng.choice([20, 60, 150, 400]), passage if i % 3 == 0 else ()) for i in range(60)]
    for _ in range(60):
        texts.append(changed(rng.choice(texts[:60]), rng, rng.choice([20, 60, 200])))
    texts += [changed(texts[1], rng, 120) for _ in range(30)] + texts[:5]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_matches_all_pairs(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert len(want) < 100 and sorted(r.doc_id for r in keep_one(docs).collect()) == want


def test_matches_all_pairs_over_blocks(spark, few_rows_a_block):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == brute_kept(rows)


def test_the_bound_itself_is_similar():
    a = np.arange(10, dtype=np.uint64)
    assert alike(a[:9], a[1:], 0.8) and not alike(a[:8], a[1:9], 0.8)  # 8 of 10 in common; 7 of 9


def test_sketch_does_not_depend_on_what_stands_before():
    rng = random.Random(4)
    words = made(rng, 300)
    a, b = sketch(" ".join(words)), sketch(" ".join(made(rng, 10) + words))
    assert a.size == 296 and len(set(a.passages.tolist()) & set(b.passages.tolist())) >= 6
    for text in (None, "", " \n"):
        empty = sketch(text)
        assert (empty.fp, empty.sign, empty.size, empty.passages.tolist()) == (0, (0, 0), 0, [])
    assert sketch("one").size == 1 and sketch("w " * 50_000).size == 1
    assert sketch("w " * 50_000).fp == fingerprint("w " * 50_000, 5)


def test_repeated_rows_ties_and_clashing_names(spark):
    near = " ".join(f"word{i}" for i in range(200))
    rows = [
        (5, "same text of some words", 1, 1, 1), (5, "same text of some words", 1, 1, 1), (None, "same text of some words", 2, 1, 1),
        (3, "wholly other things in here", 3, 1, 1), (8, near, 4, 1, 1), (7, near.replace("word100", "other"), 5, 1, 1),
        (9, None, 6, None, None), (10, " ", 7, 1, 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int, row int, component int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.FP) for r in got.collect()) == [(3, 3), (5, 1), (7, 5), (9, 6)]
    assert keep_one(docs.limit(0)).count() == 0
