import random

import numpy as np
import pytest
import xxhash

from quern.llm import near_dedup
from quern.llm.near_dedup import components, fingerprint, linked_in, links, near_duplicates


def slow_fingerprint(text):
    words = [w for w in _split((text or "").encode().lower())]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(data):
    word = b""
    for c in data + b" ":
        if c in b"\x20\x09\x0a\x0b\x0c\x0d":
            if word:
                yield word
            word = b""
        else:
            word += bytes([c])


def test_fingerprint_matches_plain_count():
    rng = random.Random(3)
    words = ["Aa", "b", "ÉÉ", "c d", "e\x1cf", "The", "x" * 50]
    for n in (0, 1, 2, 3, 4, 50, 300, 1000):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t  ", "\x0b"]) for _ in range(n))
        assert fingerprint(text) == slow_fingerprint(text)
    assert fingerprint(None) == fingerprint(" \n") == 0


def brute(values, ids, most=3):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= most:
                root[top(i)] = top(j)
    out = {}
    for i in range(len(values)):
        out.setdefault(top(i), []).append(ids[i])
    return {i: min(m for m in g) for g in out.values() for i in g}


def planted(n, seed):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rng.choice(out)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out) | {0, 1, (1 << 64) - 1})


def test_shard_search_keeps_connectivity():
    values = planted(400, 1)
    own = np.array(values, np.uint64)
    a, b = linked_in(own, own, 3, leaf=16)
    assert len(a) < len(values)
    place = {v: i for i, v in enumerate(values)}
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        root[top(place[x])] = top(place[y])
    want = brute(values, list(range(len(values))))
    groups = {}
    for i in range(len(values)):
        groups.setdefault(top(i), []).append(i)
    assert {i: min(g) for g in groups.values() for i in g} == want


def test_links_and_components_match_brute_force(spark):
    values = planted(600, 2)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = links(frame, 3, shard_rows=40, sample_rows=200)
    got = {r.node: r.component for r in components(edges).collect()}
    want = brute([v & (1 << 64) - 1 for v in signed], signed)
    assert {v: got.get(v, v) for v in signed} == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_few_and_of_many_edges(spark, monkeypatch, few):
    tables = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name, make=near_dedup.written: tables.append(name) or make(df, name))
    ends = [(-5, 3), (3, 9), (9, -5), (9, 3), (7, 7), (1 << 62, -(1 << 62)), *((100 + i, 101 + i) for i in range(40))]
    edges = spark.createDataFrame(ends, "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(edges, few).collect()}
    assert got == {-5: -5, 3: -5, 9: -5, 7: 7, 1 << 62: -(1 << 62), -(1 << 62): -(1 << 62), **{100 + i: 100 for i in range(41)}}
    assert not few or len(tables) == 2  # no rounds, whose plans stay with the driver
    assert near_dedup.components(edges.limit(0), few).count() == 0


def test_near_duplicates_edge_cases(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(1, base), (2, base), (3, base + " more"), (4, None), (5, ""), (5, "other text here"), (None, "alone and unlike"), (9, "x" * 100000)]
    docs = spark.createDataFrame([(i, t, "c", 7) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    values = [slow_fingerprint(t) for _, t in rows]
    assert sorted((i, f"{v:016x}") for (i, _), v in zip(rows, values) if i is not None) == sorted((i, f) for i, f, _ in got if i is not None)
    parts = {(i, f): c for i, f, c in got}
    assert parts[1, f"{values[0]:016x}"] == parts[2, f"{values[0]:016x}"] == 1
    assert parts[4, "0" * 16] == parts[5, "0" * 16] == 4
    assert near_duplicates(docs.limit(0)).count() == 0


def test_fixture_table_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = brute([slow_fingerprint(r.text) for r in rows], [r.doc_id for r in rows])
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == want
