"""Small cases for the operators that SQL can express: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import exact_dedup, line_dedup, sharding, source_mixing, topk_search, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names the operators use inside."""
    frame = spark.createDataFrame([(i, t, s) for i, t, s in rows], "doc_id long, text string, source string")
    return frame.select("*", *(F.lit("x").alias(c) for c in ("row", "kept", "cell", "doc", "id", "line", "leaf", "n_tokens", "epoch", "shard", "key", "name", "weight", "size")))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_edge_cases(spark):
    rows = [(1, "a", "s"), (5, "a", "s"), (3, "a", None), (2, None, "s"), (7, "", "s"), (9, "b" * 300_000, "s"), (4, "dup", "s"), (4, "dup", "s"), (None, "a", "s"), (None, "lone", "s")]
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if r.text_sha256 == sha("a") and r.doc_id) == [(1, 5, 4, False), (3, 5, 4, False), (5, 5, 4, True)]
    assert sorted((r.doc_id, r.kept) for r in got if r.text_sha256 == sha("")) == [(2, False), (7, True)]
    assert sorted(r.kept for r in got if r.doc_id == 4) == [False, True]
    assert [r.kept for r in got if r.doc_id is None and r.text_sha256 == sha("lone")] == [True]
    assert exact_dedup.exact_dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_exact_dedup_is_whole_with_a_full_filter(spark):
    rows = [(i, f"text {i % 70_000}", "s") for i in range(70_500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = exact_dedup.exact_dedup(frame, max_filter_bytes=4096)
    assert got.filter("kept").count() == 70_000 and got.filter("group_size = 2").count() == 1000


def test_line_dedup_edge_cases(spark):
    boiler = "This page was last changed on {} by the staff"
    rows = [
        (3, f"Quite another sentence stands in here\n{boiler.format('12.03.2020')}\nends well", "s"), (1, f"{boiler.format('2021-01-01')}\nNothing like it is to be found", "s"), (2, boiler.format("May5") + "\n\n  ", "s"),
        (4, None, "s"), (5, "", "s"), (6, "short line\nshort line", None), (None, "x" * 200_000, "s"), (7, "one two three four five\n" * 3, "s"), (7, "one two three four five\n" * 3, "s"),
    ]
    got = {(r.row.doc_id, r.row.text): (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got[1, rows[1][1]] == (rows[1][1], 0)  # the first occurrence
    assert got[2, rows[2][1]] == ("\n  ", 1) and got[3, rows[0][1]] == ("Quite another sentence stands in here\nends well", 1)
    assert got[4, None] == got[5, ""] == ("", 0)
    assert all(got[i, t] == (t, 0) for i, t, _ in rows[5:])
    assert line_dedup.dedup_lines(docs_of(spark, rows).limit(0)).count() == 0


def test_short_lines_that_recur_are_dropped(spark):
    rows = [(1, "Les.\nOf, edti oner.\nown words", "s"), (2, "Les.\n\nOf, edti oner.", "s"), (3, "one two three four\nLes.\nLes. now", "s"), (4, "one two three five", "s"), (5, "one two three four", "s")]
    got = {r.row.doc_id: (r.text, r.n_dropped) for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 2), 3: ("one two three four\nLes. now", 1), 4: (rows[3][1], 0), 5: ("", 1)}


def test_line_templates_leave_variable_fields_open(spark):
    base = "Posted by the {} in our forum on this lovely day for all readers of the old site"
    rows = [(i, base.format(name), "s") for i, name in enumerate(["alice", "bob", "carol"])] + [(9, base.replace("forum", "bakery").replace("lovely", "rainy").replace("old", "new").replace("readers", "eaters").format("dave"), "s")]
    got = {r.row.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, rows)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 9: 0}


def test_short_lines_can_have_a_variable_field(spark):
    for base in ("posted by user {} today", "posted by user {} late today", "posted by our user {} late today"):
        rows = [(i, base.format(name), "s") for i, name in enumerate(["al", "bo", "cy"])]
        assert [r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, rows)).orderBy("row.doc_id").collect()] == [0, 1, 1]


def test_a_template_of_one_document_does_not_hide_one_of_two(spark):
    rows = [(1, "\n".join(f"the old list of {w} things to see" for w in ("red", "green", "blue")), "s"), (2, "the old list of red things to hear", "s")]
    assert [r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, rows)).orderBy("row.doc_id").collect()] == [0, 1]


def test_line_templates_with_values_that_recur(spark):
    base = "Posted by the {} in our {} on this lovely day for all readers of the old site"
    few = [(i, base.format(n, p), "s") for i, (n, p) in enumerate(itertools.product(["alice", "bob"], ["forum", "club"]))]
    assert [r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, few)).orderBy("row.doc_id").collect()] == [0, 1, 1, 1]
    many = [(i, base.format(f"name{chr(97 + i % 20)}", f"town{chr(97 + i // 20)}"), "s") for i in range(300)]
    assert line_dedup.dedup_lines(docs_of(spark, many)).filter("n_dropped = 1").count() == 299
    verbatim = [(i, base.format("alice", "forum"), "s") for i in range(5)] + [(9, base.format("zoe", "forum"), "s")]
    assert [r.n_dropped for r in line_dedup.dedup_lines(docs_of(spark, verbatim)).orderBy("row.doc_id").collect()] == [0, 1, 1, 1, 1, 1]
    alone = [(1, "\n".join(t for _, t, _ in few), "s"), (2, "wholly other words stand in this one line", "s")]
    assert line_dedup.dedup_lines(docs_of(spark, alone)).filter("n_dropped > 0").count() == 0


def test_url_rules(spark):
    pages = [
        (1, "http://A.Example.NET/en/x", "allow", "example.net/en/"), (2, "https://b.example.net/de/", "block", "net/"), (3, "http://example.com/de/?q", "block", "example.com/de/"),
        (4, "http://x.org/fr/a#b", "allow", "org/fr/"), (5, "http://myexample.com/de/", "allow", None), (6, None, "allow", None), (7, "no scheme", "allow", None), (8, "http://net/", "block", "net/"),
        (8, "http://net/", "block", "net/"), (9, "http://?q", "allow", None), (None, "ftp://clean.org/", "allow", None),
    ]
    frame = spark.createDataFrame([(i, u, None, 1) for i, u, _, _ in pages], "page_id long, url string, html string, host int")
    got = {(r.page_id, r.verdict, r.rule) for r in url_filter.judge_urls(frame).collect()}
    assert got == {(i, v, r) for i, _, v, r in pages}
    assert url_filter.judge_urls(frame.limit(0)).count() == 0
    hosts = {r.page_id: (r.host, r.path) for r in url_filter.judge_urls(frame).collect()}
    assert hosts[1] == ("a.example.net", "/en/x") and hosts[6] == hosts[7] == ("", "") and hosts[9] == ("", "")


def test_distrust_runs_against_links_and_trust_along_them(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [(1, "http://bad.net/", ""), (2, "http://farm.info/", link("bad.net", "bad.net")), (3, "http://friend.info/", link("bad.net")), (4, "http://www.org/fr/", link("friend.info")), (5, "http://apart.info/", link("apart.info"))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame, least_distrust=0.2).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


def test_many_linkers_of_a_blocked_host_are_blocked(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    farms = [(i, f"http://farm{i}.info/", link("bad.net")) for i in range(2, 102)]
    other = [(200, "http://portal.info/", link("bad.net", *(f"good{k}.info" for k in range(9)))), (201, "http://second.info/", link("farm2.info"))]
    frame = spark.createDataFrame([(1, "http://bad.net/", ""), *farms, *other], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame).collect()}
    assert got == {i: "block" for i in range(1, 102)} | {200: "allow", 201: "block"}


def _series(seeds, shares, damping):
    """The plain power iteration in whole numbers: host to mass."""
    wave, total = {h: int(m * (1 - damping)) for h, m in seeds.items()}, dict.fromkeys(seeds, 0)
    while any(wave.values()):
        for h, m in wave.items():
            total[h] = total.get(h, 0) + m
        then = {}
        for a, b, share in shares:
            if got := int(wave.get(a, 0) * damping * share):
                then[b] = then.get(b, 0) + got
        wave = then
    return total


@pytest.mark.parametrize("seed, wave_bytes", [(1, 1 << 24), (2, 0), (3, 1 << 24)])
def test_random_graphs_against_plain_power_iteration(spark, monkeypatch, seed, wave_bytes):
    import duckdb

    monkeypatch.setattr(url_filter, "WAVE_BYTES", wave_bytes)
    rng = np.random.default_rng(seed)
    hosts = [f"h{k}.{('net', 'info', 'org', 'com')[k % 4]}" for k in range(24)]
    pages, links, judged = [], {}, {}
    for n in range(70):
        host, path = hosts[rng.integers(24)], ("/", "/fr/x", "/en/")[rng.integers(3)]
        targets = [hosts[k] for k in rng.integers(0, 24, rng.integers(0, 4))]
        pages.append((n, f"http://{host}{path}", "".join(f'<a href="http://{t}/">x</a>' for t in targets)))
        for t in {*targets} - {host}:
            links[host, t] = links.get((host, t), 0) + 1
        judged.setdefault(host, []).append("block" if host.endswith(".net") else "allow" if host.endswith(".org") and path == "/fr/x" else None)
    leaving = {}
    for (a, _), n in links.items():
        leaving[a] = leaving.get(a, 0) + n
    forward = [(a, b, n / leaving[a]) for (a, b), n in links.items()]
    part = lambda verdict: {h: int(1e9 * own.count(verdict) / len(own)) for h, own in judged.items()}
    trust, distrust = _series(part("allow"), forward, 0.85), _series(part("block"), [(b, a, s) for a, b, s in forward], 0.85)
    bad = {h for h, m in distrust.items() if m >= int(0.5 * (1 - 0.85) * 1e9) and m > trust.get(h, 0)}
    want = {n: "block" if ".net" in url else "allow" if ".org/fr/" in url or url.split("/")[2] not in bad else "block" for n, url, _ in pages}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(frame).collect()}
    assert got == want and any(v == "block" and ".net" not in pages[n][1] for n, v in want.items())

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", pages)
    assert {r[0]: r[4] for r in con.sql(url_filter.oracle()).select("page_id, host, path, rule, verdict").fetchall()} == want
    shares = spark.createDataFrame(forward, "from_host string, to_host string, share double")
    masses = url_filter.propagate(spark.createDataFrame(list(part("allow").items()), "host string, mass long"), shares, 0.85)
    assert {r.host: r.mass for r in masses.collect()} == {h: m for h, m in trust.items() if m}


def test_distrust_runs_until_nothing_is_passed_on(spark):
    seeds = spark.createDataFrame([("a", 1000)], "host string, mass long")
    shares = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "from_host string, to_host string, share double")
    got = {r.host: r.mass for r in url_filter.propagate(seeds, shares, 0.85).collect()}
    mass, want = 150, {"a": 0, "b": 0}
    for k in range(99):
        want["ab"[k % 2]] += mass
        mass = int(mass * 0.85)
    assert got == want and mass == 0


def brute_top(rows, k=10):
    clean = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in clean:
        if q % 100 == 0:
            scored = sorted((-int(a @ b), i) for i, b in clean if i != q and len(a) == len(b))[:k]
            out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def test_top_k_edge_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)] + [(500, None), (600, [None] * 8), (700, [float("nan")] * 8), (800, [float("inf")] * 8), (900, [1.0] * 3), (901, [2.0] * 3), (None, [1.0] * 8), (402, [0.5] * 8), (401, [0.5] * 8), (1000, []), (1001, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clashing = frame.select("*", *(F.lit(1).alias(c) for c in ("id", "v", "dim", "cb", "asks", "floor")))
    for table, block in ((frame, 65_536), (frame, 37), (clashing, 150)):
        got = topk_search.top_k(table, table.filter("vec_id % 100 = 0"), 10, candidate_block=block)
        assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top(rows)
    assert topk_search.top_k(frame.limit(0), frame.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, -1.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk_search.top_k(big, big.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, (1024 * 10**6) ** 2 - 1024**2), (2, -(2**63))]


def test_top_k_counts_a_repeated_id_once(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [9.0 - k / 100, 0.0]) for k in range(30)] + [(i, [float(i) / 10, 0.0]) for i in range(2, 40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (65_536, 9):
        got = topk_search.top_k(frame, frame.filter("vec_id = 0"), 10, candidate_block=block).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 39, 38, 37, 36, 35, 34, 33, 32, 31] and got[0].score == 9 * 1024**2


@pytest.mark.parametrize("many", [0, 1, 40])
def test_bounds_never_lose_a_candidate(many):
    rng = np.random.default_rng(many)
    columns, queries = rng.integers(-200, 200, (32, many)), rng.integers(-200, 200, (9, 32))
    ids = rng.permutation(many)
    for place, found, scores in topk_search.search_block(queries, np.full(9, -1), columns, ids, 5, step=4):
        want = sorted(zip(-(queries[place] @ columns), ids))[:5]
        assert list(zip(-scores, found)) == want if len(want) == 5 else sorted(zip(-scores, found)) == want


def test_sharding_edge_cases(spark):
    rows = [(i, f"t{i}", "s") for i in range(300)] + [(None, None, None), (7, "again", "s"), (7, "again", "s"), (-5, "é" * 10, "s")]
    got = sharding.shard(docs_of(spark, rows), 16).collect()
    assert len(got) == len(rows)
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.shard, r.slot)), key=lambda r: r.shard):
        assert [r.slot for r in group] == list(range(sum(g.shard == _ for g in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)} and {r.size for r in got if r.doc_id == -5} == {21}
    assert sharding.shard(docs_of(spark, rows).limit(0)).count() == 0


def test_growing_moves_no_more_than_its_share():
    keys = np.arange(100_000, dtype=np.int64)
    moved = sharding.jump_hash(keys, 16) != sharding.jump_hash(keys, 17)
    assert 0.05 < moved.mean() < 0.068 and set(sharding.jump_hash(keys, 17)[moved]) == {16}
    counts = np.bincount(sharding.jump_hash(keys, 16))
    assert counts.min() > 0.93 * counts.mean()


def test_temper_meets_its_limits():
    tokens = {"a": 1000, "b": 100, "c": 400, None: 50, "zero": 0}
    even = source_mixing.temper(tokens, repetition=None)
    assert even.exponent == 0 and even.turns["zero"] == 1 and even.weights["zero"] == 0
    held = source_mixing.temper(tokens, repetition=2.0)
    assert max(held.turns.values()) == pytest.approx(2, abs=1e-4) and min(held.turns.values()) == 1
    spread = source_mixing.temper(tokens, repetition=None, entropy=0.9)
    assert -sum(w * np.log(w) for w in spread.weights.values() if w) / np.log(4) == pytest.approx(0.9, abs=1e-6)
    assert source_mixing.temper({}).turns == {} and source_mixing.temper({"a": 5}).turns == {"a": 1.0}


def test_mixing_edge_cases(spark):
    rows = [(i, "one two three", "big") for i in range(400)] + [(1000 + i, "four five", "small") for i in range(90)] + [(2000, None, None), (2001, "", None), (None, "six", "small"), (3000, "w " * 100_000, "big"), (1001, "four five", "small")]
    frame = docs_of(spark, rows)
    for block in (1 << 20, 20):
        uses = source_mixing.mix(frame, block_tokens=block).select("row.doc_id", "row.source", "n_tokens", "epoch", "mix_block").collect()
        first = [u for u in uses if u.epoch == 0]
        assert len(first) == len(rows)
        again = {s: sum(u.n_tokens for u in uses if u.source == s and u.epoch == 1) for s in ("big", "small")}
        assert again["big"] == 0 and 170 < again["small"] <= 183
        assert all(0 <= u.mix_block < 64 for u in uses)
    assert source_mixing.mix(frame.limit(0)).count() == 0
    with pytest.raises(ValueError, match="sources"):
        source_mixing.mix(frame, most_sources=1)
