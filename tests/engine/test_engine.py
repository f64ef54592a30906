import math

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import index as I
from quern.operators import lexicon, query, rank, suggest, typo
from quern.operators.snippet import snippet
from quern.plans.engine import SearchEngine, latest_median, upper_median
from quern.sources import samples, store
from quern.streaming.ingest import ingest

NOW = 1_704_067_200


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine(spark, store.scratch_index(samples.sample_corpus(spark, NOW)))


def ask(spark, *raws):
    return spark.createDataFrame(list(enumerate(raws)), "qid long, raw string")


def column(frame, expression):
    return [r[0] for r in frame.select(expression).collect()]


def test_lexemes_of_queries(spark):
    frame = spark.createDataFrame([("machine~learning search",), ("inverted  index!",), ("é a ~ b",), ("",), (None,)], "t string")
    assert column(frame, query.query_lexemes("t")) == [["machin~learn", "search"], ["invert", "index"], ["é"], [], []]


def test_text_expressions(spark):
    frame = spark.createDataFrame([("ab",), ("",), ("aaaa",)], "t string")
    assert column(frame, X.char_trigrams(F.col("t"))) == [["$ab", "ab$"], [], ["$aa", "aaa", "aaa", "aa$"]]
    assert column(frame.limit(1), X.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2)) == [["a~b", "b~c"]]
    assert column(frame.limit(1), X.ngrams(F.array(F.lit("a")), 2)) == [[]]
    assert column(frame.limit(1), X.html_escape(F.lit("<a & 'b' \"c\">"))) == ["&lt;a &amp; 'b' &quot;c&quot;&gt;"]
    assert column(frame.limit(1), X.lead_sentences(F.lit("One. Two! Three."))) == ["One. Two!"]
    assert column(frame.limit(1), X.lead_sentences(F.lit("no end"))) == ["no end"]


def test_postings_lengths_and_positions(spark):
    docs = spark.createDataFrame([(1, "Big data base", "The data… is é a data. 7x", 0), (2, "", None, 0), (3, "x", "", 0)], store.DOCUMENTS)
    index = I.build_index(docs, persist=False)
    got = {(r.term, r.doc_id): (r.title_tf, r.body_tf, r.positions) for r in index.postings.collect()}
    assert got["data", 1] == (1, 2, [4, 18, 32])
    assert got["big~data", 1] == (3, 0, []) and got["big~data~bas", 1] == (5, 0, [])
    assert got["th~data", 1] == (0, 1, []) and got["th~data~is", 1] == (0, 2, [])
    assert ("é", 1) in got and ("a", 1) not in got
    assert {r.doc_id: (r.title_len, r.body_len) for r in index.stats.collect()} == {1: (3 + 6 + 5, 5 + 4 + 6), 2: (0, 0), 3: (0, 0)}
    assert index.corpus.first().asDict() == {"total_docs": 3, "avg_title_length": 14 / 3, "avg_body_length": 5.0}


def test_only_first_eight_positions_stay(spark):
    docs = spark.createDataFrame([(1, "cat cat", "cat " * 20, 0)], store.DOCUMENTS)
    row = I.postings(I.as_documents(docs)).filter("term = 'cat'").first()
    assert row.positions == [0, 4, 8, 12, 16, 20, 24, 28] and (row.title_tf, row.body_tf) == (2, 20)


def test_lexemes_with_joiners_are_counted_as_one(spark):
    docs = spark.createDataFrame([(1, "machine~learning", "learning", 0)], store.DOCUMENTS)
    assert {(r.term, r.n) for r in I.lexeme_counts(docs, I.postings(docs)).collect()} == {("machin~learn", 1), ("learn", 1)}


def test_completions_are_titles_first(spark, engine):
    docs = spark.createDataFrame([(1, "Search  Engines", "zebra", 0), (2, "search tips", "", 0)], store.DOCUMENTS)
    got = {r.term: r.weight for r in I.completions(I.title_terms(docs)).collect()}
    assert got == {"search engines": 10_000, "search tips": 10_000, "search": 200, "engin": 100, "tip": 100}
    table = spark.createDataFrame([("search", 100), ("searcher", 30), ("searching", 80), ("sea", 10)], "term string, weight long")
    asked = spark.createDataFrame([(0, "sea"), (1, "zz"), (2, "sea"), (3, "")], "qid long, prefix string")
    done = suggest.complete(asked, table).orderBy("qid", "rank").collect()
    assert [(r.term, r.weight) for r in done if r.qid == 0] == [("search", 100), ("searching", 80), ("searcher", 30), ("sea", 10)]
    assert {r.qid for r in done} == {0, 2}
    found = engine.suggest(ask(spark, " Unit  tests", "querying", "", "zebra")).orderBy("qid", "rank").collect()
    assert [(r.qid, r.term) for r in found][:1] == [(0, "unit tests that help")] and {r.qid for r in found} == {0, 1}


def test_phrases_are_found_greedily_and_take_their_words(spark):
    known = lexicon.phrase_terms(lexicon.default_phrases())
    got = query.detect_phrases(ask(spark, "natural language processing data base", "big O notation", "x machine learning machine learning", "", "42 !"), known).orderBy("qid").collect()
    assert [r.phrases for r in got] == [["natur~languag~process", "data~bas"], ["big~o"], ["machin~learn"] * 2, [], []]
    assert [sorted(r.used) for r in got] == [[0, 1, 2, 3, 4], [0, 1], [1, 2, 3, 4], [], []]


def test_three_word_phrases_come_before_earlier_two_word_ones(spark):
    got = query.detect_phrases(ask(spark, "a b c d"), ["a~b", "b~c~d"]).first()
    assert got.phrases == ["b~c~d"]


def test_processed_queries(spark, engine):
    got = {r.qid: r for r in engine.process(ask(spark, "machine learning models", "lokups", "fast fast", "", "machine learning machine learning", "zzzzqqqq")).collect()}
    assert got[0].phrases == ["machin~learn"] and got[0].tokens[0] == "machin~learn" and "model" in got[0].tokens
    assert got[1].corrections == [("lokups", "lookup")] and "lookup" in got[1].tokens
    assert got[2].tokens == ["quick", "fast"] and [tuple(e) for e in got[2].expansions] == [("fast", ["quick"])] * 2
    assert got[3].tokens == [] and got[3].corrections == []
    assert got[4].tokens == ["machin~learn"]
    assert got[5].tokens == ["zzzzqqqq"] and got[5].corrections == []


def brute_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return 1 - row[-1] / max(len(a), len(b)) if a or b else 1.0


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
    return out


def test_spelling_candidates_lose_nothing(spark):
    import random

    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(500)})
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 14))) for _ in range(60)})
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    needles = spark.createDataFrame([(w, w[: max(1, len(w) - 1)]) for w in words], "word string, stem string")
    got = {r.word: (r.term, round(r.sim, 9)) for r in typo.spell_correct(needles, vocabulary).collect()}
    want = {}
    for w in words:
        scored = [(max(brute_similarity(w, t), brute_similarity(w[: max(1, len(w) - 1)], t)), t) for t in terms]
        best = min(scored, key=lambda x: (-x[0], x[1]))
        if best[0] >= 0.78:
            want[w] = (best[1], round(best[0], 9))
    assert got == want


def test_trigrams_count_with_multiplicity(spark):
    vocabulary = spark.createDataFrame([("aaaa",), ("abc",)], "term string")
    asked = spark.createDataFrame([("aaa",), ("zz",)], "token string")
    trigrams = I.vocab_trigrams(vocabulary)
    got = typo.trigram_best(asked, trigrams, I.trigram_counts(trigrams)).collect()
    assert [(r.token, r.term, r.jaccard) for r in got] == [("aaa", "aaaa", 4 / 3)]


def test_recency_and_fusion(spark):
    days = spark.createDataFrame([(0,), (30,), (-5,)], "d int")
    got = column(days, rank.recency(F.lit(NOW) - F.col("d") * 86400, F.lit(NOW)))
    assert got == pytest.approx([1, 0.65, 1])
    lists = [spark.createDataFrame([(0, d, r) for r, d in enumerate(x, 1)], "qid long, doc_id long, rank int") for x in ((1, 2, 3), (3, 1, 2))]
    fused = rank.rrf(*lists, 1, 1, 3).orderBy("rank").collect()
    assert fused[0].doc_id == 1 and fused[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_trigram_scores_match_all_pairs(spark):
    terms = ["aaaa", "aaaaaaa", "banana", "bananas", "ban", "nab", "a", "", "été", "search~engin", "searching~engines~far", "research"]
    tokens = ["aaa", "banan", "a", "ete", "été", "serch", "search~engine", "zzz"]
    grams = lambda w: [f"${w}$"[i : i + 3] for i in range(len(w))]
    want = {}
    for a in tokens:
        for b in terms:
            both = sum(g in set(grams(a)) for g in grams(b))
            value = both / max(1, len(set(grams(a))) + len(grams(b)) - both)
            if both and value >= 0.25:
                want[a, b] = pytest.approx(value)
    asked = spark.createDataFrame([(t,) for t in tokens], "token string")
    vocabulary = spark.createDataFrame([(t,) for t in terms], "term string")
    trigrams = I.vocab_trigrams(vocabulary)
    got = typo.trigram_scores(asked, trigrams, I.trigram_counts(trigrams)).collect()
    assert {(r.token, r.term): r.jaccard for r in got} == want and len(got) == len(want)


def test_ranks_for_fusion_match_the_whole_list(spark):
    scores = [(q, d, round(((d * 37 + q) % 11) / 11 + 0.01, 6)) for q in (1, 2) for d in range(60)]
    similar = spark.createDataFrame(scores, "qid long, doc_id long, score double")
    hits = spark.createDataFrame([(1, 5), (1, 59), (1, 999), (2, 0), (3, 1)], "qid long, doc_id long")
    whole = {(r.qid, r.doc_id): r.rank for r in rank.top(similar, None).collect()}
    got = rank.similar_ranks(similar, hits, 4).collect()
    assert {(r.qid, r.doc_id): r.rank for r in got} == {k: v for k, v in whole.items() if v <= 4 or k in {(1, 5), (1, 59), (2, 0)}}
    assert len(got) == len({(r.qid, r.doc_id) for r in got})


def test_cosine_of_equal_and_of_unlike_vectors(spark):
    vectors = spark.createDataFrame([(1, "a", 1.0, math.sqrt(5)), (1, "b", 2.0, math.sqrt(5)), (2, "c", 1.0, 1.0)], "doc_id long, term string, weight double, norm double")
    asked = vectors.filter("doc_id = 1").withColumnRenamed("doc_id", "qid")
    assert [(r.doc_id, pytest.approx(r.score)) for r in rank.cosine(asked, vectors).collect()] == [(1, 1.0)]


def plain_bm25(docs, terms, now):
    """Straight from the formulas, for one query."""
    from quern.functions.stem import stem_word

    def field(text, weights):
        stems = [stem_word(w) for w in text.replace(".", " ").split() if len(w.encode()) >= 2]
        tf = {}
        for n, weight in enumerate(weights, 1):
            for i in range(len(stems) - n + 1):
                key = "~".join(stems[i : i + n])
                tf[key] = tf.get(key, 0) + weight
        return tf

    parsed = {d: (field(t, (1, 3, 5)), field(b, (1, 1, 2)), c) for d, t, b, c in docs}
    n, average = len(docs), [sum(sum(p[k].values()) for p in parsed.values()) / len(docs) for k in (0, 1)]
    out = {}
    for term in terms:
        df = sum(term in p[0] or term in p[1] for p in parsed.values())
        for d, (title, body, created) in parsed.items():
            if term in title or term in body:
                score = 0
                for tf, mean, weight in ((title, average[0], 8), (body, average[1], 1)):
                    x = tf.get(term, 0)
                    score += weight * x * 2.5 / (x + 1.5 * (0.25 + 0.75 * sum(tf.values()) / max(mean, 1))) if x else 0
                age = max(now - created, 0) / 86400
                out[d] = out.get(d, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * score * (0.3 + 0.7 * math.exp(-math.log(2) / 30 * age))
    return out


def test_bm25_matches_the_formulas(spark):
    docs = [(1, "cat food", "the cat eats. cat food is food", NOW), (2, "dogs", "dog and cat", NOW - 86400 * 30), (3, "", "nothing here", NOW + 999)]
    index = I.build_index(spark.createDataFrame(docs, store.DOCUMENTS), persist=False)
    terms = ["cat", "cat", "food", "cat~food", "absent"]
    asked = spark.createDataFrame([(0, i, t) for i, t in enumerate(terms)], "qid long, pos int, term string")
    got = rank.bm25(asked, index.postings, index.df, index.stats, index.corpus, NOW, 5).collect()
    assert {r.doc_id: pytest.approx(r.score) for r in got} == plain_bm25(docs, terms, NOW)
    assert next(r.matched_terms for r in got if r.doc_id == 1) == ["cat", "food", "cat~food"]
    assert rank.bm25(asked, index.postings, index.df, index.stats, index.corpus, NOW, 0).count() == 0


BODY = "First one here. The cats sat down & slept! Was it late? Nobody knew."


@pytest.mark.parametrize(
    ("body", "stems", "want"),
    [
        ("", ["cat"], ""), (None, [], ""), ("no end", [], "no end"), ("One. Two. Three.", None, "One. Two."),
        (BODY, ["cat"], "The <mark>cats</mark> sat down &amp; slept! Was it late?…"), (BODY, ["absent"], "First one here. The cats sat down &amp; slept!…"),
        (" ".join(f"w{'abcdefghijklm'[i]}" for i in range(13)) + " target", ["target"], "wd we wf wg wh wi wj wk wl wm <mark>target</mark>"),
        ("a \"b\" <c> target", ["target"], "a &quot;b&quot; &lt;c&gt; <mark>target</mark>"),
    ],
)
def test_snippets(body, stems, want):
    assert snippet(body, stems) == want


def test_search_end_to_end(spark, engine):
    got = engine.search(ask(spark, "machine learning", "garbage colection", "", "inverted index"), NOW, limit=3).collect()
    first = {r.qid: r for r in got if r.rank == 1}
    assert first[0].title == "Machine learning for ranking" and first[1].title == "Garbage collection explained" and first[3].title == "Inverted index basics"
    assert 2 not in first and all(0 < r.score <= 1 / 61 + 1e-9 for r in got)
    assert "<mark>" in first[1].snippet
    one = engine.ask("unit tests", now=NOW, limit=2)
    assert one["total_results"] <= 2 and one["results"][0]["title"] == "Unit tests that help" and one["processed_query"] == ["unit~test"]
    assert engine.health()["status"] == "ok" and engine.health()["p50_latency_us"] > 0
    assert engine.search(ask(spark, "index"), NOW, limit=0).count() == 0
    plain = engine.search(ask(spark, "index"), NOW, semantic_blend=0.0, typo_tolerance=False).collect()
    assert all(r.score <= round(1 / 61, 5) for r in plain)


def test_empty_index_and_one_document(spark):
    empty = SearchEngine(spark)
    assert empty.search(ask(spark, "anything"), NOW).count() == 0 and empty.suggest(ask(spark, "a")).count() == 0
    assert empty.stats().first().asDict() == {"total_docs": 0, "vocab_size": 0, "title_vocab_size": 0, "avg_title_length": 0.0, "avg_body_length": 0.0}
    one = SearchEngine(spark, I.build_index(spark.createDataFrame([(0, "Lone page", "all alone", NOW)], store.DOCUMENTS), persist=False))
    assert one.search(ask(spark, "lone"), NOW).first().score == round(0.6 / 61, 5)


def test_parts_and_streamed_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    engine = SearchEngine(spark, path=path)
    assert [r.doc_id for r in engine.index(samples.sample_corpus(spark, NOW).drop("doc_id")).orderBy("doc_id").collect()] == list(range(10))
    again = SearchEngine(spark, path=path)
    assert again.stats().first() == engine.stats().first()
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    spark.createDataFrame([("Fresh arrival", "brand new words", NOW)], "title string, body string, created_at long").write.parquet(inbox)
    stream = spark.readStream.schema("title string, body string, created_at long").option("maxFilesPerTrigger", 1).parquet(inbox)
    ingest(stream, again, checkpoint).awaitTermination()
    found = SearchEngine(spark, path=path).search(ask(spark, "fresh arrival"), NOW).orderBy("rank").first()
    assert (found.doc_id, found.title) == (10, "Fresh arrival")
    # A stream that lost its last commit repeats the batch, which isn't added twice.
    for commit in (tmp_path / "checkpoint" / "commits").iterdir():
        commit.unlink()
    ingest(stream, again, checkpoint).awaitTermination()
    assert store.load(spark, path).documents.count() == 11
    # A part without its last table isn't read, and a later one takes its number.
    (tmp_path / "index" / "part-4-4-99-" / "postings").mkdir(parents=True)
    assert store.load_or_new(spark, path).documents.count() == 11
    third = SearchEngine(spark, path=path)
    assert [r.doc_id for r in third.index(spark.createDataFrame([("Late", "words")], "title string, body string"), NOW).collect()] == [11]
    assert third.stats().first().total_docs == 12


def test_parts_equal_one_build(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 2)
    path = str(tmp_path / "index")
    docs = samples.sample_corpus(spark, NOW).withColumn("body", F.concat("body", F.lit(" some~joined words")))
    for n in range(4):
        assert store.add(docs.filter(F.col("doc_id") % 4 == n), path, 10, f"s.{n}")
        assert not store.add(docs.limit(0), path, 10, f"s.{n}")
    held = store.parts(spark, path)
    assert len(held) < 4 and held[0].last > held[0].first and held[0].batches["s"] == held[0].last - 1
    got, want = store.load(spark, path).tables(), I.build_index(docs, persist=False).tables()
    for name, frame in want.items():
        key = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(sorted(frame.columns)).collect())
        if name not in ("trigrams", "corpus", "titles"):  # titles are added up in completions
            assert key(got[name]) == key(frame), name
    assert got["corpus"].first().total_docs == 10 and not store.has_batch(spark, path, "t.0")


def test_adding_to_an_index_in_memory(spark):
    engine = SearchEngine(spark, I.build_index(samples.sample_corpus(spark, NOW), persist=False))
    assert [r.doc_id for r in engine.index(spark.createDataFrame([("Zebra", "stripes")], "title string, body string"), NOW).collect()] == [10]
    assert engine.search(ask(spark, "zebra"), NOW).first().doc_id == 10 and engine.health()["rss_mb"] > 0


def test_median_latency(spark):
    assert [upper_median(x) for x in ([], [7], [4, 1, 3, 2], list(range(60)))] == [0, 7, 3, 30]
    log = spark.createDataFrame([(i, i) for i in range(60)], "ts long, us long")
    assert latest_median(log, "ts", "us").first().p50 == 35 and latest_median(log.limit(0), "ts", "us").first().p50 == 0
