"""Queries that make what they need from the documents, and no more of the index."""

import re

import duckdb
import pytest

from quern.operators import index as I
from quern.operators import nearest, rank, scan, vectors
from quern.operators import terms as T
from quern.plans import catalog
from quern.sources import store

FOLDER = "/root/testdata/sf0.001"
UNINDEXED = (
    "tfidf",
    "cosine",
    "semantic",
    "rrf",
    "spell_correct",
    "vocab_trigrams",
    "matched_terms",
    "bm25",
    "stats",
    "idf",
    "term_df",
    "vocabulary",
    "posting_totals",
    "postings",
    "positions",
    "lexemes",
    "title_vocabulary",
    "suggest",
    "completions",
    "corpus_stats",
    "doc_lengths",
)


@pytest.mark.parametrize("name", UNINDEXED)
def test_no_index_is_written_for_it(spark, monkeypatch, name):
    def refuse(docs):
        raise AssertionError("the whole index was asked for")

    monkeypatch.setattr(store, "scratch_index", refuse)
    monkeypatch.setattr(catalog, "_held", {})
    with duckdb.connect() as db:
        for table in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        wanted = db.sql(catalog.oracle_sql()[name])
        columns, rows = wanted.columns, wanted.fetchall()
    got = catalog.queries()[name](spark, FOLDER).select(columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))


def test_terms_of_odd_texts(spark):
    texts = [(1, None, "ONE é ß K x 7 K~Two…two", 0), (2, "a b", "Ωμέγας ΟΔΟΣ ﬁne 𝒳y", 0), (3, "", "", 0), (4, "hopping hopped", "hopping", 0)]
    docs = I.as_documents(spark.createDataFrame(texts, store.DOCUMENTS))
    words = I.tokens(docs).select("doc_id", "field", "offset", "stem").collect()
    got = {(r.term, r.doc_id): r for r in T.postings(docs).collect()}
    single = {key: r.positions for key, r in got.items() if "~" not in key[0]}
    assert single == {(r.stem, r.doc_id): sorted(w.offset for w in words if (w.stem, w.doc_id) == (r.stem, r.doc_id)) for r in words}
    assert got["hop", 4].title_tf == 2 and got["hop", 4].body_tf == 1 and got["hop~hop", 4].title_tf == 3
    lengths = {r.doc_id: (r.title_len, r.body_len) for r in I.doc_stats(docs).collect()}
    assert lengths == {d: tuple(sum(r[f] for r in got.values() if r.doc_id == d) for f in ("title_tf", "body_tf")) for d in (1, 2, 3, 4)}


def test_scanned_bm25_is_that_of_the_index(spark):
    texts = [(n, "red fox", "a red fox and a lazy dog " * (1 + n % 3), 1_000_000 - 86_400 * (n % 4)) for n in range(30)] + [(90, "", "", 0), (91, None, "dog dog", None)]
    docs = I.as_documents(spark.createDataFrame(texts, store.DOCUMENTS))
    asked = [(7, 0, "fox"), (7, 1, "red"), (7, 2, "fox"), (8, 0, "red~fox"), (8, 1, "dog"), (9, 0, "none"), (3, 0, "lazi")]
    asked = spark.createDataFrame(asked, "qid long, pos int, term string")
    index = I.build_index(docs, persist=False)
    shown = ["qid", "rank", "doc_id", "matched_terms"]
    wanted = rank.bm25(asked, index.postings, index.df, index.stats, index.corpus, 1_000_000, 5)
    got = scan.bm25(asked, docs, 1_000_000, 5)
    assert sorted(map(tuple, got.select(shown).collect())) == sorted(map(tuple, wanted.select(shown).collect()))
    scores = [{(r.qid, r.doc_id): r.score for r in found.collect()} for found in (got, wanted)]
    assert scores[0] == pytest.approx(scores[1], abs=1e-9)


def test_snippets_need_no_index(spark, monkeypatch):
    def refuse(docs):
        raise AssertionError("the whole index was asked for")

    monkeypatch.setattr(store, "scratch_index", refuse)
    monkeypatch.setattr(catalog, "_held", {})
    assert all(r.snippet for r in catalog.queries()["snippet"](spark, FOLDER).collect())


ODD = [(1, "a~bb cc~dd", "Cc~Dd cc dd x~yy~zz cc dd~ee~ff~gg", 0), (2, None, "cc dd dd ee ff gg bb", 0), (3, "", "", 0), (4, "cc", None, 0), (5, "bb bb", "hopping ~ hopped cc", 0)] + [
    (n, "cc bb", "dd ee ff", 0) for n in range(6, 26)
]


@pytest.mark.parametrize("limits", [{}, {"HELD": 0}, {"NAMED": 0}, {"CELLS": 1}])
def test_vectors_without_an_index_are_those_of_the_index(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(vectors, name, value)
    docs = I.as_documents(spark.createDataFrame(ODD, store.DOCUMENTS))
    asked = [(7, 0, "cc~dd"), (7, 1, "cc"), (7, 2, "cc"), (8, 0, "dd~ee"), (8, 1, "hop"), (8, 2, "none"), (9, 0, "none"), (3, 0, "gg"), (3, 1, "bb"), (3, 2, "ee")]
    asked = spark.createDataFrame(asked, "qid long, pos int, term string")
    index = I.build_index(docs)
    rounded = lambda df, *keys: {tuple(r[k] for k in keys): pytest.approx([v for c, v in r.asDict().items() if c not in keys], abs=1e-9) for r in df.collect()}
    plain = lambda df, *keys: {tuple(r[k] for k in keys): [v for c, v in r.asDict().items() if c not in keys] for r in df.collect()}
    assert plain(vectors.vectors(docs), "doc_id", "term") == rounded(index.vectors, "doc_id", "term")
    similar = rank.cosine(rank.query_vectors(asked, index.df, index.corpus), index.vectors)
    own = vectors.Similarity(asked, docs)
    assert plain(own.cosine(), "qid", "doc_id") == rounded(similar, "qid", "doc_id")
    hits = spark.createDataFrame([(7, 5), (7, 1), (7, 20), (7, 3), (8, 5), (9, 1), (3, 25), (3, 2)], "qid long, doc_id long")
    assert set(map(tuple, own.ranks(hits, 4).collect())) == set(map(tuple, rank.similar_ranks(similar, hits, 4).collect()))


def test_blend_needs_no_index(spark, monkeypatch):
    def refuse(docs):
        raise AssertionError("the whole index was asked for")

    monkeypatch.setattr(store, "scratch_index", refuse)
    monkeypatch.setattr(catalog, "_held", {})
    with duckdb.connect() as db:
        for table in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        wanted = {r[:4]: r[4] for r in db.sql(catalog.oracle_sql()["blend"]).fetchall()}
    got = {tuple(r)[:4]: r.score for r in catalog.queries()["blend"](spark, FOLDER).select("blend", "qid", "rank", "doc_id", "score").collect()}
    assert got == pytest.approx(wanted, abs=1.1e-5)  # the fifth decimal of a sum that ends in a five is open


@pytest.mark.parametrize("name", ["trigram_suggest", "correct_query"])
def test_nearest_terms_need_no_index(spark, monkeypatch, name):
    test_no_index_is_written_for_it(spark, monkeypatch, name)


def odd_tables(spark):
    docs = I.as_documents(spark.createDataFrame(ODD, store.DOCUMENTS))
    asked = [(7, 0, "cc~dd"), (7, 1, "cc"), (7, 2, "cc"), (8, 0, "dd~ee"), (8, 1, "hop"), (8, 2, "none"), (9, 0, "none"), (3, 0, "gg"), (3, 1, "bb"), (3, 2, "ee")]
    return docs, spark.createDataFrame(asked, "qid long, pos int, term string")


@pytest.mark.parametrize("name", ["tfidf", "cosine", "semantic", "rrf", "blend"])
def test_vectors_are_not_shuffled_however_many_lexemes(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("the documents' vectors were asked for as rows")

    monkeypatch.setattr(vectors, "HELD", 0)
    monkeypatch.setattr(I, "doc_vectors", refuse)
    test_blend_needs_no_index(spark, monkeypatch) if name == "blend" else test_no_index_is_written_for_it(spark, monkeypatch, name)


@pytest.mark.parametrize("limits", [{}, {"HELD": 0, "CELLS": 1}, {"NAMED": 0}])
def test_hits_are_those_of_the_index(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(vectors, name, value)
    docs, asked = odd_tables(spark)
    index = I.build_index(docs)
    wanted = rank.bm25(asked, index.postings, index.df, index.stats, index.corpus, 1_000_000, 4)
    got = vectors.Similarity(asked, docs, 1_000_000).hits(4)
    keyed = lambda df: {(r.qid, r.doc_id, r.rank): r.score for r in df.collect()}
    assert keyed(got) == pytest.approx(keyed(wanted), abs=1e-9)


def test_a_chunk_looks_once_for_the_bucket_of_a_term(monkeypatch):
    asked = []
    monkeypatch.setattr(T, "crc32", lambda raw, of=T.crc32: asked.append(raw) or of(raw))
    chunk = vectors._Chunk((T._Stems(str), T._Stems(str)), {})
    chunk.add(4, "red fox", "lazy dog x red owl", None, 1.0)
    rows = chunk.rows(9, {}).to_pylist()
    assert sorted(asked) == [b"dog", b"fox", b"lazy", b"owl", b"red"]
    packs = {r["bucket"]: vectors._opened(r["size"], r["pack"])[8 * r["n"] :].decode().split("\n") for r in rows if r["bucket"] >= 0}
    assert sorted(t for terms in packs.values() for t in terms) == ["dog", "fox", "lazy", "owl", "red"]
    assert all(terms == sorted(terms) and {vectors.T.crc32(t.encode()) % vectors.BUCKETS for t in terms} == {b} for b, terms in packs.items())


def nearest_by_comparing_all(tokens, docs, k):
    """token, rank, term, jaccard, each token compared with each run of one to three stems of a field."""
    grams = lambda w: [f"${w}$"[i : i + 3] for i in range(len(w))]
    fields = [T._stems(re.sub(r"[\W\d_]", " ", text), T._Stems(T.stem_word)) for d in docs for text in d[1:3]]
    terms = sorted({t for stems in fields for size in T.SIZES for t in T._runs(stems, size)})
    out = []
    for token in tokens:
        own = set(grams(token))
        scored = [(-both / (len(own) + len(t) - both), t) for t in terms if (both := sum(g in own for g in grams(t)))]
        out += [(token, rank, t, -j) for rank, (j, t) in enumerate(sorted(x for x in scored if -x[0] >= 0.25)[:k], 1)]
    return out


NEAR = [
    (1, "Banana ban a nab", "banan~banana bananas, été ete é aa aaa aaaa b an ana: the then them thing the"),
    (2, "", "ban ana ban ana ban anan search engine searching engines far research é été x serch engin the ban"),
    (3, "été d'été", "la la la la lala lal a la " + "abcdefghij" * 40),
    (4, "then thing", "the ban nab the nab an" + " é" * 5),
    (5, "x", "7"),
]


@pytest.mark.parametrize("limits", [{}, {"WORDS": 5, "STEP": 1}, {"DIFFERENT": 2, "STEP": 1}, {"TOKENS": 2, "CELLS": 1, "PAIRS": 1, "FIRST": 2}])
@pytest.mark.parametrize("k", [1, 3, 5])
def test_nearest_terms_are_those_of_all_pairs(spark, monkeypatch, limits, k):
    for name, value in limits.items():
        monkeypatch.setattr(nearest, name, value)
    tokens = ["aaa", "banan", "bananaban", "été", "lalala", "serch", "searchengin", "thethen", "zzz", "", "é", "abcdefghij" * 35]
    docs = spark.createDataFrame([(*d, 0) for d in NEAR], store.DOCUMENTS).coalesce(1)
    asked = spark.createDataFrame([(t,) for t in [*tokens, "aaa"]], "token string")
    got = sorted(map(tuple, nearest.suggest(asked, docs, limit=k).collect()))
    assert got == sorted(nearest_by_comparing_all(tokens, NEAR, k))


def test_known_tokens_stay_and_others_become_the_nearest_term(spark):
    docs = spark.createDataFrame([(*d, 0) for d in NEAR], store.DOCUMENTS)
    typed = ["the", "banan", "zzz", "é", "", "aaa", "thin", "serch"]
    asked = spark.createDataFrame(list(enumerate(typed)), "pos int, token string")
    terms = set(T._stems(re.sub(r"[\W\d_]", " ", " ".join(t for d in NEAR for t in d[1:3])), T._Stems(T.stem_word)))
    better = {t: term for t, _, term, _ in nearest_by_comparing_all(typed, NEAR, 1) if t not in terms}
    got = {r.pos: (r.token, r.term, r.corrected) for r in nearest.correct_tokens(asked, docs).collect()}
    assert got == {n: (t, better.get(t, t), t in better) for n, t in enumerate(typed)}
    assert better and terms & set(typed)


def test_tokens_with_joiners_are_refused(spark):
    docs = spark.createDataFrame([(*d, 0) for d in NEAR], store.DOCUMENTS)
    with pytest.raises(ValueError):
        nearest.suggest(spark.createDataFrame([("ban~ana",)], "token string"), docs)


@pytest.mark.parametrize("name", ["trigram_suggest", "correct_query"])
def test_nearest_terms_need_no_vocabulary(spark, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("the whole vocabulary was asked for")

    monkeypatch.setattr(T, "frequencies", refuse)
    test_no_index_is_written_for_it(spark, monkeypatch, name)
