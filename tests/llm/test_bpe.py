import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from quern.llm.bpe import Lexicon, Tokenizer, Vocabulary, compile_lexicon, frequent_words, tokenise

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Library.from_file(PATH)
VOCABULARY = Vocabulary(PATH)
MINE = Tokenizer(VOCABULARY, Lexicon.mapped(compile_lexicon((w, VOCABULARY.merge(w)) for w in [b" the", b"The", b" hello", b"hell", b"hel", b" ", "é".encode()])))


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = MINE.encode(text).tolist()
    assert got == want
    assert MINE.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  a", "don't you'LL we'll I'M", "a\x1c\x1db\x85c　d  x", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "x" * 5000, "é" * 999, "日本語 12３ ⅷ ½", "👩‍👩‍👧 ‍", "aaaaaaa" * 99, "### $$$ %%%", "a\u2028b\u3000\u1680 c\u200a\u205f", "\x00\x01�", "́é", "ab᠎c ​ d﻿"],
)
def test_same_as_library(text):
    same(text)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_the_same_as_in_the_library(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdehlort 'sTHE\n\t.,12é", max_size=200))
def test_common_letters_are_the_same_as_in_the_library(text):
    same(text)


def test_transducer_finds_its_words_and_no_others():
    rng = random.Random(5)
    words = {bytes(rng.choice(b"ab\xc3c") for _ in range(rng.randint(1, 7))): [rng.randrange(9) for _ in range(rng.randint(1, 4))] for _ in range(900)}
    lexicon = Lexicon.mapped(compile_lexicon(words.items()))
    for w, ids in words.items():
        assert lexicon.ids(w).tolist() == ids
    for _ in range(2000):
        w = bytes(rng.choice(b"ab\xc3cd") for _ in range(rng.randint(0, 8)))
        assert (lexicon.ids(w) is None) == (w not in words)
    assert Lexicon.mapped(compile_lexicon([])).ids(b"a") is None


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_both_ways_to_merge_agree(word):
    assert VOCABULARY.merge(word) == VOCABULARY._merge_long(word)


def test_suffixes_are_shared():
    ends = [a + b"ation" for a in (b"n", b"st", b"form", b"cre")]
    assert len(Lexicon.mapped(compile_lexicon((w, [1, 2]) for w in ends)).final) < 16


def test_table_and_edge_cases(spark):
    texts = [None, "", "hello the world", "hello the world", "x" * 200_000, "<|endoftext|>"]
    docs = spark.createDataFrame([(i if i != 2 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokenise(docs, PATH, lexicon_words=3).collect()}
    want = set()
    for i, t in enumerate(texts):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        want.add((i if i != 2 else None, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    assert tokenise(docs.limit(0), PATH).count() == 0
    row = tokenise(docs.filter("doc_id = 3"), PATH, keep_ids=True, keep_decoded=True).first()
    assert row.decoded == "hello the world" and row.ids == LIBRARY.encode("hello the world").ids


def test_frequent_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([("a b b",), ("b c",), (None,), ("x" * 65,)], "text string")
    assert frequent_words(docs, 9999) == [" b", " c", "a", "b"]
    assert frequent_words(docs.limit(3), 3) == [" b"]
    assert frequent_words(docs.limit(0), 3) == []


def test_fixture_table_matches_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in tokenise(docs, PATH, lexicon_words=500).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_latin_words_are_those_of_the_pattern():
    import random

    import regex

    from quern.llm.bpe import WORDS, Tokenizer, Vocabulary

    tokenizer, rng = Tokenizer(Vocabulary(PATH)), random.Random(5)
    alphabet = [chr(c) for c in range(256)] + list("  aez'sd09é\n\t\u2009\u0153")
    for _ in range(3000):
        text = "".join(rng.choices(alphabet, k=rng.randrange(40)))
        assert tokenizer.cut(text) == regex.findall(WORDS, text)
