"""From raw queries to the terms that are ranked: phrases, spelling, synonyms, fuzzy matching.

Queries come in batches: queries(qid, raw). Everything about one query is one row or a few, joined with the
vocabulary by hash, so a batch costs one pass over the vocabulary however many queries it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.stem import query_stems
from quern.operators import typo
from quern.sources.scratch import written

NO_STRINGS = "array<string>"


def _empty(kind: str = NO_STRINGS) -> Column:
    return F.array().cast(kind)


def _windows(stems: Column, size: int, phrases: Column, taken: Column) -> Column:
    """Where known phrases of `size` words begin, left to right, none overlapping another or a taken place."""
    last = F.size(stems) - size
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(_empty("array<int>"))

    def step(found: Column, at: Column) -> Column:
        term = F.array_join(F.slice(stems, at + 1, size), X.JOINER)
        free = F.coalesce(F.element_at(found, -1) + size <= at, F.lit(True))
        for k in range(size):
            free = free & ~F.array_contains(taken, at + k)
        return F.when(free & F.array_contains(phrases, term), F.concat(found, F.array(at))).otherwise(found)

    # An element before the first place makes the array's last element always defined.
    return F.filter(F.aggregate(places, F.array(F.lit(-size)), step), lambda x: x >= 0)


def _cover(begins: Column, size: int) -> Column:
    return F.flatten(F.transform(begins, lambda b: F.sequence(b, b + size - 1)))


def _settled(df: DataFrame, *columns: str | Column) -> DataFrame:
    """df.select(columns) behind a generator of one element: later filters and projections use the columns' values, not their expressions."""
    return df.select(*columns).select(F.explode(F.array(F.struct("*"))).alias("r")).select("r.*")


def detect_phrases(queries: DataFrame, phrases: Sequence[str]) -> DataFrame:
    """qid, raw, words, stems, phrases, used: known phrases of three words first, then of two; used are their words' places."""
    known = F.array(*map(F.lit, phrases)) if phrases else _empty()
    row = ["qid", "raw", "words", "stems"]
    cut = _settled(queries, "qid", "raw", X.query_words(F.col("raw")).alias("words"))
    cut = _settled(cut, "qid", "raw", "words", query_stems(F.col("words")).alias("stems"))
    cut = _settled(cut, *row, _windows(F.col("stems"), 3, known, _empty("array<int>")).alias("threes"))
    cut = _settled(cut, *row, "threes", _cover(F.col("threes"), 3).alias("covered"))
    cut = _settled(cut, *row, "threes", "covered", _windows(F.col("stems"), 2, known, F.col("covered")).alias("twos"))
    term = lambda size: lambda b: F.array_join(F.slice("stems", b + 1, size), X.JOINER)
    found = F.concat(F.transform("threes", term(3)), F.transform("twos", term(2)))
    return _settled(cut, *row, found.alias("phrases"), F.concat("covered", _cover(F.col("twos"), 2)).alias("used"))


def single_words(detected: DataFrame) -> DataFrame:
    """qid, pos, word, stem of the words that no phrase took."""
    each = detected.select("qid", "used", F.posexplode(F.arrays_zip("words", "stems")).alias("pos", "w"))
    return each.filter(~F.array_contains("used", F.col("pos"))).select("qid", "pos", F.col("w.words").alias("word"), F.col("w.stems").alias("stem"))


def correct_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """words with term: the stem if the vocabulary has it, else the most similar term, else the stem; corrected says which."""
    known = vocabulary.select(F.col("term").alias("known"))
    marked = words.join(known, F.col("stem") == F.col("known"), "left")
    unknown = marked.filter("known IS NULL").select("word", "stem")
    better = typo.spell_correct(unknown, vocabulary).select("word", "stem", F.col("term").alias("better"))
    joined = marked.join(better, ["word", "stem"], "left")
    return joined.select("qid", "pos", "word", "stem", F.coalesce("known", "better", "stem").alias("term"), (F.col("known").isNull() & F.col("better").isNotNull()).alias("corrected"))


def expand_terms(terms: DataFrame, synonyms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """terms (with a column term) with synonyms: those that the vocabulary has, in order; empty if none."""
    useful = synonyms.join(vocabulary.withColumnRenamed("term", "synonym"), "synonym", "left_semi")
    listed = useful.groupBy("stem").agg(F.array_sort(F.collect_set("synonym")).alias("synonyms")).withColumnRenamed("stem", "head")
    return terms.join(listed, F.col("term") == F.col("head"), "left").drop("head").withColumn("synonyms", F.coalesce("synonyms", _empty()))


def assemble(phrases: Column, words: Column) -> Column:
    """Phrases, then for each word its synonyms and itself unless they are there already; no two equal neighbours."""

    def add(so_far: Column, word: Column) -> Column:
        wider = F.concat(so_far, F.array_except(word["synonyms"], so_far))
        return F.concat(wider, F.array_except(F.array(word["term"]), wider))

    return F.aggregate(words, phrases, add)


def _no_equal_neighbours(tokens: Column) -> Column:
    return F.filter(tokens, lambda x, i: (i == 0) | (x != F.get(tokens, i - 1)))


def process_queries(queries: DataFrame, vocabulary: DataFrame, phrases: Sequence[str], synonyms: DataFrame) -> DataFrame:
    """qid, original, tokens, corrections, expansions, phrases of each query.

    vocabulary: term; synonyms: stem, synonym. corrections are (word, term), expansions (term, synonyms), in order of words.
    """
    detected = detect_phrases(queries, phrases)
    words = expand_terms(correct_words(single_words(detected), vocabulary), synonyms, vocabulary)
    one = F.struct("pos", "word", "term", "corrected", "synonyms")
    listed = words.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("all_words"))
    row = detected.join(listed, "qid", "left").withColumn(
        "all_words", F.coalesce("all_words", _empty("array<struct<pos:int,word:string,term:string,corrected:boolean,synonyms:array<string>>>"))
    )
    tokens = row.withColumn("tokens", assemble(F.col("phrases"), F.col("all_words")))
    pair = lambda w: F.struct(w["word"].alias("word"), w["term"].alias("term"))
    wide = lambda w: F.struct(w["term"].alias("term"), w["synonyms"].alias("synonyms"))
    return tokens.select(
        "qid",
        F.col("raw").alias("original"),
        _no_equal_neighbours(F.col("tokens")).alias("tokens"),
        F.transform(F.filter("all_words", lambda w: w["corrected"]), pair).alias("corrections"),
        F.transform(F.filter("all_words", lambda w: F.size(w["synonyms"]) > 0), wide).alias("expansions"),
        "phrases",
    )


def query_lexemes(raw: str, restem: bool = True) -> Column:
    """Stemmed lexemes of a query string (given as SQL), as the ranker sees it."""
    cut = F.expr(X.raw_lexemes(raw))
    return query_stems(cut, drop_empty=True) if restem else cut


def _each_token(tokens: DataFrame, restem: bool, name: str) -> DataFrame:
    """qid, pos and a token of the stemmed tokens, a row each."""
    stemmed = tokens.select("qid", query_lexemes("array_join(tokens, ' ')", restem).alias("lexemes"))
    return stemmed.select("qid", F.posexplode("lexemes").alias("pos", name))


def fuzzy_terms(tokens: DataFrame, vocabulary: DataFrame, trigrams: DataFrame, counts: DataFrame, restem: bool = True) -> DataFrame:
    """qid, tokens with each token that the vocabulary lacks replaced by the nearest term by trigrams, if one is near enough.

    Tokens are stemmed once more before they are looked up; restem=False leaves out this stemming and the
    ranker's, which can turn a token that is in the vocabulary into one that isn't.
    """
    each = written(_each_token(tokens, restem, "token"), "query-tokens")
    chosen = typo.correct_tokens(each, vocabulary, trigrams, counts).select("qid", F.struct("pos", F.col("term").alias("token")).alias("t"))
    listed = chosen.groupBy("qid").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return tokens.select("qid").join(listed, "qid", "left").select("qid", F.coalesce(F.col("ts.token"), _empty()).alias("tokens"))


def final_terms(tokens: DataFrame, restem: bool = True) -> DataFrame:
    """qid, pos, term for the ranker, repeats kept."""
    return _each_token(tokens, restem, "term")
