"""The search index as tables, built from documents(doc_id, title, body, created_at)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.functions.stem import lexeme_stems, with_stem

#: How much a run of one, two or three words adds to a term's frequency, by field.
WEIGHTS = {"title": (1, 3, 5), "body": (1, 1, 2)}
KEPT_POSITIONS = 8
FULL_TITLE_WEIGHT, TITLE_WORD_WEIGHT = 10_000, 100


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns that the index needs, null titles and bodies as empty."""
    return docs.select(
        F.col("doc_id").cast("long"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), F.col("created_at").cast("long")
    )


def tokens(docs: DataFrame) -> DataFrame:
    """doc_id, field (0 title, 1 body), pos, offset, word, stem of each word of two bytes or more.

    Rows are dealt by doc_id once, here, where they are smallest; the windows and sums that follow keep to that
    partitioning, so nothing else is shuffled until terms are looked at across documents.
    """
    title_bytes = F.octet_length("title")
    both = F.array(
        F.struct(F.lit(0).alias("field"), F.lit(0).alias("start"), F.col("title").alias("text")),
        F.struct(F.lit(1).alias("field"), (title_bytes + 1).alias("start"), F.col("body").alias("text")),
    )
    texts = docs.repartition("doc_id").select("doc_id", F.inline(both))  # flat columns, so that no text goes along with its words
    fields_of = texts.select("doc_id", "field", "start", F.posexplode(X.fragments(F.col("text"))).alias("pos", "word"))
    before = Window.partitionBy("doc_id", "field").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = fields_of.withColumn("offset", (F.col("start") + F.coalesce(F.sum(F.octet_length("word") + 1).over(before), F.lit(0))).cast("long"))
    return with_stem(placed.filter(X.long_enough(F.col("word"))), "word").select("doc_id", "field", "pos", "offset", "word", "stem")


def postings(docs: DataFrame) -> DataFrame:
    """term, doc_id, title_tf, body_tf, positions: words and runs of two and three words, the runs weighted up."""
    order = Window.partitionBy("doc_id", "field").orderBy("pos")
    two, three = F.lead("stem", 1).over(order), F.lead("stem", 2).over(order)
    runs = tokens(docs).select("doc_id", "field", "offset", "stem", two.alias("second"), three.alias("third"))
    weight = lambda n: F.when(F.col("field") == 0, WEIGHTS["title"][n]).otherwise(WEIGHTS["body"][n])
    entry = lambda n, term, offset: F.struct(term.alias("term"), weight(n).alias("tf"), offset.cast("long").alias("offset"))
    join = lambda *names: F.concat_ws(X.JOINER, *names)
    terms = F.array(
        entry(0, F.col("stem"), F.col("offset")),
        entry(1, F.when(F.col("second").isNotNull(), join("stem", "second")), F.lit(None)),
        entry(2, F.when(F.col("third").isNotNull(), join("stem", "second", "third")), F.lit(None)),
    )
    flat = runs.select("doc_id", "field", F.explode(terms).alias("t")).select("doc_id", "field", "t.*").filter("term IS NOT NULL")
    tf = lambda field: F.sum(F.when(F.col("field") == field, F.col("tf")).otherwise(0)).cast("long")
    first = F.slice(F.array_sort(F.collect_list("offset")), 1, KEPT_POSITIONS)
    return flat.groupBy("doc_id", "term").agg(tf(0).alias("title_tf"), tf(1).alias("body_tf"), first.alias("positions")).select("term", "doc_id", "title_tf", "body_tf", "positions")


def total_tf() -> Column:
    """A posting's frequency over both fields."""
    return F.col("title_tf") + F.col("body_tf")


def doc_stats(docs: DataFrame) -> DataFrame:
    """doc_id, created_at, title_len, body_len: lengths are sums of the weighted frequencies; 0 without words.

    So many words make so many runs of each size, so words are counted where the text is read and no term is made.
    """
    n_words = lambda c: F.size(F.filter(X.fragments(F.col(c)), X.long_enough)).cast("long").alias(c)
    runs = lambda c: reduce(Column.__add__, (w * F.greatest(F.col(c) - n, F.lit(0)) for n, w in enumerate(WEIGHTS[c])))
    counted = docs.select("doc_id", "created_at", F.explode(F.array(F.struct(n_words("title"), n_words("body")))).alias("n")).select("doc_id", "created_at", "n.*")
    return counted.select("doc_id", "created_at", runs("title").alias("title_len"), runs("body").alias("body_len"))


def corpus_stats(stats: DataFrame) -> DataFrame:
    """One row: total_docs, avg_title_length, avg_body_length (0 for an empty corpus)."""
    mean = lambda c: F.coalesce(F.sum(c) / F.count("*"), F.lit(0.0)).cast("double")
    return stats.agg(F.count("*").alias("total_docs"), mean("title_len").alias("avg_title_length"), mean("body_len").alias("avg_body_length"))


def term_df(posted: DataFrame) -> DataFrame:
    """term, df (documents with the term in either field), title_df (in the title)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.count_if(F.col("title_tf") > 0).alias("title_df"))


def lexeme_counts(docs: DataFrame, posted: DataFrame) -> DataFrame:
    """doc_id, term, n: stemmed lexemes of title and body together. Words with a joiner between them are one lexeme.

    In a text without joiners they are its words, which the postings count; only texts with joiners are cut again.
    """
    text = "concat_ws(' ', title, body)"
    odd = docs.filter(F.contains(F.expr(text), F.lit(X.JOINER)))
    even = posted.filter(~F.contains("term", F.lit(X.JOINER))).join(odd.select("doc_id"), "doc_id", "left_anti")
    raw = odd.repartition("doc_id").select("doc_id", F.expr(f"explode({X.raw_lexemes(text)}) AS lexeme"))
    plain = with_stem(raw, "lexeme", "term")
    # The stem of a lexeme with joiners goes part by part; the expression is evaluated for such lexemes alone.
    joined = F.when(F.contains(F.col("lexeme"), F.lit(X.JOINER)), F.get(lexeme_stems("array(lexeme)"), 0)).otherwise(F.col("term"))
    counted = plain.select("doc_id", joined.alias("term")).filter("term <> ''").groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return even.filter("term <> ''").select("doc_id", "term", total_tf().alias("n")).unionByName(counted)


def doc_vectors(counted: DataFrame, df: DataFrame, corpus: DataFrame) -> DataFrame:
    """doc_id, term, weight, norm: augmented frequency times ln(documents / df), and the length of the document's vector."""
    most = F.max("n").over(Window.partitionBy("doc_id"))
    scaled = counted.withColumn("most", most)
    total = F.broadcast(corpus.select(F.col("total_docs")))  # one row
    weighed = scaled.join(df.select("term", "df"), "term").join(total).select(
        "doc_id", "term", ((0.5 + 0.5 * F.col("n") / F.greatest("most", F.lit(1))) * F.log(F.col("total_docs") / F.col("df"))).alias("weight")
    )
    norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norms, "doc_id")


def title_terms(docs: DataFrame) -> DataFrame:
    """term, whole (whether it is a whole title), words (how often it is the stem of a title's word): what completions are weighed by."""
    titles = docs.select(X.collapse(F.col("title")).alias("title")).filter(X.long_enough(F.col("title")))
    whole = titles.select(F.lower("title").alias("term"), F.lit(True).alias("whole"), F.lit(0).alias("words"))
    word = docs.select(F.explode(F.filter(X.fragments(F.col("title")), X.long_enough)).alias("word"))
    counted = with_stem(word, "word", "term").select("term", F.lit(False).alias("whole"), F.lit(1).alias("words"))
    return whole.unionByName(counted).groupBy("term").agg(F.max("whole").alias("whole"), F.sum("words").alias("words"))


def completions(titles: DataFrame) -> DataFrame:
    """term, weight: whole titles at FULL_TITLE_WEIGHT, stems of title words by how often they occur; the larger weight counts."""
    added = titles.groupBy("term").agg(F.max("whole").alias("whole"), F.sum("words").alias("words"))
    full = F.when(F.col("whole"), FULL_TITLE_WEIGHT).otherwise(0)
    return added.select("term", F.greatest(full, F.col("words") * TITLE_WORD_WEIGHT).cast("long").alias("weight"))


def vocab_trigrams(df: DataFrame) -> DataFrame:
    """trigram, term, n_trigrams, n_repeats, again: a row for each different character trigram of a term; again lists those that repeat an earlier one, null if none does."""
    whole = df.select("term", F.explode(F.array(X.char_trigrams(F.col("term")))).alias("all"))  # a generator, so that they are made once
    kinds = whole.select("term", "all", F.explode(F.array(F.array_distinct("all"))).alias("kinds"))
    repeats = F.col("n_trigrams") - F.size("kinds")
    again = F.when(F.size("all") > F.size("kinds"), F.filter("all", lambda t, i: F.array_position("all", t) <= i))
    each = kinds.select("term", F.size("all").alias("n_trigrams"), "kinds", F.explode(F.array(again)).alias("again"))
    return each.select("term", "n_trigrams", repeats.cast("int").alias("n_repeats"), "again", F.explode("kinds").alias("trigram")).select("trigram", "term", "n_trigrams", "n_repeats", "again")


def trigram_counts(trigrams: DataFrame) -> DataFrame:
    """trigram, often: how many terms have it. No more rows than there are trigrams of letters."""
    return trigrams.groupBy("trigram").agg(F.count("*").alias("often"))


@dataclass
class Index:
    """The tables of an index. All but corpus and trigram_counts grow with the corpus.

    Those in BASE can be added up from those of its parts; the others follow from them.
    """

    documents: DataFrame
    postings: DataFrame
    stats: DataFrame
    counts: DataFrame
    titles: DataFrame
    df: DataFrame
    corpus: DataFrame
    vectors: DataFrame
    completions: DataFrame
    trigrams: DataFrame
    trigram_counts: DataFrame

    @property
    def vocabulary(self) -> DataFrame:
        return self.df.select("term")

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def unpersist(self) -> None:
        for frame in self.tables().values():
            frame.unpersist()


#: What a part of an index holds; documents, written last, mark it as whole.
BASE = ("postings", "stats", "counts", "titles", "df", "documents")


def _as_they_are(_: str, df: DataFrame) -> DataFrame:
    return df


def base_tables(docs: DataFrame, keep: Callable[[str, DataFrame], DataFrame] = _as_they_are) -> dict[str, DataFrame]:
    """The tables of BASE for some documents; keep(name, table) says how a table that others are made from is held."""
    docs = keep("documents", as_documents(docs))
    posted = keep("postings", postings(docs))
    return {
        "postings": posted, "stats": keep("stats", doc_stats(docs)), "counts": keep("counts", lexeme_counts(docs, posted)),
        "titles": keep("titles", title_terms(docs)), "df": keep("df", term_df(posted)), "documents": docs,
    }


def merged_df(parts: DataFrame) -> DataFrame:
    """term, df, title_df over all parts of an index."""
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("title_df").alias("title_df"))


def derived_tables(base: dict[str, DataFrame], keep: Callable[[str, DataFrame], DataFrame] = _as_they_are) -> Index:
    """The whole index from its base tables, which may be unions of those of its parts, df apart: it has to be merged."""
    corpus = keep("corpus", corpus_stats(base["stats"]))
    trigrams = keep("trigrams", vocab_trigrams(base["df"]))
    return Index(
        **base, corpus=corpus, vectors=keep("vectors", doc_vectors(base["counts"], base["df"], corpus)), completions=keep("completions", completions(base["titles"])),
        trigrams=trigrams, trigram_counts=keep("trigram_counts", trigram_counts(trigrams)),
    )


def build_index(docs: DataFrame, persist: bool = True) -> Index:
    """All tables of the index in memory or, with persist=False, as plans; an index on disk is built by sources.store."""
    lazy = {"trigrams"}  # many and cheap, so they are made from the vocabulary again

    def keep(name: str, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.MEMORY_AND_DISK) if persist and name not in lazy else df

    return derived_tables(base_tables(docs, keep), keep)
