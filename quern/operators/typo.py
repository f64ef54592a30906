"""Terms close to a misspelt one: by edit distance, and by character trigrams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.sources.scratch import written

SPELL_THRESHOLD = 0.78
TRIGRAM_THRESHOLD = 0.25
#: Higher thresholds that are tried before: a token that has enough terms at one of them needs no lower one.
TRIGRAM_LEVELS = (0.5, 0.38)
#: Rows about misspelt words that are sent to every task, so that the vocabulary stays where it is; under 100 MB.
BROADCAST_ROWS = 1_000_000
#: Terms that repeat more trigrams than this are compared by trigram alone.
FEW_REPEATS = 3
#: So few different trigrams asked for are a filter on the stored table, of which all other row groups stay unread.
FILTERED_TRIGRAMS = 500


def _near(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it has no more than BROADCAST_ROWS; else both sides of its join meet by hash."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def similarity(a: Column, b: Column) -> Column:
    """Levenshtein distance as a part of the longer word, taken from 1; two empty words are alike."""
    longer = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def _segments(term: Column, length: Column, most: Column) -> Column:
    """The term cut into most + 1 pieces: (nth, begin, size) of each."""
    return F.transform(
        F.sequence(F.lit(0), most),
        lambda n: F.struct(n.alias("nth"), F.floor(n * length / (most + 1)).cast("int").alias("begin"), (F.floor((n + 1) * length / (most + 1)) - F.floor(n * length / (most + 1))).cast("int").alias("size")),
    )


def spell_candidates(needles: DataFrame, vocabulary: DataFrame, threshold: float = SPELL_THRESHOLD) -> DataFrame:
    """needle, term for all pairs whose similarity can reach the threshold, and more; needles is a column of distinct words.

    A word at `most` edits or fewer has one of most + 1 pieces of the term unchanged, shifted by as many places
    at most. So terms are joined with needles on (length of the term, number of the piece, piece), not compared with all.
    The needles' pieces are counted first: up to BROADCAST_ROWS they go to every task and no term moves.
    """
    edits = lambda n: F.floor(n / threshold * (1 - threshold) + 1e-9).cast("int")  # noqa: E731  of the longest word that can be this near
    term_length = F.char_length("term")
    # As columns, not as an array that is built for each term: Spark generates code for these alone.
    most_of = F.least(edits(F.col("length")), F.col("length") - 1)
    terms = vocabulary.select("term", term_length.alias("length")).filter("length > 0").select("term", "length", most_of.alias("most"))
    cut = terms.select("term", "length", "most", F.explode(F.sequence(F.lit(0), F.col("most"))).alias("nth")).select("term", "length", "nth", *(F.expr(f"CAST((nth + {k}) * length div (most + 1) AS int) AS {at}") for k, at in enumerate(("begin", "end"))))
    pieces = cut.select("term", "length", "nth", F.substr("term", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("piece"))
    own = F.char_length("needle")
    lengths = F.sequence(F.greatest(F.ceil(own * threshold - 1e-9).cast("int"), F.lit(1)), F.floor(own / threshold + 1e-9).cast("int"))
    wanted = needles.filter(own > 0).select("needle", F.explode(lengths).alias("length"))
    most = F.least(edits(F.col("length")), F.col("length") - 1)
    wanted = wanted.select("needle", "length", F.explode(_segments(F.col("needle"), F.col("length"), most)).alias("s"), most.alias("most"))
    begins = F.sequence(F.greatest(F.col("s.begin") - F.col("most"), F.lit(0)), F.col("s.begin") + F.col("most"))
    wanted = wanted.select("needle", "length", F.col("s.nth").alias("nth"), F.explode(F.transform(begins, lambda b: F.substring("needle", b + 1, F.col("s.size")))).alias("piece")).distinct()
    wanted = written(wanted, "spell-pieces")
    return pieces.join(_near(wanted, wanted.count()), ["length", "nth", "piece"]).select("needle", "term").distinct()


def spell_correct(words: DataFrame, vocabulary: DataFrame, threshold: float = SPELL_THRESHOLD) -> DataFrame:
    """word, stem, term, sim: for each (word, stem) the vocabulary term most similar to either, from the threshold on; ties to the smaller term."""
    pairs = words.select("word", "stem").distinct()
    needles = pairs.select(F.explode(F.array("word", "stem")).alias("needle")).distinct()
    near = spell_candidates(needles, vocabulary, threshold)
    either = pairs.select("word", "stem", F.explode(F.array_distinct(F.array("word", "stem"))).alias("needle")).join(near, "needle")
    sim = F.greatest(similarity(F.col("word"), F.col("term")), similarity(F.col("stem"), F.col("term")))
    scored = either.select("word", "stem", "term").distinct().withColumn("sim", sim).filter(F.col("sim") >= threshold)
    best = F.min(F.struct((-F.col("sim")).alias("order"), "term", "sim")).alias("best")
    return scored.groupBy("word", "stem").agg(best).select("word", "stem", "best.term", "best.sim")


def _rarest_first(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """token, n_token, own_trigram, place, known: each token's trigrams that any term has, those of fewest terms first, and all of these.

    Places begin behind the token's trigrams that no term has.
    """
    sets = asked.select("token", F.array_distinct(X.char_trigrams(F.col("token"))).alias("set"))
    own = sets.select("token", F.size("set").alias("n_token"), F.explode("set").alias("trigram")).join(counts, "trigram")
    listed = own.groupBy("token", "n_token").agg(F.array_sort(F.collect_list(F.struct("often", "trigram"))).alias("sorted"))
    each = listed.select("token", "n_token", F.col("sorted.trigram").alias("known")).select("token", "n_token", "known", F.posexplode("known").alias("nth", "own_trigram"))
    return each.select("token", "n_token", "own_trigram", (F.col("n_token") - F.size("known") + F.col("nth")).alias("place"), "known")


def _scores(own: DataFrame, trigrams: DataFrame, threshold: float) -> DataFrame:
    """token, term, jaccard from the threshold on; a pair may come more than once."""
    share = threshold / (1 + threshold)
    common = F.ceil(share * (F.col("n_token") + F.col("n_trigrams")) - 1e-6) - F.col("n_repeats")
    near = F.col("place") <= F.col("n_token") - F.greatest(common, F.lit(1))
    # Terms of few repeats, which almost all are, are met by trigram, length and repeats together: only by lengths that can be similar
    # enough, and in places that are rare enough for them.
    least = F.ceil(threshold * F.col("n_token") - 1e-6).cast("int")
    most = F.floor((F.col("n_token") + (1 + threshold) * F.col("n_repeats")) / threshold + 1e-6).cast("int")
    kinds = own.withColumn("n_repeats", F.explode(F.sequence(F.lit(0), F.lit(FEW_REPEATS)))).withColumn("n_trigrams", F.explode(F.sequence(least, most)))
    kinds = written(kinds.filter(near).withColumnRenamed("own_trigram", "trigram"), "typo-kinds")
    few = trigrams.filter(F.col("n_repeats") <= FEW_REPEATS).join(_near(kinds, kinds.count()), ["trigram", "n_trigrams", "n_repeats"])
    many = trigrams.filter(F.col("n_repeats") > FEW_REPEATS).join(_near(own, own.count()), (F.col("trigram") == F.col("own_trigram")) & near)
    row = ["token", "term", "n_token", "n_trigrams", "again", "known"]
    met = few.select(row).unionByName(many.select(row)).select("*", F.explode(F.array(F.concat(F.lit("$"), F.col("term"), F.lit("$")))).alias("shown"))
    once = F.size(F.filter("known", lambda t: F.contains(F.col("shown"), t)))
    more = F.size(F.filter("again", lambda t: F.array_contains("known", t)))
    counted = met.select("token", "term", "n_token", "n_trigrams", F.explode(F.array(F.when(F.col("again").isNull(), once).otherwise(once + more))).alias("both"))
    jaccard = F.col("both") / (F.col("n_token") + F.col("n_trigrams") - F.col("both"))
    return counted.select("token", "term", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def _asked_for(own: DataFrame, trigrams: DataFrame) -> DataFrame:
    """The stored table, read only where it holds the trigrams of `own`, if these are few."""
    few = [r[0] for r in own.select("own_trigram").distinct().limit(FILTERED_TRIGRAMS + 1).collect()]
    return trigrams.filter(F.col("trigram").isin(few)) if len(few) <= FILTERED_TRIGRAMS else trigrams


def trigram_scores(asked: DataFrame, trigrams: DataFrame, counts: DataFrame, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """token, term, jaccard from the threshold on. asked: distinct tokens; trigrams: the vocabulary's, with how many terms each is in.

    The token's trigrams are a set, the term's a list: a trigram counts as often as the term has it, so the
    measure can exceed 1.

    A token of q trigrams and a term of m reach the threshold t only with t / (1 + t) * (q + m) in common. Less the
    term's repeats, so many of the token's trigrams are in the term; hence one of any q - that + 1 is. So a pair is
    looked at only if it meets in one of the token's rarest trigrams: few where the term is long. Those that no term has come before them all.
    """
    own = written(_rarest_first(asked, counts), "typo-trigrams")
    return _scores(own, _asked_for(own, trigrams), threshold).distinct()


def trigram_suggest(asked: DataFrame, trigrams: DataFrame, counts: DataFrame, threshold: float = TRIGRAM_THRESHOLD, limit: int = 5) -> DataFrame:
    """token, rank, term, jaccard: the `limit` best terms of each token; ties to the smaller term.

    The higher the threshold, the fewer of a token's trigrams have to be looked up, and these the rarest. So high ones are tried
    first: a token with `limit` terms at one of them is done, since all others are less similar; the rest goes on to the next.
    """
    order = Window.partitionBy("token").orderBy(F.desc("jaccard"), "term")
    own = written(_rarest_first(asked, counts), "typo-trigrams")
    stored, found = _asked_for(own, trigrams), []
    for level in [*(x for x in TRIGRAM_LEVELS if x > threshold), threshold]:
        if own.isEmpty():
            break
        scored = _scores(own, stored, level)
        scored = scored.groupBy("token", "term").agg(F.first("jaccard").alias("jaccard")) if limit > 1 else scored  # the first needs no telling apart
        best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
        best = written(best.withColumn("whole", F.count("*").over(Window.partitionBy("token")) >= limit), "typo-terms")
        if level > threshold:
            done = best.filter("whole")
            own = written(own.join(done.select("token").distinct(), "token", "left_anti"), "typo-trigrams")
            best = done
        found.append(best.select("token", "rank", "term", "jaccard"))
    empty = asked.select("token", F.lit(0).alias("rank"), F.col("token").alias("term"), F.lit(0.0).alias("jaccard")).limit(0)
    return reduce(DataFrame.unionByName, found) if found else empty


def trigram_best(asked: DataFrame, trigrams: DataFrame, counts: DataFrame, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
    """token, term, jaccard: the best term of each token that has one; ties to the smaller term."""
    return trigram_suggest(asked, trigrams, counts, threshold, 1).select("token", "term", "jaccard")


def correct_tokens(tokens: DataFrame, vocabulary: DataFrame, trigrams: DataFrame, counts: DataFrame) -> DataFrame:
    """tokens (with a column token) with term: the token if the vocabulary has it, else the nearest term by trigrams, else the token; corrected says which."""
    known = vocabulary.select(F.col("term").alias("known"))
    marked = tokens.join(known, F.col("token") == F.col("known"), "left")
    best = trigram_best(marked.filter("known IS NULL").select("token").distinct(), trigrams, counts).select("token", F.col("term").alias("better"))
    joined = marked.join(best, "token", "left")
    return joined.select(*tokens.columns, F.coalesce("known", "better", "token").alias("term"), (F.col("known").isNull() & F.col("better").isNotNull()).alias("corrected"))
