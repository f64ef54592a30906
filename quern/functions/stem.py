"""The stemmer: suffix rules over a consonant and vowel pattern, as columns and in plain Python from one rule table.

A word's measure is its number of maximal runs of consonants. Vowels are aeiou, and y unless it stands first or
behind one of aeiou; so a letter's kind depends on what precedes it alone, and the pattern of a word holds for all its beginnings.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import JOINER

#: Suffix and replacement, in the order in which they are tried, and the least measure before the suffix.
DERIVED = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
ADJECTIVAL = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
FINAL = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
RULES = (("derived", DERIVED, 1), ("adjectival", ADJECTIVAL, 1), ("final", tuple((s, "") for s in FINAL), 2))

#: In a pattern consonants are c and vowels 0; a 0 stands before them all, so that each 0c is where a run of consonants begins.
CONSONANT_Y, VOWELS, CONSONANTS = r"^y|(?<=[aeiou])y", "aeiouy", "bcdfghjklmnpqrstvwxzY"


# The steps are SQL text over the names of a word and of its pattern, which Spark parses at once; built call by call
# as columns they would take seconds to make.


def _pattern(word: str) -> str:
    marked = f"CASE WHEN contains({word}, 'y') THEN regexp_replace({word}, '{CONSONANT_Y}', 'Y') ELSE {word} END"
    kinds = f"translate({marked}, '{VOWELS}{CONSONANTS}', '{'0' * len(VOWELS)}{'c' * len(CONSONANTS)}')"
    return f"concat('0', CASE WHEN octet_length({word}) = char_length({word}) THEN {kinds} ELSE regexp_replace({kinds}, '[^0]', 'c') END)"


def _pattern_after(now: str, was: str, pattern: str) -> str:
    """The pattern of a word that was another one, whose pattern is given: that of a beginning is a beginning of it."""
    return f"CASE WHEN {now} = {was} THEN {pattern} WHEN startswith({was}, {now}) THEN left({pattern}, 1 + char_length({now})) ELSE {_pattern(now)} END"


def _before(word: str, suffix: int) -> str:
    return f"left({word}, char_length({word}) - {suffix})"


def _measure(pattern: str, suffix: int) -> str:
    own = _before(pattern, suffix)
    return f"(char_length({own}) - char_length(replace({own}, '0c', 'c')))"


def _has_vowel(pattern: str, suffix: int) -> str:
    return f"contains(substr({pattern}, 2, char_length({pattern}) - {suffix + 1}), '0')"


def _ends(word: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"endswith({word}, '{s}')" for s in suffixes) + ")"


def _first_rule(word: str, pattern: str, rules: tuple, least: int, rest: str) -> str:
    """The first rule that fits, measure included, else `rest`; a rule that fails its measure is passed over."""
    whens = (f"WHEN {_ends(word, s)} AND {_measure(pattern, len(s))} >= {least} THEN concat({_before(word, len(s))}, '{put}')" for s, put in rules)
    return f"CASE {' '.join(whens)} ELSE {rest} END"


def _plural(w: str, _: str, rest: str) -> str:
    return f"CASE WHEN {_ends(w, 'sses', 'ies')} THEN {_before(w, 2)} WHEN {_ends(w, 's')} AND NOT {_ends(w, 'ss')} THEN {_before(w, 1)} ELSE {rest} END"


def _past(w: str, p: str, rest: str) -> str:
    """Ends in a mark (a space, which no word has) where the verb ending went and the rest has to be mended."""
    cut = lambda n: f"CASE WHEN {_has_vowel(p, n)} THEN concat({_before(w, n)}, ' ') ELSE {rest} END"
    eed = f"CASE WHEN {_measure(p, 3)} > 0 THEN {_before(w, 1)} ELSE {rest} END"
    return f"CASE WHEN {_ends(w, 'eed')} THEN {eed} WHEN {_ends(w, 'ed')} THEN {cut(2)} WHEN {_ends(w, 'ing')} THEN {cut(3)} ELSE {rest} END"


def _mend(w: str, _: str, rest: str) -> str:
    bare = f"rtrim({w})"
    doubled = r"r'([^aeioulsz])\1$'"
    return f"CASE WHEN NOT endswith({w}, ' ') THEN {rest} WHEN {bare} RLIKE '(at|bl|iz)$' THEN concat({bare}, 'e') WHEN {bare} RLIKE {doubled} THEN {_before(bare, 1)} ELSE {bare} END"


def _final_y(w: str, p: str, rest: str) -> str:
    return f"CASE WHEN {_ends(w, 'y')} AND {_has_vowel(p, 1)} THEN concat({_before(w, 1)}, 'i') ELSE {rest} END"


def _final_ion(w: str, p: str, rest: str) -> str:
    return f"CASE WHEN {_ends(w, 'sion', 'tion')} AND {_measure(p, 3)} > 1 THEN {_before(w, 3)} ELSE {rest} END"


def _final_e(w: str, p: str, rest: str) -> str:
    # What ends consonant, vowel, consonant has two runs of consonants, so one run is always enough.
    return f"CASE WHEN {_ends(w, 'e')} AND {_measure(p, 1)} >= 1 THEN {_before(w, 1)} ELSE {rest} END"


def _final_l(w: str, p: str, rest: str) -> str:
    return f"CASE WHEN {_ends(w, 'll')} AND {_measure(p, 0)} > 1 THEN {_before(w, 1)} ELSE {rest} END"


def _table(number: int, at_a_time: int = 5) -> list:
    """A table's rules, a few at a time: methods of much more code than these make aren't compiled by the JVM, but interpreted."""
    _, rules, least = RULES[number]
    return [lambda w, p, rest, own=rules[n : n + at_a_time]: _first_rule(w, p, own, least, rest) for n in range(0, len(rules), at_a_time)]


#: Each step, as parts of which the first that fits changes the word, and whether it looks at the pattern.
STEPS = (([_plural], False), ([_past], True), ([_mend], False), ([_final_y], True), (_table(0), True), (_table(1), True), ([_final_ion, *_table(2)], True), ([_final_e], True), ([_final_l], True))


def with_stem(df: DataFrame, word: str, stem: str = "stem") -> DataFrame:
    """df with the stem of a column of single words: all within one stage of generated code.

    Words of one or two characters are only lower-cased. What each part of a step makes of a word comes out of a generator of
    one element. Spark writes a method of its own for what follows a generator, and no later filter is pushed through one:
    pushed down, it would hold every step's expression many times over.
    """
    at, was, pattern, short = "stem_at", "stem_was", "stem_pattern", "stem_short"
    others = [f"`{c}`" for c in df.columns if c != stem]
    df = df.withColumn(at, F.lower(word)).selectExpr(*others, at, f"{at} AS {was}", f"char_length({at}) <= 2 AS {short}", f"CAST(NULL AS string) AS {pattern}")
    for parts, needs_pattern in STEPS:
        if needs_pattern:
            now = f"CASE WHEN {short} THEN '' WHEN {pattern} IS NULL THEN {_pattern(at)} ELSE {_pattern_after(at, was, pattern)} END"
            df = df.selectExpr(*others, at, f"{at} AS {was}", short, f"{now} AS {pattern}")
        for n, part in enumerate(parts):
            done = f"{short} OR {at} <> {was}" if n else short
            df = df.selectExpr(*others, was, short, pattern, f"explode(array(CASE WHEN {done} THEN {at} ELSE {part(at, pattern, at)} END)) AS {at}")
    return df.selectExpr(*others, f"{at} AS {stem}")


@cache
def _stem_sql(word: str) -> str:
    """The stem as one expression; what a step needs more than once is bound by a lambda over an array of one."""
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def run(number: int, at: str) -> str:
        if number == len(STEPS):
            return at
        parts, needs_pattern = STEPS[number]
        step = reduce(lambda rest, part: part(at, f"p{number}", rest), reversed(parts), at)
        done = let(_pattern(at), f"p{number}", step) if needs_pattern else step
        return let(done, f"w{number}", run(number + 1, f"w{number}"))

    return let(f"lower({word})", "w", f"CASE WHEN char_length(w) <= 2 THEN w ELSE {run(0, 'w')} END")


def stem(word: str) -> Column:
    """The stem of a column of single words, as one expression. Interpreted; see with_stem() for many words."""
    return F.expr(_stem_sql(word))


def lexeme_stems(lexemes: str) -> Column:
    """The stems of an array column of lexemes (given as SQL); of a phrase term, the stems of its parts, joined."""
    parts = f"filter(split(l, '{JOINER}'), x -> x <> '')"
    joined = f"array_join(transform({parts}, x -> {_stem_sql('x')}), '{JOINER}')"
    return F.expr(f"filter(transform({lexemes}, l -> CASE WHEN contains(l, '{JOINER}') THEN {joined} ELSE {_stem_sql('l')} END), x -> x <> '')")


_AS_CONSONANT, _NOT_VOWEL, _KINDS = re.compile(CONSONANT_Y).sub, re.compile("[^0]").sub, str.maketrans(VOWELS, "0" * len(VOWELS))
_SUFFIXES = [tuple(suffix for suffix, _ in rules) for _, rules, _ in RULES]


@lru_cache(maxsize=1 << 16)
def stem_word(word: str) -> str:
    """The same in plain Python, for code that walks through a text."""
    w = word.lower()
    if len(w) <= 2:
        return w

    def kinds(x: str) -> str:
        y = _AS_CONSONANT("Y", x) if "y" in x else x
        return _NOT_VOWEL("c", y.translate(_KINDS))

    def measure(x: str, suffix: int) -> int:
        return ("0" + kinds(x)[: len(x) - suffix]).count("0c")

    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if measure(w, 3) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                rest = w[: -len(end)]
                if "0" in kinds(w)[: len(rest)]:
                    w = rest + "e" if re.search("(at|bl|iz)$", rest) else re.sub(r"([^aeioulsz])\1$", r"\1", rest)
                break
    if w.endswith("y") and "0" in kinds(w)[:-1]:
        w = w[:-1] + "i"
    for (name, rules, least), suffixes in zip(RULES, _SUFFIXES):
        if name == "final" and w.endswith(("sion", "tion")) and measure(w, 3) > 1:
            w = w[:-3]
            continue
        if not w.endswith(suffixes):
            continue
        for suffix, put in rules:
            if w.endswith(suffix) and measure(w, len(suffix)) >= least:
                w = w[: len(w) - len(suffix)] + put
                break
    if w.endswith("e") and measure(w, 1) >= 1:
        w = w[:-1]
    if w.endswith("ll") and measure(w, 0) > 1:
        w = w[:-1]
    return w


def stem_lexeme(lexeme: str) -> str:
    """Of a phrase term, the stems of its parts, joined."""
    return JOINER.join(stem_word(p) for p in lexeme.split(JOINER) if p) if JOINER in lexeme else stem_word(lexeme)


def query_stems(words: Column, drop_empty: bool = False) -> Column:
    """Stems of the words or lexemes of queries, whose tables are small.

    An Arrow batch of a few rows costs less here than planning the steps' expressions over and over: a search
    stems three times, and each plan that follows would carry them.
    """

    @F.pandas_udf("array<string>")
    def each(rows: pd.Series) -> pd.Series:
        found = ([stem_lexeme(w) for w in row] if row is not None else [] for row in rows)
        return pd.Series([[s for s in row if s or not drop_empty] for row in found])

    return each(words)
