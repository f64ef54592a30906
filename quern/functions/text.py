"""Text expressions: splitting, keeping, n-grams, character trigrams, escaping. Each takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters are what Unicode calls alphabetic; the joiner holds the parts of a phrase term together.
NOT_LETTER = r"[^\p{IsAlphabetic}]"
NOT_LETTER_OR_JOINER = r"[^\p{IsAlphabetic}~]"
LETTERS = r"\p{IsAlphabetic}+"
JOINER = "~"
LEAST_BYTES = 2
#: The characters that are escaped, in this order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def fragments(text: Column) -> Column:
    """What stands between characters that are no letters, empty fragments included."""
    return F.split(F.coalesce(text, F.lit("")), NOT_LETTER, -1)


def long_enough(word: Column) -> Column:
    """Bytes count, not characters, and they count before lower-casing."""
    return F.octet_length(word) >= LEAST_BYTES


def words(text: Column) -> Column:
    """Lower-cased words of two bytes or more."""
    return F.transform(F.filter(fragments(text), long_enough), F.lower)


def query_words(text: Column) -> Column:
    """Lower-cased words of any length: what a query is cut into."""
    return F.transform(F.filter(fragments(text), lambda x: x != ""), F.lower)


def raw_lexemes(text: str) -> str:
    """SQL for runs of letters and joiners that are worth retrieving, not yet stemmed, of a text given as SQL."""
    runs = f"split(coalesce({text}, ''), r'{NOT_LETTER_OR_JOINER}')"
    return f"filter({runs}, x -> x <> '' AND (contains(x, '{JOINER}') OR octet_length(x) >= {LEAST_BYTES}))"


def ngrams(stems: Column, n: int) -> Column:
    """Runs of n neighbouring elements, joined; empty if there are too few."""
    starts = F.when(F.size(stems) >= n, F.sequence(F.lit(1), F.size(stems) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(stems, i, n), JOINER))


def char_trigrams(term: Column) -> Column:
    """Three neighbouring characters of the padded term, repeats kept; one character gives one, none gives none."""
    padded = F.concat(F.lit("$"), term, F.lit("$"))
    starts = F.when(F.char_length(padded) >= 3, F.sequence(F.lit(1), F.char_length(padded) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))


def html_escape(text: Column) -> Column:
    """Apostrophes stay as they are."""
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def collapse(text: Column) -> Column:
    """Trimmed, with each run of Unicode white space as one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def lead_sentences(text: Column) -> Column:
    """Up to the second full stop, exclamation or question mark; else all."""
    two = F.regexp_extract(text, r"^(?s)(?:[^.!?]*[.!?]){2}", 0)
    return F.when(two == "", text).otherwise(two)
