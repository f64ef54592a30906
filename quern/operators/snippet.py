"""Snippets: two sentences around the first match, matches marked, all else escaped."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.stem import stem_word
from quern.functions.text import ESCAPES

WORDS_BEFORE = 10
WORD = regex.compile(r"\p{Alphabetic}+")
ENDS = ".!?"
END = regex.compile(r"[.!?]")
MORE = "…"


def escape(text: str) -> str:
    for plain, escaped in ESCAPES:
        text = text.replace(plain, escaped)
    return text


def second_end(text: str, start: int) -> int:
    """Behind the second sentence end from start; else the end of the text."""
    ends = (m.end() for m in END.finditer(text, start))
    next(ends, None)
    return next(ends, len(text))


def sentence_start(text: str, match: int) -> int:
    """Behind the last sentence end before the match and the white space there; without one, a few words back."""
    last = max(text.rfind(c, 0, match) for c in ENDS)
    if last >= 0:
        return match - len(text[last + 1 : match].lstrip())
    before = [m.start() for m in WORD.finditer(text, 0, match)]
    return before[-WORDS_BEFORE] if len(before) > WORDS_BEFORE else 0


def snippet(body: str | None, stems: list[str] | None) -> str:
    """Without stems, the first two sentences; with stems that the body lacks, from its start."""
    if not body:
        return ""
    wanted = set(stems) if stems is not None else set()
    if not wanted:
        return escape(body[: second_end(body, 0)])
    match = next((m.start() for m in WORD.finditer(body) if stem_word(m.group()) in wanted), 0)
    start = sentence_start(body, match)
    end = second_end(body, start)
    out, last = [], start
    for m in WORD.finditer(body[:end], start):
        out.append(escape(body[last : m.start()]))
        out.append(f"<mark>{escape(m.group())}</mark>" if stem_word(m.group()) in wanted else escape(m.group()))
        last = m.end()
    return "".join(out) + escape(body[last:end]) + (MORE if end < len(body) else "")


def snippet_column(body: Column, stems: Column) -> Column:
    """For the few rows of a result, after ranking."""

    @F.pandas_udf("string")
    def make(bodies: pd.Series, stems: pd.Series) -> pd.Series:
        return pd.Series([snippet(b, list(s) if s is not None else None) for b, s in zip(bodies, stems, strict=True)])

    return make(body, stems)
