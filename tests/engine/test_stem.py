import pytest

from quern.functions.stem import lexeme_stems, stem, stem_word, with_stem

#: Traced by hand through the rules.
STEMS = {
    "caresses": "caress", "ponies": "poni", "troubles": "troubl", "hopping": "hop", "tanned": "tan", "running": "run", "electricity": "electr",
    "motional": "mot", "generalization": "gener", "gener": "gen", "feed": "fe", "speed": "spe", "water": "wat", "the": "th", "was": "wa", "cement": "cem",
    "tree": "tre", "a": "a", "is": "is", "été": "été", "Machine": "machin", "learning": "learn", "sky": "sky", "happy": "happi", "ies": "i", "sses": "ss", "ing": "ing", "ed": "ed",
    "falling": "fal", "buzzing": "buzz", "controll": "control", "version": "vers", "evaluate": "evalu", "yy": "yy", "ayyed": "ai",
}


@pytest.mark.parametrize(("word", "want"), STEMS.items())
def test_traced_words(word, want):
    assert stem_word(word) == want


def test_columns_agree_with_python(spark):
    import random

    rng = random.Random(4)
    ends = ["ational", "ization", "eed", "ed", "ing", "ies", "sses", "y", "ion", "tion", "ement", "ll", "e", "ousness", "iviti", "ss", "s", "izer", ""]
    words = set(STEMS) | {"".join(rng.choice("aeiouyvbcstlzÉß") for _ in range(rng.randint(0, 6))) + rng.choice(ends) for _ in range(1500)}
    words = sorted(w for w in words if w)
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    for row in with_stem(frame, "word").collect():
        assert row.stem == stem_word(row.word), row.word
    for row in frame.select("word", stem("word").alias("stem")).collect():
        assert row.stem == stem_word(row.word), row.word


def test_phrase_terms_are_stemmed_by_part(spark):
    frame = spark.createDataFrame([("machine~learning",), ("~~",), ("cats",)], "x string")
    assert [r[0] for r in frame.select(lexeme_stems("array(x)")).collect()] == [["machin~learn"], [], ["cat"]]


def test_suffixes_that_a_word_lacks_are_looked_for_a_table_at_a_time():
    import sys

    calls = []
    sys.setprofile(lambda _, event, what: calls.append(what.__name__) if event == "c_call" else None)
    try:
        assert stem_word.__wrapped__("quorvodup") == "quorvodup"
    finally:
        sys.setprofile(None)
    assert calls.count("endswith") < 16
