import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.language_id import ORDER, SYMBOLS, Model, code_lengths, identify, identify_languages, model_from, plain, train, windows


def slow_probability(history, counts, order):
    """Of all symbols after `history`, straight from the definition."""
    if order < 0:
        return [1 / SYMBOLS] * SYMBOLS
    context = history[len(history) - order :]
    seen = [0.0] * SYMBOLS
    for window, n in counts.items():
        if window[ORDER - order : ORDER] == tuple(context):
            seen[window[ORDER]] += n
    lower = slow_probability(history, counts, order - 1)
    total, kinds = sum(seen), sum(x > 0 for x in seen)
    if not total:
        return lower
    rest = sum(p for p, x in zip(lower, seen) if not x)
    if not rest:
        return [x / total for x in seen]
    return [x / (total + kinds) if x else kinds / (total + kinds) * p / rest for p, x in zip(lower, seen)]


def test_code_lengths_match_definition_and_add_up():
    rng = random.Random(1)
    counts = {}
    for _ in range(300):
        window = tuple(rng.randrange(5) for _ in range(ORDER + 1))
        counts[window] = counts.get(window, 0) + 1
    pack = lambda w: sum(s * SYMBOLS ** (ORDER - k) for k, s in enumerate(w))
    bits = code_lengths(np.array([pack(w) for w in counts]), np.array(list(counts.values()), float)).reshape(-1, SYMBOLS)
    assert np.allclose(np.exp2(-bits.astype(float)).sum(1), 1, atol=1e-4)
    for _ in range(40):
        history = [rng.randrange(6) for _ in range(ORDER)]
        want = slow_probability(history, counts, ORDER)
        got = bits[sum(s * SYMBOLS ** (ORDER - 1 - k) for k, s in enumerate(history))]
        assert np.allclose(got, [-math.log2(p) for p in want], rtol=1e-4)


def test_windows_hold_the_bytes_before():
    data = plain("Aé!")
    assert data == b"   a\xc3\xa9 "
    assert windows(data).tolist() == [int.from_bytes(data[i : i + 4], "big") for i in range(4)]


def small_model():
    texts = {"aa": "abab abab abab", "bb": "cdcd cdcd cdcd"}
    counted = [np.unique(windows(plain(t)), return_counts=True) for t in texts.values()]
    return model_from(list(texts), [(c, n.astype(float)) for c, n in counted])


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "12 !? \n"), (4, "abab"), (5, "CDCD " * 200_000), (None, "abab"), (4, "abab")]
    docs = spark.createDataFrame([(i, t, "zz", 1.0) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred) for r in identify(docs, small_model()).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "aa"), (5, "bb"), (None, "aa")}
    assert identify(docs, Model([], np.zeros(256, np.uint8), [], [])).filter("lang_pred = 'und' AND score = 0").count() == 7
    empty = docs.limit(0)
    assert identify_languages(empty).count() == 0
    assert train(docs.withColumn("lang", F.lit(None).cast("string"))).languages == []


@pytest.fixture(scope="module")
def fixture_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"], identify_languages(docs).toPandas()


def test_held_out_accuracy(fixture_table):
    truth, got = fixture_table
    own = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert len(own) > 250
    assert (own["lang_pred"] == own["doc_id"].map(truth)).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_each_byte_has_a_code_length_of_its_own():
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñ" * 40
    texts = {"latin": letters, "greek": "αβγδεζηθικλμνξοπρστυφχψω" * 20, "ru": "это было бы хорошо " * 9, "uk": "це було б добре її " * 9, "ja": "これは日本語の文章です" * 9, "zh": "这是一个中文的句子" * 9}
    counted = [np.unique(windows(plain(t)), return_counts=True) for t in texts.values()]
    model = model_from(list(texts), [(c, n.astype(float)) for c, n in counted])
    for contexts in model.contexts:
        for history in (b"abc", b"\xd1\x8b\xd0", b"\x00\xff\xfe", b"\xe3\x81\xae"):
            ways = int.from_bytes(history, "big") * 256 + np.arange(256)
            assert np.exp2(-contexts.bits(ways)).sum() == pytest.approx(1, abs=1e-9)
    first = int.from_bytes("бы".encode()[:3], "big") * 256
    assert len(set(model.contexts[2].bits(first + np.array([0x8B, 0xB8, 0x00])).round(6))) > 1
    found = model.predict([*texts.values(), "її", "ы", "の", None])
    assert [f[0] for f in found] == [*texts, "uk", "ru", "ja", "und"]


def test_every_language_is_learned(spark):
    words = ["".join(chr(0x4E00 + 40 * k + j) for j in range(6)) for k in range(70)]
    rows = [(i, words[i % 70], f"l{i % 70:02}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs)
    assert model.languages == sorted({r[2] for r in rows})
    assert [f[0] for f in model.predict(words)] == model.languages
    with pytest.raises(ValueError, match="languages"):
        train(docs, most_languages=69)
