
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dishrank import functions as fn


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("tier, expected", [
    (fn.confidence_weight, {
        0: 0.55, 9: 0.55, 10: 0.60, 24: 0.60, 25: 0.65, 49: 0.65, 50: 0.70, 74: 0.70, 75: 0.75, 99: 0.75,
        100: 0.80, 124: 0.80, 125: 0.85, 149: 0.85, 150: 0.90, 174: 0.90, 175: 0.95, 499: 0.95, 500: 1.0, 9999: 1.0,
    }),
    (fn.trending_weight, {
        0: 0.4, 1: 0.4, 2: 0.4, 4: 0.4, 5: 0.5, 6: 0.6, 7: 0.7, 8: 0.8, 9: 0.9, 10: 1.0, 11: 1.0,
    }),
])
def test_weight_tiers(spark, tier, expected):
    got = values(spark, tier(F.col("n")), [(n,) for n in expected], "n long")
    assert got == list(expected.values())


def test_single_rating_does_not_trend(spark):
    got = values(spark, fn.trending_score(F.col("n"), F.col("t")), [(1, 5), (2, 10), (12, 40)], "n long, t long")
    assert got == [0.0, 4.0, 40.0]


def test_rating_has_one_decimal_half_up(spark):
    got = values(spark, fn.format_rating(F.col("x")), [(5.0,), (4.25,), (3.65,), (4.0,), (3.949,)], "x double")
    assert got == ["5.0", "4.3", "3.7", "4.0", "3.9"]


def test_round_at(spark):
    assert values(spark, fn.round_at(F.col("x"), 2), [(3.14159,), (2.5,), (1.125,)], "x double") == [3.14, 2.5, 1.13]


def test_city_key_is_the_same_for_storing_and_looking_up(spark):
    data = [("Las Vegas", "NV"), ("Munhall", "PA")]
    stored = values(spark, fn.citystate_key(F.col("c"), F.col("s")), data, "c string, s string")
    asked = values(spark, fn.normalise_city(F.col("c")), [("Las Vegas, NV",), ("MunhallPA",)], "c string")
    assert stored == asked == ["LasVegasNV", "MunhallPA"]
    assert values(spark, fn.city_label(F.col("c")), [(c,) for c in stored], "c string") == ["LasVegas, NV", "Munhall, PA"]


def test_address_drops_only_the_literal_escape(spark):
    got = values(spark, fn.clean_address(F.col("a")), [("1 Main St\\nCity",), ("1 Main St\nCity",)], "a string")
    assert got == ["1 Main St City", "1 Main St\nCity"]


SENTENCES = {
    'Hi . . "Ok." yes?! .5 stars... wow."x" a.b c!" d': ["Hi .", '"Ok."', "yes?!", "5 stars...", 'wow."x" a.b c!"', "d"],
    "  . ! ?": [],
    "": [],
    "no end": ["no end"],
    "one\ntwo. three": ["onetwo.", "three"],
    "He said 'go.' Then left.": ["He said 'go.'", "Then left."],
    "tab\there.\r\nnext": ["tabhere.", "next"],
    "a.\u2028b": ["a.", "\u2028b"],
    'a. ." b. c': ["a.", '" b.', "c"],
    "a? ?' ": ["a?", "' "],
    "x ?' y": ["x ?'", "y"],
}


def test_sentences(spark):
    got = values(spark, fn.sentences_of(F.col("t")), [(t,) for t in SENTENCES], "t string")
    assert got == list(SENTENCES.values())


def scanned(text):
    """Sentences by walking over the characters: a break is an end mark, maybe a quote, then space."""
    out, current, at = [], "", 0
    while at < len(text):
        if not current and text[at] in ".!? \n":
            at += 1
            continue
        current += text[at]
        at += 1
        ended = current[-1] in ".!?" or (len(current) > 1 and current[-1] in "'\"" and current[-2] in ".!?")
        if ended and at < len(text) and text[at] in " \n":
            out, current = [*out, current], ""
    return [s.replace("\n", "") for s in ([*out, current] if current else out)]


def test_scanner_on_the_listed_sentences():
    plain = {t: s for t, s in SENTENCES.items() if not set(t) & set("\t\r\u2028")}
    assert [scanned(t) for t in plain] == list(plain.values())


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab.!?'\" \n", max_size=40), min_size=50, max_size=80))
def test_splitting_equals_matching(spark, texts):
    got = values(spark, fn.sentences_of(F.col("t")), [(t,) for t in texts], "t string")
    assert got == [scanned(t) for t in texts]


def test_many_inner_marks_do_not_overflow(spark):
    text = "a.b" * 200_000
    assert values(spark, F.size(fn.sentences_of(F.col("t"))), [(text,)], "t string") == [1]


def test_words(spark):
    words = fn.words_of(F.col("t"))
    got = values(spark, words, [("The Tacos, they're jalapeño-hot!",), ("",)], "t string")
    assert got == [["the", "tacos", "they", "re", "jalapeño", "hot"], []]


SINGULARS = {
    "tacos": "taco", "glass": "glass", "bus": "bus", "gas": "gas", "wings": "wing", "hummus": "hummus", "basis": "basis",
    "prawns": "prawn", "ribs": "rib", "sandwiches": "sandwich", "radishes": "radish", "boxes": "box", "glasses": "glass",
    "curries": "curry", "pastries": "pastry", "pies": "pie", "sauces": "sauce", "an": "an", "": "",
}


def test_singulars(spark):
    got = values(spark, fn.singular(F.col("w")), [(w,) for w in SINGULARS], "w string")
    assert dict(zip(SINGULARS, got)) == SINGULARS


def test_plurals(spark):
    plurals = {
        "taco": ["tacos"], "sandwich": ["sandwichs", "sandwiches"], "curry": ["currys", "curries"], "bay": ["bays"],
        "glass": ["glasses"], "cheese": ["cheeses"], "a": [],
    }
    got = values(spark, fn.plurals(F.col("w")), [(w,) for w in plurals], "w string")
    assert dict(zip(plurals, got)) == plurals


def test_bound_values_are_used_once(spark):
    twice = fn.bound(F.array("t"), lambda x: F.concat(x, x))
    assert values(spark, twice, [("a",)], "t string") == [["a", "a"]]


def clip(text, term):
    """The clipping rule written out on Python strings."""
    if len(text) <= 300:
        return text
    start = max(text.find(term) - 150, 0)
    return text[start:min(start + 300, len(text) - 1)]


@pytest.mark.parametrize("length", [10, 299, 300, 301, 449, 450, 451, 500, 2000])
def test_clip(spark, length):
    texts = ["x" * length]
    for place in (0, 1, 149, 150, 151, 200, length - 4):
        if 0 <= place <= length - 4:
            texts.append("x" * place + "taco" + "x" * (length - place - 4))
    got = values(spark, fn.clip_sentence(F.col("t"), F.lit("taco")), [(t,) for t in texts], "t string")
    assert got == [clip(t, "taco") for t in texts]


def snippet(text, term, half):
    """The snippet rule written out on Python strings."""
    size, at = len(text), text.find(term)
    start, end = (max(at - half, 0), min(at + half, size)) if size > 2 * half else (0, size)

    def between(a, b):
        a, b = sorted((min(max(a, 0), size), min(max(b, 0), size)))
        return text[a:b]

    tail = "..." if size > 2 * half and end != size else ""
    return '"' + between(start, at) + term + between(at + len(term), end) + tail + '"'


@pytest.mark.parametrize("half", [18, 23])
@pytest.mark.parametrize("term", ["taco", "absent", "a term of 21 letters."])
def test_snippet(spark, half, term):
    texts = ["y" * n for n in (0, 5, 36, 37, 46, 47, 80)]
    texts += [t[:k] + term + t[k:] for t in texts for k in (0, 10, 30, len(t))]
    got = values(spark, fn.snippet(F.col("t"), F.lit(term), half), [(t,) for t in texts], "t string")
    assert got == [snippet(t, term, half) for t in texts]
