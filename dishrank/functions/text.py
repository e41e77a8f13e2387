"""Sentences, words, lemmas, clipping and snippets as column expressions.

Everything here works on one row's text, so it needs no shuffle and no
Python worker, and a text of any length is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a sentence ends. White space after . ! ? (or after one of
# these and a quote) separates, together with stray . ! ? and space that follow;
# so does the place between . ! ? and a line separator. A quote right after such
# stray marks (\G is where the last break ended) closes nothing. The white space
# is tried before the look-behinds, which makes the scan about twice as fast.
SENTENCE_BREAK = (
    r"""\s(?<=[.!?]['"]?\s)(?<!\G['"]\s)[.!?\s]*"""
    r"""|(?<=[.!?])(?=[\u0085\u2028\u2029])"""
)
SENTENCE_LEAD = ".!? \t\n\x0b\f\r"
NON_PRINTABLE = r"\p{C}"
WORD_BREAK = r"[^\p{L}]+"

# A longer sentence is cut to CLIP_LENGTH from CLIP_BEFORE before the term.
CLIP_LENGTH = 300
CLIP_BEFORE = 150

SNIPPET_LIST = 23
SNIPPET_SEARCH = 18


def sentences_of(text: Column) -> Column:
    """Array of sentences, control characters removed."""
    pieces = F.split(F.ltrim(text, F.lit(SENTENCE_LEAD)), SENTENCE_BREAK)
    kept = F.filter(pieces, lambda s: s != "")
    return F.transform(kept, lambda s: F.regexp_replace(s, NON_PRINTABLE, ""))


def words_of(sentence: Column) -> Column:
    """Array of lower-case words."""
    return F.filter(F.split(F.lower(sentence), WORD_BREAK), lambda w: w != "")


def singular(word: Column) -> Column:
    """Lemma of a word by the plural rules alone: -ies, -es after s x z ch sh, -s."""
    length = F.length(word)

    def cut(n: int) -> Column:
        return F.substr(word, F.lit(1), length - n)

    return (
        F.when(length <= 3, word)
        .when((length > 4) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(word.rlike("[^sui]s$"), cut(1))
        .otherwise(word)
    )


def plurals(word: Column) -> Column:
    """Regular plurals of a word, of more than three letters."""
    forms = F.array(
        F.when(~word.endswith("s"), F.concat(word, F.lit("s"))),
        F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))),
        F.when(word.rlike("[^aeiou]y$"), F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies"))),
    )
    return F.filter(forms, lambda f: f.isNotNull() & (F.length(f) > 3))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text as a key, so that the text itself need not move."""
    return F.unhex(F.md5(text.cast("binary")))


def _index(text: Column, term: Column) -> Column:
    """Zero-based place of ``term``, -1 if absent."""
    return F.position(term, text) - 1


def clip_sentence(sentence: Column, term: Column) -> Column:
    """Sentence of at most 300 characters around the first place of ``term``."""
    length = F.length(sentence)
    start = F.greatest(_index(sentence, term) - CLIP_BEFORE, F.lit(0))
    end = F.least(start + CLIP_LENGTH, length - 1)
    return F.when(length > CLIP_LENGTH, F.substr(sentence, start + 1, end - start)).otherwise(sentence)


def snippet(text: Column, term: Column, half: int) -> Column:
    """Quoted part of ``text``, ``half`` characters to each side of ``term``."""
    length = F.length(text)
    long = length > 2 * half
    at = _index(text, term)
    start = F.when(long, F.greatest(at - half, F.lit(0))).otherwise(F.lit(0))
    end = F.when(long, F.least(at + half, length)).otherwise(length)

    def between(a: Column, b: Column) -> Column:
        a, b = (F.least(F.greatest(x, F.lit(0)), length) for x in (a, b))
        low, high = F.least(a, b), F.greatest(a, b)
        return F.substr(text, low + 1, high - low)

    tail = F.when(long & (end != length), F.lit("...")).otherwise(F.lit(""))
    return F.concat(
        F.lit('"'), between(start, at), term, between(at + F.length(term), end), tail, F.lit('"')
    )
