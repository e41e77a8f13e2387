"""Finding dictionary items in review and tip texts.

One way for a dictionary of any size. Items of one word are turned into their surface
forms and joined to the words of the texts. Items of several words stand under their
rarest pair of neighbouring words; each word of a text meets them by the pair it begins,
once however long items are, and the item is verified against the words around. The
places of those that match go back to the text. Texts are known by a digest while that
happens: reviews need no key, and equal texts are no trouble.

The pattern table is written first, so its size is known: Spark broadcasts it while it
is small. With a large one of single words the texts are dealt to slices and looked up there
(``lookup``): what shuffles is the texts and the different words of each slice. Of a large one of
several words slices ask for their pairs (``pair_lookup``), and only places found are verified.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, clip_sentence, plurals, sentences_of, singular, text_key, words_of
from ..sources.stages import Stage, fresh
from .lookup import is_small, looked_up
from .pair_lookup import PairLookup, is_large, split_texts

# Words of a sentence that are taken apart together; longer sentences make several blocks.
BLOCK_WORDS = 64

# Letters that a word may end on and its regular plural may not, or the other way round.
PLURAL_LETTERS = "seiy"

POLICIES = ("last", "first_sentence", "all")


def sentence_rows(reviews: DataFrame) -> DataFrame:
    """One row per sentence, with its zero-based ``sentence_pos``."""
    kept = [c for c in reviews.columns if c != "text"]
    return reviews.select(*kept, F.posexplode(sentences_of(F.col("text"))).alias("sentence_pos", "sentence"))


def lemma_forms(lemma_table: DataFrame) -> DataFrame:
    """One ``lemma`` per ``form``: the smallest of those listed."""
    listed = lemma_table.where(F.col("form").isNotNull() & F.col("lemma").isNotNull())
    return listed.groupBy("form").agg(F.min("lemma").alias("lemma"))


def token_rows(sentences: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """One row per word of each sentence, with ``form`` and ``lemma``, without the sentence.

    The lemma table is small next to the tokens; Spark broadcasts it when its
    size allows and otherwise joins by shuffle, splitting frequent words.
    """
    kept = [c for c in sentences.columns if c != "sentence"]
    words = sentences.select(*kept, F.posexplode(words_of(F.col("sentence"))).alias("token_pos", "form"))
    table = lemma_forms(lemma_table).withColumnRenamed("lemma", "listed")
    return words.join(table, "form", "left").withColumn("lemma", F.coalesce("listed", singular(F.col("form")))).drop("listed")


def word_forms(words: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """Which dictionary word each ``form`` stands for, from ``words(word)``.

    A dictionary word stands for itself. Another form stands for its lemma if the lemma
    table lists it, else for a word it is a regular plural of; of several, the one that
    the plural rules give.
    """
    listed = lemma_forms(lemma_table)
    own = words.select(F.col("word").alias("form"), F.lit(0).alias("rank"), "word")
    irregular = listed.join(words, F.col("lemma") == F.col("word")).select("form", F.lit(1).alias("rank"), "word")
    regular = words.select(F.explode(plurals(F.col("word"))).alias("form"), "word").join(listed, "form", "left_anti")
    ruled = F.when(singular(F.col("form")) == F.col("word"), 2).otherwise(3)
    every = own.union(irregular).union(regular.select("form", ruled.alias("rank"), "word"))
    best = every.groupBy("form").agg(F.min(F.struct("rank", "word")).alias("best"))
    return best.select("form", F.col("best.word").alias("word"))


def dictionary_patterns(dictionary: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """``(pattern, dish)``: words that name an item of one word.

    Null items and items without a word are left out; a word of several items names the
    smallest one.
    """
    items = dictionary.where(F.col("item").isNotNull()).select("item").distinct()
    items = items.withColumn("words", words_of(F.col("item"))).where(F.size("words") == 1)
    named = items.groupBy(F.get("words", F.lit(0)).alias("word")).agg(F.min("item").alias("dish"))
    forms = word_forms(named.select("word"), lemma_table)
    return named.join(forms, "word").select(F.col("form").alias("pattern"), "dish")


def stem_key(word: Column) -> Column:
    """64 bits that a word has in common with all its regular plurals."""
    return F.xxhash64(F.rtrim(word, F.lit(PLURAL_LETTERS)))


def anchored(dictionary: DataFrame, lemma_table: DataFrame, max_ngram: int, stage: Stage = fresh) -> tuple[DataFrame, DataFrame]:
    """``(first, second, place, dish)``: items of two words or more under one pair of neighbours, and their words.

    The pair is the item's rarest one, which begins at ``place``: the one whose rarer word
    is in the fewest items. It is kept as the ``stem_key`` of both words. Forms are not
    multiplied out: regular plurals share the key, so an item is one row, and one more for
    every other form that the lemma table lists at the pair. Of items with the same words
    the smallest is named.
    """
    items = dictionary.where(F.col("item").isNotNull()).select("item")
    items = items.withColumn("words", words_of(F.col("item"))).where(F.size("words").between(2, max_ngram))
    uses = items.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    uses = stage(uses, "item_words")
    named = items.groupBy(F.array_join("words", " ").alias("phrase")).agg(F.min("item").alias("dish"))
    named = named.select("dish", F.split("phrase", " ").alias("words"))
    at = named.withColumn("place", F.lit(0))
    if max_ngram > 2:
        rows = named
        for k in range(max_ngram):
            own = uses.select(F.col("word").alias(f"word{k}"), F.col("uses").alias(f"uses{k}"))
            rows = rows.join(own, F.get("words", F.lit(k)) == F.col(f"word{k}"), "inner" if k < 2 else "left")
        rows = rows.withColumn("u", F.slice(F.array(*[f"uses{k}" for k in range(max_ngram)]), F.lit(1), F.size("words")))
        pairs = F.transform(F.slice("u", 2, max_ngram), lambda after, k: F.struct(F.least(after, F.get("u", k)).alias("uses"), k.alias("place")))
        at = rows.select("dish", "words", F.array_min(pairs)["place"].alias("place"))
    listed = lemma_forms(lemma_table).groupBy(F.col("lemma").alias("listed")).agg(F.collect_set(stem_key(F.col("form"))).alias("more"))
    for k, name in enumerate(("first", "second")):
        word = F.get("words", F.col("place") + k)
        every = F.array_union(F.array(stem_key(word)), F.coalesce("more", F.array().cast("array<bigint>")))
        at = at.join(listed, word == F.col("listed"), "left").withColumn(name, F.explode(every)).drop("listed", "more")
    return stage(at.select("first", "second", "place", "dish"), "anchors"), uses.select("word")


def with_slots(anchors: DataFrame, forms: DataFrame, max_ngram: int) -> DataFrame:
    """Anchors with ``slots``: for each place of the item the forms its word may have."""
    rows = anchors.withColumn("words", words_of(F.col("dish")))
    wanted = rows.select(F.explode("words").alias("word")).distinct()
    known = forms.join(wanted, "word", "left_semi").groupBy("word").agg(F.collect_set("form").alias("forms"))
    for k in range(max_ngram):
        own = known.select(F.col("word").alias(f"word{k}"), F.col("forms").alias(f"slot{k}"))
        rows = rows.join(own, F.get("words", F.lit(k)) == F.col(f"word{k}"), "inner" if k < 2 else "left")
    slots = F.slice(F.array(*[f"slot{k}" for k in range(max_ngram)]), F.lit(1), F.size("words"))
    return rows.select("first", "second", "place", "dish", slots.alias("slots"))


def _blocks(words: Column, reach: int) -> Column:
    """``(begin, core, words)``: a sentence's words in bounded blocks, with ``reach`` more to each side."""

    def cut(words: Column) -> Column:
        def block(core: Column) -> Column:
            begin = F.greatest(core - reach, F.lit(0))
            return F.struct(
                begin.alias("begin"), core.alias("core"),
                F.slice(words, begin + 1, core - begin + BLOCK_WORDS + reach).alias("words"),
            )

        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(BLOCK_WORDS)), block)

    return bound(words, cut)


def neighbours(sentences: DataFrame, reach: int) -> DataFrame:
    """``(text_key, sentence_pos, token_pos, word, around, left)``, one row per word of ``sentences``.

    ``around`` is the word with up to ``reach`` words to each side, the word itself at ``left``.
    """
    blocks = sentences.select("text_key", "sentence_pos", F.explode(_blocks(words_of(F.col("sentence")), reach)).alias("b"))
    each = blocks.select("text_key", "sentence_pos", "b.*").select("*", F.posexplode("words").alias("at", "word"))
    own = F.col("begin") + F.col("at")
    each = each.where((own >= F.col("core")) & (own < F.col("core") + BLOCK_WORDS))
    first = F.greatest(F.col("at") - reach, F.lit(0))
    return each.select(
        "text_key", "sentence_pos", own.alias("token_pos"), "word",
        F.slice("words", first + 1, F.col("at") - first + 1 + reach).alias("around"), (F.col("at") - first).alias("left"),
    )


def around(places: DataFrame, reach: int) -> DataFrame:
    """``(text_key, sentence_pos, token_pos, around, left)`` of the words at ``places`` of sentences, as ``neighbours`` has them."""

    def one(words: Column) -> Callable[[Column], Column]:
        def row(at: Column) -> Column:
            first = F.greatest(at - reach, F.lit(0))
            return F.struct(at.alias("token_pos"), F.slice(words, first + 1, at - first + 1 + reach).alias("around"), (at - first).alias("left"))

        return row

    each = bound(words_of(F.col("sentence")), lambda words: F.transform("places", one(words)))
    return places.select("text_key", "sentence_pos", F.explode(each).alias("p")).select("text_key", "sentence_pos", "p.*")


def _sentences(keyed: DataFrame) -> DataFrame:
    return keyed.select("text_key", F.posexplode(sentences_of(F.col("text"))).alias("sentence_pos", "sentence"))


def _passing() -> Callable[[pa.ListArray, pa.Array], pa.Array]:
    """What gives the values of each row's words as they are."""

    def values(lists: pa.ListArray, found: pa.Array) -> pa.Array:
        # Offsets from zero, whatever part of a longer array this is.
        return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), found)

    return values


def word_hits(keyed: DataFrame, patterns: DataFrame, policy: str = "", stage: Stage = fresh) -> DataFrame:
    """``(text_key, sentence_pos, token_pos, width, dish)`` of items of one word in the texts.

    Of a sentence's hits only what ``policy`` may take: each item once, or the last one. With
    patterns too many to broadcast the texts are looked up slice by slice.
    """
    words = words_of(F.col("sentence"))
    kept = ["text_key", "sentence_pos"]
    if is_small(patterns):
        tokens = _sentences(keyed).select(*kept, F.posexplode(words).alias("token_pos", "word"))
        met = tokens.join(patterns, F.col("word") == F.col("pattern"))
        return met.select(*kept, "token_pos", F.lit(1).alias("width"), "dish")
    table = patterns.select(F.col("pattern").alias("word"), F.col("dish").alias("value"))
    found = looked_up(_sentences(keyed), "sentence", words, table, "dishes", T.ArrayType(T.StringType()), _passing(), stage)
    if policy == "all":
        once = F.array_distinct(F.filter("dishes", lambda d: d.isNotNull()))
        return found.select(*kept, F.lit(0).alias("token_pos"), F.lit(1).alias("width"), F.explode(once).alias("dish"))
    places = F.transform("dishes", lambda d, at: F.when(d.isNotNull(), F.struct(at.alias("token_pos"), F.lit(1).alias("width"), d.alias("dish"))))
    hits = F.filter(places, lambda h: h.isNotNull())
    if policy:
        hits = F.slice(hits, F.greatest(F.size(hits), F.lit(1)), F.lit(1))
    return found.select(*kept, F.explode(hits).alias("h")).select(*kept, "h.*")


def verified(near: DataFrame, anchors: DataFrame) -> DataFrame:
    """``(text_key, sentence_pos, token_pos, width, dish)`` of items that ``near`` holds, by the pairs of words in it.

    Each word of ``near`` enters the join once, however long items are, by the keys of it and
    the word behind. Every word of an item anchored there must be among the forms at its place.
    That is exact, so 64 bits of a key are enough to meet by.
    """
    word, behind = F.get("around", F.col("left")), F.get("around", F.col("left") + 1)
    pairs = near.where(behind.isNotNull()).withColumns({"first": stem_key(word), "second": stem_key(behind)})
    met = pairs.join(anchors, ["first", "second"])
    begin = F.col("left") - F.col("place")
    # A place beyond the sentence has no word, which no form equals.
    fits = F.filter("slots", lambda forms, k: (begin + k >= 0) & F.array_contains(forms, F.get(F.col("around"), begin + k)))
    width = F.size("slots")
    return met.where(F.size(fits) == width).select(
        "text_key", "sentence_pos", (F.col("token_pos") - F.col("place")).alias("token_pos"), width.alias("width"), "dish"
    )


def sequence_hits(
    keyed: DataFrame, dictionary: DataFrame, lemma_table: DataFrame, max_ngram: int, policy: str = "all", stage: Stage = fresh
) -> DataFrame:
    """The same columns for items of two words or more.

    While their table is small, every word of a text meets it. A large one is asked slice by
    slice which pairs of the texts it has, and of a text only the words at those that
    ``policy`` may take are verified; a text in which none of them is an item has all of its
    pairs verified.
    """
    anchors, words = anchored(dictionary, lemma_table, max_ngram, stage)
    forms = stage(word_forms(words, lemma_table), "forms")
    reach = max_ngram - 1
    if not is_large(anchors):
        slots = stage(with_slots(anchors, forms, max_ngram), "slots")
        if not is_large(slots):
            return verified(neighbours(_sentences(keyed), reach), slots)
    lookup = PairLookup(split_texts(keyed, stage), anchors, stem_key, stage)

    def hits(policy: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        # What a Python function is told is not in a plan, so the name of the stage tells it.
        places = stage(lookup.places(policy, reach, only), f"places_{policy}_{reach}")
        near = around(places, reach)
        word, behind = F.get("around", F.col("left")), F.get("around", F.col("left") + 1)
        met = near.select(stem_key(word).alias("first"), stem_key(behind).alias("second")).distinct()
        needed = with_slots(anchors.join(met, ["first", "second"], "left_semi"), forms, max_ngram)
        return places, stage(verified(near, needed), "hits")

    places, found = hits(policy)
    if policy != "all":
        # No item at the places taken: there may be one at another.
        left = stage(places.select("text_key").distinct().join(found, "text_key", "left_anti"), "left")
        if not left.isEmpty():
            found = found.union(hits("all", left)[1])
    return found


def find_mentions(
    reviews: DataFrame, dictionary: DataFrame, lemma_table: DataFrame, policy: str = "last", max_ngram: int = 1,
    stage: Stage = fresh,
) -> DataFrame:
    """Mentions ``(..., sentence_pos, dish, promo_text)`` of dictionary items.

    ``promo_text`` is the item's sentence, a long one clipped around the item.

    ``policy``: ``last`` takes a review's last item, ``first_sentence`` the last
    item of its first sentence with one, ``all`` every item of every sentence
    (once per sentence). Of items that begin at one word the longest is the last.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    kept = [c for c in reviews.columns if c != "text"]
    if max_ngram > 1:
        # Read several times below.
        dictionary = stage(dictionary.select("item").distinct(), "items")
    patterns = stage(dictionary_patterns(dictionary, lemma_table), "patterns")
    keyed = reviews.withColumn("text_key", text_key(F.col("text")))
    # Hits are combined per task before the shuffle. Rows of one text give the same
    # hits, so neither the maximum nor the set depends on how many there are.
    hits = word_hits(keyed, patterns, policy, stage)
    if max_ngram > 1:
        longer = sequence_hits(keyed, dictionary, lemma_table, max_ngram, policy, stage)
        # Without items of one word the texts are not taken apart for them.
        hits = longer if patterns.isEmpty() else hits.union(longer)
    hits = hits.groupBy("text_key")
    if policy == "all":
        found = hits.agg(F.collect_set(F.struct("sentence_pos", "dish")).alias("found"))
    else:
        first = F.col("sentence_pos") if policy == "last" else -F.col("sentence_pos")
        best = F.max(F.struct(first.alias("first"), "token_pos", "width", "sentence_pos", "dish"))
        found = hits.agg(best.alias("m")).select("text_key", F.array(F.struct("m.sentence_pos", "m.dish")).alias("found"))
    # A text is split into its sentences once, however many of them are taken.
    taken = bound(sentences_of(F.col("text")), lambda sentences: F.transform("found", lambda m: F.struct(
        m["sentence_pos"].alias("sentence_pos"), m["dish"].alias("dish"), F.get(sentences, m["sentence_pos"]).alias("sentence")
    )))
    rows = keyed.join(found, "text_key").select(*kept, F.explode(taken).alias("m"))
    return rows.select(
        *kept, "m.sentence_pos", "m.dish", clip_sentence(F.col("m.sentence"), F.col("m.dish")).alias("promo_text")
    )


def mention_rows(tokens: DataFrame, dictionary: DataFrame, lemma_table: DataFrame) -> DataFrame:
    """All tokens that name an item of one word, as ``dish``."""
    patterns = dictionary_patterns(dictionary, lemma_table)
    return tokens.join(patterns, F.col("form") == F.col("pattern")).drop("pattern")
