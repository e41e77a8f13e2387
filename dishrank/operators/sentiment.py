"""Sentence sentiment 1..5 from a word lexicon with polarities.

One way for a lexicon of any size: the words of the sentences are looked up slice by
slice (``lookup``) and summed up per sentence. No text is a key, so rows may repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import bound, sentences_of, words_of
from ..sources.stages import Stage, fresh
from .lookup import looked_up

# Classes 0..4 around the neutral class 2; the score is class + 1.
NEUTRAL_CLASS = 2
TOP_CLASS = 4


def score_of(total: Column) -> Column:
    """Score of a sentence from the sum of its word polarities."""
    bounded = F.greatest(F.lit(0), F.least(F.lit(TOP_CLASS), total + NEUTRAL_CLASS))
    return (bounded + 1).cast("int")


def word_polarities(lexicon: DataFrame) -> DataFrame:
    """One polarity per word; those of a word that is listed again are added."""
    listed = lexicon.where(F.col("word").isNotNull() & F.col("polarity").isNotNull())
    return listed.groupBy("word").agg(F.sum(F.col("polarity").cast("double")).alias("polarity"))


def word_counts(words: Column) -> Column:
    """``(word, times)`` of each different word, as runs of the sorted words."""

    def runs(ordered: Column) -> Column:
        heads = F.transform(ordered, lambda w, i: F.when((i == 0) | (w != F.get(ordered, i - 1)), i))
        return bound(F.filter(heads, lambda i: i.isNotNull()), lambda heads: F.transform(heads, lambda head, k: F.struct(
            F.get(ordered, head).alias("word"), (F.coalesce(F.get(heads, k + 1), F.size(ordered)) - head).alias("times")
        )))

    return bound(F.sort_array(words), runs)


def score_sentences(rows: DataFrame, text: str, lexicon: DataFrame, stage: Stage = fresh) -> DataFrame:
    """Add ``score`` for the sentence in ``text``; a null one is neutral."""

    def sums(lists: pa.ListArray, found: pa.Array) -> pa.Array:
        rows = pc.list_parent_indices(lists).to_numpy()
        return pa.array(np.bincount(rows, pc.fill_null(found, 0.0).to_numpy(), len(lists)).astype(float))

    listed = word_polarities(lexicon).withColumnRenamed("polarity", "value")
    totals = looked_up(rows, text, words_of(F.col(text)), listed, "word_total", T.DoubleType(), sums, stage)
    return totals.withColumn("score", score_of(F.col("word_total"))).drop("word_total")


def longest_sentences(reviews: DataFrame) -> DataFrame:
    """Each review's longest sentence, the first of equal length."""
    kept = [c for c in reviews.columns if c != "text"]
    measured = F.transform(
        sentences_of(F.col("text")),
        lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("place"), s.alias("sentence")),
    )
    longest = F.filter(F.array(F.array_max(measured)), lambda m: m.isNotNull())
    return reviews.select(*kept, F.explode(longest).alias("m")).select(*kept, "m.sentence")
