"""Sentence sentiment 1..5 with negation and intensity, composed along the sentence.

Besides polar words there are modifiers: a negator turns round the polar words behind it,
an intensifier multiplies them. Both reach a few words far, and a clause mark ends what a
negator reaches. The lexicon and the modifiers are tables of any size, looked up slice by
slice (``lookup``); each word of a sentence then looks back over the few words in reach.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words_of
from ..sources.stages import Stage, fresh
from .lookup import looked_up
from .sentiment import score_of, word_polarities

# Words between a modifier and the last word that it reaches, itself counted.
NEGATION_REACH = 3
INTENSITY_REACH = 2

NEGATE, INTENSIFY, CLAUSE = "negate", "intensify", "clause"


def modifier_rows(modifiers: DataFrame) -> DataFrame:
    """One ``(word, kind, factor)`` per word: of several kinds the first by name, of factors the largest."""
    listed = modifiers.where(F.col("word").isNotNull() & F.col("kind").isin(NEGATE, INTENSIFY, CLAUSE))
    best = listed.groupBy("word").agg(F.min(
        F.struct("kind", (-F.coalesce(F.col("factor").cast("double"), F.lit(1.0))).alias("less"))
    ).alias("m"))
    return best.select("word", F.col("m.kind").alias("kind"), (-F.col("m.less")).alias("factor"))


def composing() -> Callable[[pa.ListArray, pa.Array], pa.Array]:
    """What sums up the polarities of each sentence's words, with what modifies them.

    It gets ``(kind, factor, polarity)`` or null for the words of all sentences, one after
    another. A word looks back over the words in reach: an odd number of negators without a
    clause mark behind them turns it round, the nearest intensifier multiplies it. Being a
    function inside, it reaches executors without this package.
    """

    def totals(lists: pa.ListArray, found: pa.Array) -> pa.Array:
        rows = pc.list_parent_indices(lists).to_numpy()
        kind, factor, polarity = (pc.struct_field(found, name) for name in ("kind", "factor", "polarity"))
        negate, intensify, clause = (
            pc.fill_null(pc.equal(kind, name), False).to_numpy(zero_copy_only=False) for name in (NEGATE, INTENSIFY, CLAUSE)
        )
        factor = pc.fill_null(factor, 1.0).to_numpy(zero_copy_only=False)
        sign, times = np.ones(len(rows)), np.ones(len(rows))
        open_, near = np.ones(len(rows), bool), np.ones(len(rows), bool)
        for back in range(1, max(NEGATION_REACH, INTENSITY_REACH) + 1):
            same = rows[back:] == rows[:-back]
            if back <= NEGATION_REACH:
                open_[back:] &= same & ~clause[:-back]
                sign[back:][open_[back:] & negate[:-back]] *= -1
            if back <= INTENSITY_REACH:
                takes = same & near[back:] & intensify[:-back]
                times[back:][takes] = factor[:-back][takes]
                near[back:] &= ~takes
        value = pc.fill_null(polarity, 0.0).to_numpy(zero_copy_only=False) * sign * times
        return pa.array(np.bincount(rows, value, len(lists)).astype(float))

    return totals


def score_composed(rows: DataFrame, text: str, lexicon: DataFrame, modifiers: DataFrame, stage: Stage = fresh) -> DataFrame:
    """Add ``score`` for the sentence in ``text``; a null one is neutral.

    A word that is both polar and a modifier is both.
    """
    # A word listed in one table only has nulls from the other.
    listed = word_polarities(lexicon).join(modifier_rows(modifiers), "word", "full_outer")
    listed = listed.select("word", F.struct("kind", "factor", "polarity").alias("value"))
    totals = looked_up(rows, text, words_of(F.col(text)), listed, "word_total", T.DoubleType(), composing(), stage)
    return totals.withColumn("score", score_of(F.round("word_total"))).drop("word_total")
