"""Batch build: texts to published dishes and businesses."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.composed_sentiment import score_composed
from ..operators.mentions import find_mentions
from ..operators.published import businesses_view, dishes_view, join_business
from ..operators.scoring import dish_scores, union_all
from ..operators.sentiment import score_sentences
from ..sources.sinks import publish_businesses, publish_dishes, stage_roundtrip
from ..sources.stages import Stage, fresh


def scored_mentions(
    texts: DataFrame,
    dictionary: DataFrame,
    lemma_table: DataFrame,
    lexicon: DataFrame,
    policy: str = "last",
    max_ngram: int = 1,
    stage: Stage = fresh,
    modifiers: DataFrame | None = None,
) -> DataFrame:
    """``(business_id, dish, score, promo_text, promo_date)`` of texts with ``business_id, text, date``.

    With ``modifiers(word, kind, factor)`` negation and intensity change what a word says.
    """
    found = find_mentions(texts, dictionary, lemma_table, policy, max_ngram, stage)
    # Scoring reads the mentions twice, so they are written once.
    found = stage(found, "mentions")
    if modifiers is None:
        scored = score_sentences(found, "promo_text", lexicon)
    else:
        scored = score_composed(found, "promo_text", lexicon, modifiers)
    return scored.select(
        "business_id", "dish", "score", "promo_text", F.try_to_date(F.col("date")).alias("promo_date")
    )


def dish_ratings(
    reviews: DataFrame,
    tips: DataFrame,
    business: DataFrame,
    dictionary: DataFrame,
    lemma_table: DataFrame,
    lexicon: DataFrame,
    policy: str = "last",
    max_ngram: int = 1,
    stage: Stage = fresh,
    modifiers: DataFrame | None = None,
) -> DataFrame:
    """Dish scores of reviews and tips, joined to their businesses."""
    texts = union_all(reviews, tips)
    mentions = scored_mentions(texts, dictionary, lemma_table, lexicon, policy, max_ngram, stage, modifiers)
    return join_business(dish_scores(mentions), business)


def publish(
    joined: DataFrame, dishes_path: str, businesses_path: str, stage_path: str | None = None, stage: Stage | None = None
) -> None:
    """Write both tables from one evaluation of the joined rows.

    With ``stage_path`` the rows are written there first, so neither a lost
    executor nor a failed sink makes the text work run again; with ``stage``
    they are a named stage, which a later run reads as well. Without either
    they are cached in memory and on disk.
    """
    if stage:
        source = stage(joined, "joined")
    elif stage_path:
        source = stage_roundtrip(joined, stage_path)
    else:
        source = joined.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        publish_dishes(dishes_view(source), dishes_path)
        publish_businesses(businesses_view(source), businesses_path)
    finally:
        if not (stage or stage_path):
            source.unpersist()
