"""Scores per business and dish, with the best quote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(reviews: DataFrame, tips: DataFrame) -> DataFrame:
    """Reviews and tips together, duplicates kept; texts and mentions alike."""
    return reviews.unionByName(tips)


def best_quote(mentions: DataFrame) -> DataFrame:
    """Quote of the highest score per business and dish.

    Equal scores are settled by date and text, so the result does not depend
    on the order in which rows arrive.
    """
    best = F.max(F.struct("score", "promo_date", "promo_text")).alias("best")
    return mentions.groupBy("business_id", "dish").agg(best).select(
        "business_id", "dish",
        F.col("best.promo_text").alias("promotext"),
        F.col("best.score").cast("int").alias("promoscore"),
        F.col("best.promo_date").alias("promodate"),
    )


def dish_scores(mentions: DataFrame) -> DataFrame:
    """Average, total, count and best quote per business and dish.

    One shuffle: counts, sums and the quote are combined per task first, so a
    business or dish with a third of all mentions sends one row per task.
    """
    scored = mentions.groupBy("business_id", "dish").agg(
        F.count(F.lit(1)).alias("numreviews"),
        F.sum(F.col("score").cast("long")).alias("totalscore"),
        F.max(F.struct("score", "promo_date", "promo_text")).alias("best"),
    )
    return scored.select(
        F.col("business_id").alias("businessid"),
        "dish",
        (F.col("totalscore") / F.col("numreviews")).alias("avgrating"),
        "totalscore",
        "numreviews",
        F.col("best.promo_text").alias("promotext"),
        F.col("best.score").cast("int").alias("promoscore"),
    )
