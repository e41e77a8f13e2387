"""Weights by number of ratings, and how a rating is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (ratings from, weight).
TRENDING_TIERS = [(0, 0.4), (5, 0.5), (6, 0.6), (7, 0.7), (8, 0.8), (9, 0.9), (10, 1.0)]
CONFIDENCE_TIERS = [
    (0, 0.55), (10, 0.60), (25, 0.65), (50, 0.70), (75, 0.75), (100, 0.80),
    (125, 0.85), (150, 0.90), (175, 0.95), (500, 1.00),
]
RATING_FLOOR = 3.5


def _tier(count: Column, tiers: list[tuple[int, float]]) -> Column:
    (top, weight), *lower = reversed(tiers)
    chain = F.when(count >= top, F.lit(weight))
    for start, value in lower:
        chain = chain.when(count >= start, F.lit(value))
    return chain


def trending_weight(num: Column) -> Column:
    return _tier(num, TRENDING_TIERS)


def trending_score(num: Column, total: Column) -> Column:
    """Weight times total score; a single rating does not trend (0.0)."""
    return F.when(num == 1, F.lit(0.0)).otherwise(total * trending_weight(num))


def confidence_weight(num: Column) -> Column:
    return _tier(num, CONFIDENCE_TIERS)


def format_rating(rating: Column) -> Column:
    """One decimal, half up, as text."""
    return F.format_string("%.1f", rating)


def round_at(number: Column, places: int) -> Column:
    return F.round(number, places)
