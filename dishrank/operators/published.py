"""Projections to the published schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import citystate_key
from ..schemas import BUSINESS_KEY


def join_business(scores: DataFrame, business: DataFrame) -> DataFrame:
    """Dish scores with the attributes of their business; others are dropped.

    No hint: Spark broadcasts the businesses only while their size allows, and
    otherwise shuffles both sides and splits a business with many dishes.
    """
    attributes = business.withColumnRenamed("business_id", "businessid")
    return scores.join(attributes, "businessid")


def dishes_view(joined: DataFrame) -> DataFrame:
    rows = joined.select(
        citystate_key(F.col("city"), F.col("state")).alias("citystate"),
        "dish",
        "businessid",
        F.col("avgrating").cast("double").alias("avgrating"),
        F.col("numreviews").cast("long").alias("numreviews"),
        F.col("totalscore").cast("long").alias("totalscore"),
        "promotext",
        F.col("promoscore").cast("int").alias("promoscore"),
    )
    return rows.dropna(subset=["citystate", "dish", "businessid"])


def businesses_view(joined: DataFrame) -> DataFrame:
    """One row per business of the joined rows, which repeat it for each dish."""
    rows = joined.select(
        "businessid",
        citystate_key(F.col("city"), F.col("state")).alias("citystate"),
        "name",
        "full_address",
        "city",
        "state",
        F.col("stars").cast("double").alias("stars"),
        F.col("review_count").cast("long").alias("reviewcount"),
    )
    return rows.dropna(subset=BUSINESS_KEY).dropDuplicates(BUSINESS_KEY)


def of_category(businesses: DataFrame, category: str) -> DataFrame:
    """Businesses whose ``categories`` hold one; without any they are of none."""
    return businesses.where(F.coalesce(F.array_contains("categories", category), F.lit(False)))
