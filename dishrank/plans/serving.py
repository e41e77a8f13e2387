"""Ranked lookups over the published tables.

Each works for one request or for all at once: a single request is a filter
before the ranking, all requests are groups of one ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import city_label, clean_address, normalise_city
from ..functions.weights import RATING_FLOOR, confidence_weight, format_rating
from ..operators.ranking import top_k

SEARCH_HITS = 4
RESTAURANT_DISHES = 3
CITY_TRENDS = 3

FIELDS = [
    "dish", "businessid", "avgrating", "dishnumreviews", "promotext", "address", "name",
    "restaurantnumreviews", "stars",
]


def rated_dishes(dishes: DataFrame) -> DataFrame:
    """Dishes at or above the rating floor, with their weighted score."""
    served = dishes.select("citystate", "dish", "businessid", "avgrating", "numreviews", "promotext")
    return served.where(F.col("avgrating") >= RATING_FLOOR).withColumn(
        "weighted", F.col("avgrating") * confidence_weight(F.col("numreviews"))
    )


def enrich(ranked: DataFrame, businesses: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Response rows of ranked dishes; a dish without a business is dropped."""
    attributes = businesses.select("citystate", "businessid", "full_address", "name", "reviewcount", "stars")
    joined = ranked.join(attributes, ["citystate", "businessid"])
    return joined.select(
        "citystate",
        *(extra or []),
        "dish",
        "businessid",
        format_rating(F.col("avgrating")).alias("avgrating"),
        F.col("numreviews").alias("dishnumreviews"),
        "promotext",
        clean_address(F.col("full_address")).alias("address"),
        "name",
        F.col("reviewcount").alias("restaurantnumreviews"),
        "stars",
    )


def _city(city: str) -> Column:
    return normalise_city(F.lit(city))


def _by_score() -> list[Column]:
    return [F.desc("weighted"), F.asc("dish"), F.asc("businessid")]


def search_all(dishes: DataFrame, businesses: DataFrame, dictionary: DataFrame, k: int = SEARCH_HITS) -> DataFrame:
    """Top dishes for every city and category that has a hit."""
    pairs = dictionary.select(F.col("category").alias("term"), F.col("item").alias("dish")).distinct()
    hits = rated_dishes(dishes).join(pairs, "dish")
    top = top_k(hits, ["citystate", "term"], _by_score(), k, rank="rank")
    return enrich(top, businesses, ["term", "rank"])


def search_requests(
    requests: DataFrame, dishes: DataFrame, businesses: DataFrame, dictionary: DataFrame, k: int = SEARCH_HITS
) -> DataFrame:
    """Top dishes of each request ``(city, term)``; an unknown term gives no rows."""
    asked = requests.select(normalise_city(F.col("city")).alias("citystate"), "term").distinct()
    pairs = dictionary.select(F.col("category").alias("term"), F.col("item").alias("dish")).distinct()
    # Rated dishes meet their categories first, so a large category is never spread over all cities.
    hits = rated_dishes(dishes).join(pairs, "dish").join(asked, ["citystate", "term"], "left_semi")
    top = top_k(hits, ["citystate", "term"], _by_score(), k, rank="rank")
    return enrich(top, businesses, ["term", "rank"])


def search_one(
    dishes: DataFrame, businesses: DataFrame, dictionary: DataFrame, city: str, term: str, k: int = SEARCH_HITS
) -> DataFrame:
    """One request: the city filter prunes folders, the limit is a top-k per task."""
    wanted = dictionary.where(F.col("category") == term).select(F.col("item").alias("dish")).distinct()
    hits = rated_dishes(dishes.where(F.col("citystate") == _city(city))).join(wanted, "dish", "left_semi")
    top = hits.orderBy(*_by_score()).limit(k)
    return _in_rank_order(top, businesses, _by_score())


def _in_rank_order(top: DataFrame, businesses: DataFrame, order: list[Column]) -> DataFrame:
    """At most ``k`` rows are left here, so the final order costs nothing."""
    kept = [c for c in ["weighted"] if c in top.columns]
    rows = enrich(top.withColumn("order_key", F.struct(*(kept or ["dish"]))), businesses, ["order_key"])
    keys = [F.desc("order_key"), F.asc("dish"), F.asc("businessid")] if kept else order
    return rows.orderBy(*keys).select(*FIELDS)


def restaurant_all(dishes: DataFrame, businesses: DataFrame, k: int = RESTAURANT_DISHES) -> DataFrame:
    """Top dishes of every restaurant."""
    top = top_k(rated_dishes(dishes), ["citystate", "businessid"], _by_score(), k, rank="rank")
    return enrich(top, businesses, ["rank"])


def restaurant_one(
    dishes: DataFrame, businesses: DataFrame, city: str, businessid: str, k: int = RESTAURANT_DISHES
) -> DataFrame:
    own = dishes.where((F.col("citystate") == _city(city)) & (F.col("businessid") == businessid))
    top = rated_dishes(own).orderBy(*_by_score()).limit(k)
    return _in_rank_order(top, businesses, _by_score())


def city_all(trends: DataFrame, businesses: DataFrame, k: int = CITY_TRENDS) -> DataFrame:
    """First trends of every city in key order, as stored."""
    top = top_k(trends, ["citystate"], [F.asc("dish"), F.asc("businessid")], k, rank="rank")
    return enrich(top, businesses, ["rank"])


def city_one(trends: DataFrame, businesses: DataFrame, city: str, k: int = CITY_TRENDS) -> DataFrame:
    order = [F.asc("dish"), F.asc("businessid")]
    top = trends.where(F.col("citystate") == _city(city)).orderBy(*order).limit(k)
    return _in_rank_order(top, businesses, order)


def places_of_dish(dishes: DataFrame, businesses: DataFrame, dish: str) -> DataFrame:
    """Every business that has a dish, in all cities, rated high enough or not.

    Row groups whose Bloom filter or dictionary lacks the dish are not read.
    """
    served = dishes.where(F.col("dish") == dish).select("citystate", "dish", "businessid", "avgrating", "numreviews", "promotext")
    return enrich(served, businesses)


def dishes_of_business(dishes: DataFrame, businessid: str) -> DataFrame:
    """All dishes of one business, whatever city it is in; row groups without it are not read."""
    return dishes.where(F.col("businessid") == businessid)


def list_cities(dishes: DataFrame) -> DataFrame:
    """Labels of all cities with dishes, in key order."""
    cities = dishes.select("citystate").distinct().orderBy("citystate")
    return cities.select("citystate", city_label(F.col("citystate")).alias("label"))


def as_json(recommendations: DataFrame) -> DataFrame:
    """Response rows as JSON text next to the columns that name the request."""
    request = [c for c in recommendations.columns if c not in FIELDS]
    return recommendations.select(*request, F.to_json(F.struct(*FIELDS)).alias("json"))
