"""Item dictionary: lines ``category[|category]:item`` and what is derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_dictionary(lines: DataFrame) -> DataFrame:
    """Distinct ``(category, item)`` of a frame with one ``value`` line per row."""
    parts = F.split("value", ":")
    return (
        lines.select(
            F.explode(F.split(F.get(parts, F.lit(0)), r"\|")).alias("category"),
            F.trim(F.get(parts, F.lit(1)), F.lit(" \t\r")).alias("item"),
        )
        .select(F.trim("category", F.lit(" \t\r")).alias("category"), "item")
        .where("category <> '' and item <> ''")
        .distinct()
    )


def items(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("item").distinct()


def list_items(dictionary: DataFrame) -> DataFrame:
    """All items in order, as an autocomplete list shows them."""
    return items(dictionary).orderBy("item")


def category_items(dictionary: DataFrame) -> DataFrame:
    """The item set of each category, one item per row, with the set's size.

    Long form instead of one array per category, so that a category with a
    third of all items is still spread over many tasks.
    """
    sets = dictionary.select("category", "item").distinct()
    sizes = sets.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"))
    return sets.join(sizes, "category")


def expand_categories(requests: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Requests ``(citystate, term)`` with each item of the category ``term``.

    A term that is no category gives no rows.
    """
    pairs = dictionary.select(F.col("category").alias("term"), F.col("item").alias("dish")).distinct()
    return requests.select("citystate", "term").distinct().join(pairs, "term")
