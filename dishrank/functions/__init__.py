"""Column functions; every one is built from Spark's own expressions."""

from .keys import city_label, citystate_key, clean_address, normalise_city
from .messages import rating_fields, rating_key, rating_value
from .text import (
    SNIPPET_LIST, SNIPPET_SEARCH, bound, clip_sentence, plurals, sentences_of, singular, snippet, text_key, words_of,
)
from .weights import confidence_weight, format_rating, round_at, trending_score, trending_weight

__all__ = [
    "SNIPPET_LIST", "SNIPPET_SEARCH", "bound", "city_label", "citystate_key", "clean_address", "clip_sentence",
    "confidence_weight", "format_rating", "normalise_city", "plurals", "rating_fields", "rating_key", "rating_value",
    "round_at", "sentences_of", "singular", "snippet", "text_key", "trending_score", "trending_weight", "words_of",
]
