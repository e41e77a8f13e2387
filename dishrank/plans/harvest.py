"""Term harvest: completion responses to a sorted list of terms per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import split_completions
from ..sources.sinks import write_terms


def terms_by_type(completions: DataFrame) -> DataFrame:
    """Sorted value set of each type, one value per row, with the set's size."""
    sets = completions.select("type", "value").distinct()
    sizes = sets.groupBy("type").agg(F.count(F.lit(1)).alias("n_values"))
    return sets.join(sizes, "type").orderBy("type", "value")


def harvest(responses: DataFrame, path: str, quarantine_path: str | None = None) -> None:
    """Responses (JSON in ``value``) to ``type,value`` lines at ``path``.

    Responses that cannot be used go to ``quarantine_path`` with the reason, if one is given.
    """
    terms, refused = split_completions(responses)
    write_terms(terms, path)
    if quarantine_path:
        refused.write.mode("overwrite").json(quarantine_path)
