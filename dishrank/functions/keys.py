"""City keys and labels, address cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_city(city: Column) -> Column:
    """City parameter without commas and spaces, as the tables store it."""
    return F.translate(city, ", ", "")


def citystate_key(city: Column, state: Column) -> Column:
    """Partition key of the published tables; the same rule as lookups use."""
    return normalise_city(F.concat(city, state))


def city_label(citystate: Column) -> Column:
    """``LasVegasNV`` -> ``LasVegas, NV``; the state is the last two characters."""
    return F.concat(
        F.substr(citystate, F.lit(1), F.length(citystate) - 2), F.lit(", "), F.right(citystate, F.lit(2))
    )


def clean_address(address: Column) -> Column:
    """Replace each literal backslash + ``n`` by a space; real newlines stay."""
    return F.replace(address, F.lit("\\n"), F.lit(" "))
