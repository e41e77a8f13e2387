"""Rating messages: ``dish,businessid,citystate,score[,promotext]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE_NUMBER = r"\A[+-]?[0-9]+\z"


def rating_fields(parts: Column) -> dict[str, Column]:
    """Fields of a message split at its commas.

    The text ends at its first comma; no fifth field gives an empty text.
    ``valid`` is false for fewer than four fields or a score that is no whole number.
    """
    # A plain cast would also take " 4" and, in some modes, "4.5".
    written = F.get(parts, F.lit(3))
    score = F.when(written.rlike(WHOLE_NUMBER), written.try_cast("int"))
    return {
        "dish": F.get(parts, F.lit(0)),
        "businessid": F.get(parts, F.lit(1)),
        "citystate": F.get(parts, F.lit(2)),
        "score": score,
        "promotext": F.coalesce(F.get(parts, F.lit(4)), F.lit("")),
        "valid": score.isNotNull(),
    }


def rating_key(dish: Column, businessid: Column) -> Column:
    return F.concat(dish, businessid)


def rating_value(dish: Column, businessid: Column, citystate: Column, score: Column, promotext: Column) -> Column:
    """Message text; a null ``promotext`` leaves the fifth field out."""
    return F.concat_ws(",", dish, businessid, citystate, score.cast("string"), promotext)
