"""Top rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group.

    The rank filter stands right above the window, so Spark limits each task's
    rows to ``k`` per group before the shuffle (WindowGroupLimit); a group with
    a third of all rows therefore sends ``k`` rows per task.
    """
    name = rank or "_rank"
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)
