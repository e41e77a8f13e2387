"""Samples by row key: a share of the rows, or exactly so many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_by_key(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows whose key hashes below ``fraction``.

    Unlike ``DataFrame.sample`` the choice depends on the key alone, so it is
    the same for any partitioning and after a task is run again.
    """
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return rows.where(digest < int(fraction * 2**32))


# Rows are dealt to so many ranges of their digests.
RANGE_DIGITS = 4


def exact_sample(rows: DataFrame, key: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """Uniform sample of exactly ``n`` rows (all, if there are fewer), without replacement.

    The rows of the ``n`` smallest digests of ``seed`` and key: the same for any
    partitioning and after a task is run again. Rows are counted by digest range first; the
    range in which the ``n``-th row lies is settled by a top-k, each task sending no more
    than it is short of, and all ranges below are taken as they are. So a sample of any
    size passes the driver as counts only. Rows of one key are settled by all their columns.
    """
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    marked = rows.withColumn("_digest", F.md5(text.cast("binary")))
    part = F.substring("_digest", 1, RANGE_DIGITS)
    counts = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("part").collect()
    taken, last = 0, None
    for row in counts:
        if taken + row.rows > n:
            last = row.part
            break
        taken += row.rows
    if last is None:
        return marked.drop("_digest")
    below = marked.where(part < last)
    rest = marked.where(part == last).orderBy("_digest", *rows.columns).limit(n - taken)
    return below.union(rest).drop("_digest")
