"""Vectors of a table as matrices: which take part, and blocks of them as rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vectors that one index shard holds, and queries that are searched together.
SHARD_VECTORS = 4_096
QUERY_BLOCK = 256
PART_BLOCKS = 64

BLOCKS = "dim int, block long, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    """Neither null nor empty, and without null, NaN or infinite components."""
    as_double = vector.cast("array<double>")
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def placed(rows: DataFrame) -> DataFrame:
    """Rows as read from a table, with ``place``, where they lie: the same when a task runs again."""
    return rows.withColumn("place", F.monotonically_increasing_id())


def nonzero(vector: Column) -> Column:
    return F.exists(vector.cast("array<double>"), lambda x: x != 0)


def matrix(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix of one block."""
    names = np.frombuffer(ids, dtype=np.int64)
    return names, np.frombuffer(vectors, dtype=np.float64).reshape(len(names), -1)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``(id, vector)`` gathered into ``BLOCKS`` of about ``size`` vectors of one dimension.

    Vectors are dealt by a hash of their id and, where the rows have one, of their column
    ``place``, so no block grows with a frequent id or vector.
    """
    count = max(1, -(-rows.count() // size))
    key = ["id", "place"] if "place" in rows.columns else ["id"]
    dealt = rows.select(
        "id", F.col("vector").cast("array<double>").alias("vector"), F.size("vector").alias("dim"),
        F.pmod(F.xxhash64(*key), F.lit(count)).alias("block"),
    )

    def gather(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            (np.asarray(b.column("id"), dtype=np.int64), np.asarray(b.column("vector").flatten(), dtype=np.float64))
            for b in batches
        ]
        ids = np.concatenate([p[0] for p in parts])
        values = np.concatenate([p[1] for p in parts]).reshape(len(ids), -1)
        # One order for whatever order the rows arrive in, repeated ids included.
        order = np.lexsort((*values.T, ids))
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[0].as_py()], pa.int32()), pa.array([keys[1].as_py()], pa.int64()),
             pa.array([ids[order].tobytes()], pa.binary()), pa.array([values[order].tobytes()], pa.binary())],
            names=["dim", "block", "ids", "vectors"],
        )

    return dealt.groupBy("dim", "block").applyInArrow(gather, BLOCKS)


def meet(queries: DataFrame, shards: DataFrame, search, schema: str) -> DataFrame:
    """Run ``search(keys, queries, shard)`` for every shard and every part of the queries.

    A part is ``PART_BLOCKS`` query blocks, so what one task holds is bounded. Both sides
    are repeated by the counts of the other's parts, never by rows.
    """
    parts = queries.select("*", F.expr(f"block DIV {PART_BLOCKS}").alias("part"))
    last = shards.groupBy("dim").agg(F.max("block").alias("last"))
    asked = parts.join(last, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    widest = parts.groupBy("dim").agg(F.max("part").alias("last"))
    data = shards.join(widest, "dim").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    keys = ["dim", "shard", "part"]
    return asked.drop("last").groupBy(*keys).cogroup(
        data.drop("last").withColumn("shard", F.col("block")).groupBy(*keys)
    ).applyInArrow(search, schema)


def best_of(found: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` best, equal scores by id."""
    order = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
