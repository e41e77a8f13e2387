"""Written work tables between the steps of an operator, and facts about the session."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, work_path

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Text bytes that one partition of an exchange stands for.
PARTITION_BYTES = 6 << 20


# Rows of an Arrow batch where the session has Spark's default, which would hold
# ten times as many texts in memory at once.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


# Sizes from which memory goes back to the system.
_MALLOC = {"MALLOC_MMAP_THRESHOLD_": str(512 << 10), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}

# Paths of written work tables: by frame, and by application those that ``release`` deletes.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
_OPEN: dict[str, list[str]] = {}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers started from here import this package, with batches of bounded size.

    On a cluster the package is installed or shipped with ``--py-files``; a path
    that does not exist there does no harm.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if PACKAGE_ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (PACKAGE_ROOT, known) if p)
    return spark


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` for dots) that hold for what is planned inside."""
    names = {key.replace("__", "."): value for key, value in values.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def return_memory(spark: SparkSession) -> None:
    """Let workers started from here give large arrays back to the system as they are dropped.

    For jobs of several steps, whose workers live on: what one step needed is not held during
    the next. It costs time where large arrays come and go quickly, so single operators do
    without.
    """
    environment = spark.sparkContext.environment
    for name, value in _MALLOC.items():
        environment.setdefault(name, value)


def staged(df: DataFrame, name: str, partitions: int | None = None, keep: bool = False) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    A step that is written survives lost executors, and the shuffle files that
    made it are removed as soon as it is complete. ``partitions`` is the number that its
    shuffles begin with; AQE still merges small ones and splits those of a hot key.
    ``release`` leaves the table alone with ``keep``.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    more = {"spark__sql__shuffle__partitions": str(partitions)} if partitions else {}
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **more):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _PATHS[found] = path
    if not keep:
        _OPEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return found


def drop(*tables: DataFrame | None) -> None:
    """Delete work tables that ``staged`` gave, once all that is made of them is written."""
    for table in tables:
        path = _PATHS.pop(table, None) if table is not None else None
        if path:
            delete_path(table.sparkSession, path)
            paths = _OPEN.get(table.sparkSession.sparkContext.applicationId, [])
            if path in paths:
                paths.remove(path)


def release(spark: SparkSession) -> None:
    """Delete all work tables of finished steps.

    Only for a job whose results so far are written themselves: frames that were not
    written yet cannot be read any more.
    """
    for path in _OPEN.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(spark: SparkSession, size: int, each: int = PARTITION_BYTES) -> int:
    """Number of exchange partitions that grows with the input's ``size``."""
    return max(shuffle_partitions(spark), -(-size // each), 1)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts, from one scan of that column."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()[0])


def bucket(key: Column, count: int, salt: int = 0) -> Column:
    """Bucket number of a key, null keys included."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(count)).cast("int")


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Whatever else the table holds, also under a name the operator uses, is left out.
    """
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def with_kept(df: DataFrame, kept: Sequence[str], **columns: str) -> DataFrame:
    """``plain`` plus one struct ``kept`` that carries columns through an operator."""
    carried = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(True).alias("none"))
    return df.select(
        *[F.col(f"`{source}`").alias(name) for name, source in columns.items()], carried.alias("kept")
    )
