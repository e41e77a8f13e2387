"""Tables that change as a whole: data folders nobody overwrites, and a pointer set last.

``<path>/current`` holds one empty file per switch, named by its number and the version it
switches to; the greatest name is the current one. A file name appears at once or not at
all in any store Spark writes to, so a reader sees the version before or the one after,
and a job that dies before its last step has changed nothing.

A versioned table is partitioned by a key (``citystate``). A new version writes the keys it
changes below ``<path>/data/version=<version>`` and a manifest, one row per key, that names
for every key the version its rows are in. Keys it does not touch are neither read nor
written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import delete_path, list_names, path_exists, touch

VERSION = "version"
# A version that holds all keys itself is named so; its readers need no manifest.
WHOLE = "whole-"
_DIGITS = 12


def switches(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """``(number, version)`` of every switch of the pointer, oldest first."""
    return [(int(name[:_DIGITS]), name[_DIGITS + 1:]) for name in list_names(spark, f"{path}/current")]


def current_version(spark: SparkSession, path: str) -> str | None:
    """Version that readers see; none before the first one is complete."""
    known = switches(spark, path)
    return known[-1][1] if known else None


def switch_to(spark: SparkSession, path: str, version: str) -> None:
    """Make a complete version the current one; doing so again changes nothing."""
    known = switches(spark, path)
    if not known or known[-1][1] != version:
        number = known[-1][0] + 1 if known else 1
        touch(spark, f"{path}/current/{number:0{_DIGITS}d}-{version}")


def _manifest(spark: SparkSession, path: str, version: str, key: str) -> DataFrame:
    fields = [StructField(key, StringType()), StructField(VERSION, StringType())]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/manifests/{version}")


def _matched(rows: DataFrame, manifest: DataFrame, key: str, how: str, versions: bool = True) -> DataFrame:
    """Rows that a manifest names, or those that it does not; an empty key is read as null and is a key too."""
    names = manifest.select(F.col(key).alias("_key"), F.col(VERSION).alias("_version"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(names, same & (F.col(VERSION) == F.col("_version")) if versions else same, how)


def is_versioned(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, f"{path}/current")


def read_version(spark: SparkSession, path: str, schema: StructType, key: str, version: str | None = None) -> DataFrame:
    """Rows of one version, the current one if none is named.

    The manifest is one small row per key; joined to the folders' own columns it prunes
    the folders that are read, and a filter on ``key`` prunes them before that. A version
    that was written as a whole is read as its folder.
    """
    version = version or current_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path} has no complete version")
    if version.startswith(WHOLE):
        return spark.read.schema(schema).parquet(_folder(path, version)).select(*schema.names)
    rows = spark.read.schema(StructType([*schema.fields, StructField(VERSION, StringType())])).parquet(f"{path}/data")
    return _matched(rows, _manifest(spark, path, version, key), key, "left_semi").select(*schema.names)


def write_version(
    rows: DataFrame, path: str, version: str, key: str, sort: Sequence[str], base: str | None = None, whole: bool = False,
    sought: Sequence[str] = (), **options: str,
) -> None:
    """Write the keys that occur in ``rows`` as a new version on top of ``base``, then switch to it.

    ``base`` is the current version unless named. With ``whole`` keys without rows are gone.
    Columns in ``sought`` get Bloom filters, so that a search for one of their values skips
    row groups whose range holds it; a filter is as large as its column's different values ask.
    Running it again after a failure writes the version's folder anew; once the version
    was switched to it does nothing.
    """
    spark = rows.sparkSession
    known = [name for _, name in switches(spark, path)]
    if version in known or f"{WHOLE}{version}" in known:
        return
    whole = whole or not known
    version = f"{WHOLE}{version}" if whole else version
    base = base or current_version(spark, path)
    folder = _folder(path, version)
    # AQE splits a key with a third of all rows over many tasks and merges small ones; the
    # sort gives files narrow ranges, so a lookup skips row groups by their statistics.
    laid_out = rows.hint("rebalance", F.col(key)).sortWithinPartitions(key, *sort)
    writer = laid_out.write.mode("overwrite").option("partitionOverwriteMode", "static").options(**options)
    if sought:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for column in sought:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.partitionBy(key).parquet(folder)
    # Which keys were written comes from the folders; no column of the data is read for it.
    written = spark.read.schema(rows.schema).parquet(folder).select(key).distinct()
    changed = written.withColumn(VERSION, F.lit(version))
    if base is not None and not whole:
        if changed.isEmpty():
            # Nothing changes, so readers stay where they are.
            delete_path(spark, folder)
            return
        kept = _matched(_manifest(spark, path, base, key), changed, key, "left_anti", versions=False)
        changed = kept.unionByName(changed)
    changed.write.mode("overwrite").parquet(f"{path}/manifests/{version}")
    switch_to(spark, path, version)


def vacuum(spark: SparkSession, path: str, key: str, keep: int = 2) -> None:
    """Delete folders that none of the last ``keep`` versions names.

    A reader of an older version fails after that, so ``keep`` covers the longest read.
    """
    known = switches(spark, path)
    kept = [version for _, version in known[-keep:]]
    used = None
    for version in kept:
        own = _manifest(spark, path, version, key)
        used = own if used is None else used.unionByName(own)
    old = {version for _, version in known[:-keep]} - set(kept)
    for version in sorted(old):
        still = used.where(F.col(VERSION) == version)
        if still.isEmpty():
            delete_path(spark, _folder(path, version))
            delete_path(spark, f"{path}/manifests/{version}")
        else:
            # Only what the version wrote itself can be unused.
            own = _manifest(spark, path, version, key).where(F.col(VERSION) == version)
            for row in _matched(own, still, key, "left_anti").toLocalIterator():
                delete_path(spark, f"{_folder(path, version)}/{key}={_folder_name(spark, row[key])}")
    # The pointer of a version with keys in use stays, so that a later run comes back to it.
    names = {version for version in old if not path_exists(spark, _folder(path, version))}
    for number, version in known[:-keep]:
        if version in names or version in kept:
            delete_path(spark, f"{path}/current/{number:0{_DIGITS}d}-{version}")


def _folder(path: str, version: str) -> str:
    return f"{path}/data/{VERSION}={version}"


def _folder_name(spark: SparkSession, value: str | None) -> str:
    """A partition value as Spark writes it into a path."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else escape.escapePathName(value)
