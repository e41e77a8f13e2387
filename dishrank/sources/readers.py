"""Readers with explicit schemas, so no pass over the data infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..operators.dictionary import parse_dictionary
from ..session import is_file
from .versions import is_versioned, read_version


def spread_small(rows: DataFrame, *key: str) -> DataFrame:
    """Spread a small input of few files over all task slots.

    A file may be a single split whatever its size. Text work costs far more
    than this one shuffle of less than half a split per slot; a large input, or
    one with a file per slot, is left where it is.
    """
    spark = rows.sparkSession
    slots = spark.sparkContext.defaultParallelism
    split_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    # Spark's own size estimate for the plan, taken from the file sizes.
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size < slots * split_bytes // 2 and len(rows.inputFiles()) < slots
    return rows.repartition(slots, *key) if small else rows


def _with_key(schema: StructType, key: str) -> StructType:
    return StructType(schema.fields + StructType.fromDDL(key).fields) if key else schema


def read_reviews(spark: SparkSession, path: str, key: str = "") -> DataFrame:
    """Reviews; ``key`` declares further columns that identify one, as ``"review_id string"``."""
    return spread_small(spark.read.schema(_with_key(schemas.REVIEW, key)).parquet(path))


def read_tips(spark: SparkSession, path: str, key: str = "") -> DataFrame:
    return spread_small(spark.read.schema(_with_key(schemas.TIP, key)).parquet(path))


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    """Businesses from JSON lines."""
    return spark.read.schema(schemas.BUSINESS).json(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_dictionary(spark.read.text(path))


def _read_cities(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table by city: its current version, or all files where it has none."""
    if is_versioned(spark, path):
        return read_version(spark, path, schema, "citystate")
    return spark.read.schema(schema).parquet(path)


def read_dishes(spark: SparkSession, path: str) -> DataFrame:
    """Published dishes; a filter on ``citystate`` reads that folder only."""
    return _read_cities(spark, path, schemas.DISHES)


def read_published_businesses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BUSINESSES).parquet(path)


def read_trends(spark: SparkSession, path: str) -> DataFrame:
    return _read_cities(spark, path, schemas.TRENDS)


def read_live_trends(spark: SparkSession, path: str) -> DataFrame:
    """Trends of windows that are still open, with ``window_end``."""
    return _read_cities(spark, path, schemas.LIVE_TRENDS)


def read_completions(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """``(type, value)`` of all completion responses, one JSON document per file or per line."""
    return parse_completions(spark.read.text(path, wholetext=not per_line))


def _parsed_responses(responses: DataFrame) -> DataFrame:
    """Responses with ``document`` and ``reason``, why one cannot be used (null: it can)."""
    schema = StructType([*schemas.COMPLETION.fields, StructField(schemas.CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    parsed = responses.withColumn("document", F.from_json("value", schema, options))
    reason = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), "empty")
        .when(F.col(f"document.{schemas.CORRUPT}").isNotNull() | F.col("document").isNull(), "malformed")
        .when(F.col("document.result_list").isNull(), "no results")
    )
    return parsed.withColumn("reason", reason)


def _terms(parsed: DataFrame) -> DataFrame:
    first = F.get(F.col("document.result_list"), F.lit(0))
    return parsed.select(F.explode(first["completion_list"]).alias("c")).select("c.type", "c.value")


def parse_completions(responses: DataFrame) -> DataFrame:
    """``(type, value)`` of the first result of each JSON response in ``value``.

    Responses that cannot be used give no rows; ``split_completions`` sets them aside.
    """
    return _terms(_parsed_responses(responses).where(F.col("reason").isNull()))


def split_completions(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms of the usable responses, and the other responses with the ``reason``.

    A response whose list of results is empty is usable and has no terms.
    """
    parsed = _parsed_responses(responses)
    refused = parsed.where(F.col("reason").isNotNull()).select(*responses.columns, "reason")
    return _terms(parsed.where(F.col("reason").isNull())), refused


def kafka_options(servers: str, topic: str, starting: str = "latest", max_offsets: int | None = None) -> dict[str, str]:
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def read_rating_stream(spark: SparkSession, servers: str, topic: str = "newreview", **options) -> DataFrame:
    """Stream ``(key, value, ts)`` from Kafka; needs Spark's Kafka package."""
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options))
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), F.col("timestamp").alias("ts")
    )


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """Stream of the files that make up the table at ``path``, a folder or one file."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_file(spark, path):  # the file source watches folders only
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
