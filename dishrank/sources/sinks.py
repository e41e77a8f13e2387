"""Sinks for the published tables, term lists and rating messages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import write_version


# Columns of the dishes that are looked up besides the city.
SOUGHT = ["businessid", "dish"]


def publish_dishes(dishes: DataFrame, path: str) -> None:
    """Publish all dishes anew; readers see the table before until the new one is complete."""
    write_version(dishes, path, uuid.uuid4().hex, "citystate", ["dish", "businessid"], whole=True, sought=SOUGHT)


def publish_businesses(businesses: DataFrame, path: str) -> None:
    """Files hold ranges of cities, so a lookup in one city reads few of them."""
    ranged = businesses.repartitionByRange("citystate", "businessid").sortWithinPartitions("citystate", "businessid")
    ranged.write.mode("overwrite").parquet(path)


def replace_dishes(dishes: DataFrame, path: str, version: str) -> None:
    """Replace the dishes of the cities in ``dishes``; all others stay as they are."""
    write_version(dishes, path, version, "citystate", ["dish", "businessid"], sought=SOUGHT)


def replace_trends(trends: DataFrame, path: str, version: str | None = None) -> None:
    """Replace the trends of the cities in ``trends``; all others stay as they are."""
    write_version(trends, path, version or uuid.uuid4().hex, "citystate", ["dish", "businessid"])


def stage_roundtrip(rows: DataFrame, path: str) -> DataFrame:
    """Write a stage to the shared folder and go on from what was written."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def json_to_parquet(spark: SparkSession, source: str, target: str, schema: StructType) -> None:
    """Turn JSON lines into parquet once, so later jobs read only the columns they need."""
    spark.read.schema(schema).json(source).write.mode("overwrite").parquet(target)


def write_business_json(business: DataFrame, path: str) -> None:
    business.write.mode("overwrite").json(path)


def term_lines(terms: DataFrame) -> DataFrame:
    """Distinct ``type,value`` lines in order, sorted by range over many tasks."""
    return terms.select("type", "value").distinct().orderBy("type", "value").select(
        F.concat_ws(",", "type", "value").alias("value")
    )


def write_terms(terms: DataFrame, path: str) -> None:
    term_lines(terms).write.mode("overwrite").text(path)


def write_kafka(messages: DataFrame, servers: str, topic: str = "newreview") -> None:
    """Publish ``(key, value)`` messages; needs Spark's Kafka package."""
    messages.select("key", "value").write.format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "topic": topic}
    ).save()
