import datetime as dt

import pytest
from pyspark.sql import functions as F

from dishrank.catalog import registry
from dishrank.operators import ratings as rat
from dishrank.session import path_exists, work_path
from dishrank.sources import readers, sinks
from dishrank.streaming import ratings as stream

MESSAGES = "ts timestamp_ntz, value string"


def day(n, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


@pytest.fixture
def feed(spark):
    """Folder that messages are appended to, and the stream that reads it."""
    path = work_path(spark, "feed")

    def append(data):
        spark.createDataFrame(data, MESSAGES).coalesce(1).write.mode("append").parquet(path)

    schema = spark.createDataFrame([], MESSAGES).schema
    append([])
    return append, lambda: readers.read_parquet_stream(spark, path, schema)


def stored(spark, path):
    sinks.publish_dishes(
        spark.createDataFrame(
            [("A", "x", "1", 4.0, 2, 8, "p", 5), ("B", "y", "2", 3.0, 1, 3, "q", 3), ("C", "z", "3", 3.0, 1, 3, "r", 3)],
            "citystate string, dish string, businessid string, avgrating double, numreviews long, totalscore long,"
            " promotext string, promoscore int",
        ),
        path,
    )


def counts(spark, path):
    return {r.dish: (r.numreviews, r.totalscore) for r in readers.read_dishes(spark, path).collect()}


def test_each_rating_is_added_once(spark, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "dishes"), work_path(spark, "checkpoint")
    stored(spark, path)
    append([(day(0), "x,1,A,5,good"), (day(0), "x,1,A,1"), (day(0), "new,1,A,5"), (day(0), "broken")])
    stream.start_dishes(messages(), path, checkpoint, available_now=True).awaitTermination()
    assert counts(spark, path) == {"x": (4, 14), "y": (1, 3), "z": (1, 3)}
    append([(day(1), "x,1,A,3"), (day(1), "y,2,B,4")])
    stream.start_dishes(messages(), path, checkpoint, available_now=True).awaitTermination()
    assert counts(spark, path) == {"x": (5, 17), "y": (2, 7), "z": (1, 3)}
    stream.start_dishes(messages(), path, checkpoint, available_now=True).awaitTermination()
    assert counts(spark, path) == {"x": (5, 17), "y": (2, 7), "z": (1, 3)}


@pytest.mark.parametrize("marks", ["true", "false"])
def test_repeated_batch_changes_nothing(spark, marks):
    """A batch that failed after its stage was written is put in place, not added again."""
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.fileoutputcommitter.marksuccessfuljobs", marks)
    path, staged = work_path(spark, "dishes"), work_path(spark, "staged")
    stored(spark, path)
    delta = rat.rating_delta(
        spark.createDataFrame([("A", "x", "1", 5)], "citystate string, dish string, businessid string, score int")
    )
    for _ in range(3):
        stream.apply_delta(delta, path, staged)
        assert path_exists(spark, f"{staged}-complete")
        assert counts(spark, path) == {"x": (3, 13), "y": (1, 3), "z": (1, 3)}
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def test_late_ratings_are_written_out(spark, rows, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "late"), work_path(spark, "checkpoint")
    for batch in (
        [(day(20), "a,1,A,5"), (day(1), "same batch,1,A,5")],
        [(day(4), "late,1,A,4"), (day(19, 23), "in time,1,A,3"), (day(30), "new,1,A,3")],
        [(day(27), "late too,1,A,2"), (day(4), "later,1,A,1"), (day(29), "in time,1,A,1")],
    ):
        append(batch)
        stream.start_late(messages(), path, checkpoint, available_now=True).awaitTermination()
    assert rows(spark.read.parquet(path).select("dish")) == [("late",), ("late too",), ("later",)]


def test_windows_need_utc(spark, feed):
    _, messages = feed
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError):
            stream.trending_windows(messages())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stream_windows_equal_closed_batch_windows(spark, rows, feed):
    append, messages = feed
    data = [(day(i % 25, i % 23), f"d{i % 3},b{i % 2},C{i % 2}TX,{1 + i % 5},text {i}") for i in range(200)]
    last = max(ts for ts, _ in data)
    append(data[:120])
    append(data[120:])
    path, checkpoint = work_path(spark, "windows"), work_path(spark, "checkpoint")
    windows = stream.trending_windows(messages())
    run = (
        windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    batch = rat.window_ratings(stream.ratings_of(spark.createDataFrame(data, MESSAGES)))
    closed = batch.where(F.col("window_end") <= F.lit(last - dt.timedelta(days=1)))
    got = spark.read.schema(windows.schema).parquet(path)
    assert got.count() > 50
    assert rows(got) == rows(closed.select(*got.columns))


def test_trends_are_replaced_per_city(spark, rows, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "trends"), work_path(spark, "checkpoint")
    sinks.replace_trends(
        spark.createDataFrame(
            [("A", "old", "1", 1, 1, 1.0, ""), ("Z", "kept", "1", 1, 1, 1.0, "")],
            "citystate string, dish string, businessid string, numreviews long, totalscore long, avgrating double, promotext string",
        ),
        path,
    )
    append([(day(0), f"d{i},b,A,{s}") for i, s in enumerate([1, 2, 3, 4, 5]) for _ in range(2)] + [(day(40), "late,b,B,5")])
    stream.start_trends(messages(), path, checkpoint, available_now=True).awaitTermination()
    got = rows(readers.read_trends(spark, path).select("citystate", "dish"))
    assert got == [("A", "d2"), ("A", "d3"), ("A", "d4"), ("Z", "kept")]


def test_malformed_messages_are_set_aside(spark, rows, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "bad"), work_path(spark, "checkpoint")
    append([(day(0), "x,1,A,5"), (day(0), "x,1,A"), (day(0), "x,1,A,five,text")])
    stream.start_quarantine(messages(), path, checkpoint, available_now=True).awaitTermination()
    assert rows(spark.read.parquet(path).select("value")) == [("x,1,A",), ("x,1,A,five,text",)]


def test_every_query_has_an_oracle():
    from __spark_entry__ import queries
    from dishrank.catalog import oracle_sql

    assert set(registry.queries()) - {"sentence_sentiment_ml"} == set(oracle_sql())
    assert registry.queries().keys() <= queries().keys()
