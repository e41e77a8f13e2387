import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from dishrank.operators import ratings as rat
from dishrank.operators.sampling import exact_sample
from dishrank.plans import harvest, serving
from dishrank.session import list_names, work_path
from dishrank.sources import readers, sinks, versions
from dishrank.streaming import ratings as stream

MESSAGES = "ts timestamp_ntz, value string"
DISHES = "dish string, businessid string, avgrating double, numreviews long, totalscore long, promotext string, promoscore int, citystate string"


def day(n, hour=1):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


@pytest.fixture
def feed(spark):
    path = work_path(spark, "feed")

    def append(data):
        spark.createDataFrame(data, MESSAGES).coalesce(1).write.mode("append").parquet(path)

    append([])
    schema = spark.createDataFrame([], MESSAGES).schema
    return append, lambda: readers.read_parquet_stream(spark, path, schema)


# Point lookups.


def scanned(df):
    """Rows that the scans of a finished query gave."""
    df.collect()

    def scans(plan):
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if name == "FileSourceScanExec":
            return [plan.metrics().apply("numOutputRows").value()]
        children = plan.children()
        return [n for i in range(children.size()) for n in scans(children.apply(i))]

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_a_lookup_by_business_skips_what_ranges_cannot(spark):
    rows = spark.range(40_000, numPartitions=1).select(
        F.format_string("dish %05d", F.col("id")).alias("dish"),
        # Every row group holds the whole range of businesses, each business is in few of them.
        F.md5((F.col("id") % 20_000).cast("string").cast("binary")).alias("businessid"),
        F.lit(4.0).alias("avgrating"), F.lit(1).cast("long").alias("numreviews"), F.lit(4).cast("long").alias("totalscore"),
        F.md5(F.col("id").cast("string").cast("binary")).alias("promotext"), F.lit(4).alias("promoscore"), F.lit("A").alias("citystate"),
    )
    small = {"parquet.block.size": "262144", "parquet.enable.dictionary": "false"}
    read = {}
    for name, sought in (("plain", ()), ("bloom", sinks.SOUGHT)):
        path = work_path(spark, "dishes")
        versions.write_version(rows, path, name, "citystate", ["dish", "businessid"], sought=sought, **small)
        one = serving.dishes_of_business(readers.read_dishes(spark, path), rows.first().businessid)
        assert sorted(r.dish for r in one.collect()) == ["dish 00000", "dish 20000"]
        read[name] = scanned(one)
    assert read["plain"] == 40_000 and read["bloom"] <= 20_000


def test_every_place_of_a_dish(spark, rows):
    path, places = work_path(spark, "dishes"), work_path(spark, "places")
    sinks.publish_dishes(spark.createDataFrame(
        [("taco", "1", 4.0, 2, 8, "q", 5, "A"), ("taco", "2", 2.0, 2, 4, "q", 2, "B"), ("pho", "1", 4.0, 2, 8, "q", 5, "A")], DISHES
    ), path)
    sinks.publish_businesses(spark.createDataFrame(
        [("1", "A", "One", "x", "a", "b", 4.0, 3), ("2", "B", "Two", "x", "a", "b", 4.0, 3)], readers.schemas.BUSINESSES
    ), places)
    found = serving.places_of_dish(readers.read_dishes(spark, path), readers.read_published_businesses(spark, places), "taco")
    assert rows(found.select("citystate", "name", "avgrating")) == [("A", "One", "4.0"), ("B", "Two", "2.0")]


# Kafka ends: no server here, so what is handed to Spark is looked at.


class Recorded:
    """Stands for a reader or writer and notes what it is asked for."""

    def __init__(self, result=None):
        self.result, self.asked = result, {}

    def format(self, name):
        self.asked["format"] = name
        return self

    def options(self, **options):
        self.asked.update(options)
        return self

    def load(self):
        return self.result

    def save(self):
        self.asked["saved"] = True


def test_kafka_source_asks_for_the_topic_and_gives_text(spark, rows):
    records = spark.createDataFrame(
        [(bytearray(b"k"), bytearray("taco,1,A,5,gut é".encode()), "newreview", 0, 7, day(0))],
        "key binary, value binary, topic string, partition int, offset long, timestamp timestamp",
    )

    class Session:
        readStream = Recorded(records)

    got = readers.read_rating_stream(Session, "a:9092,b:9092", max_offsets=500, starting="earliest")
    assert Session.readStream.asked == {
        "format": "kafka", "kafka.bootstrap.servers": "a:9092,b:9092", "subscribe": "newreview", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "500",
    }
    assert got.dtypes == [("key", "string"), ("value", "string"), ("ts", "timestamp")]
    assert rows(got) == [("k", "taco,1,A,5,gut é", day(0))]
    assert readers.kafka_options("a:1", "t") == {"kafka.bootstrap.servers": "a:1", "subscribe": "t", "startingOffsets": "latest"}
    # What comes from the source goes through the whole message path.
    assert rows(stream.ratings_of(got).select("dish", "score")) == [("taco", 5)]


def test_kafka_sink_sends_key_and_value(spark, monkeypatch):
    ratings = spark.createDataFrame([("taco", "1", "A", 5, "good")], "dish string, businessid string, citystate string, score int, promotext string")
    messages, asked, sent = rat.encode_messages(ratings).withColumn("other", F.lit(1)), Recorded(), []

    def write(self):
        sent.append((self.columns, [tuple(r) for r in self.collect()]))
        return asked

    monkeypatch.setattr(type(messages), "write", property(write))
    sinks.write_kafka(messages, "a:9092", "ratings")
    assert asked.asked == {"format": "kafka", "kafka.bootstrap.servers": "a:9092", "topic": "ratings", "saved": True}
    assert sent == [(["key", "value"], [("taco1", "taco,1,A,5,good")])]


# Clocks, triggers and open windows.


def test_times_far_ahead_are_refused(spark, rows):
    now = dt.datetime(2024, 3, 1)
    frame = spark.createDataFrame([
        (now + dt.timedelta(days=d), v, a) for d, v, a in [
            (0, "now,1,A,5", now), (0.5, "skewed,1,A,5", now), (2, "ahead,1,A,5", now), (36500, "far,1,A,5", now),
            (-400, "late,1,A,5", now), (0, "broken", now), (2, "arrived late,1,A,5", now + dt.timedelta(days=3)),
        ]
    ] + [(None, "no time,1,A,5", now)], "ts timestamp_ntz, value string, arrived timestamp_ntz")
    assert [r.dish for r in stream.ratings_of(frame).orderBy("dish").collect()] == ["arrived late", "late", "no time", "now", "skewed"]
    assert [r.value for r in stream.refused(frame).orderBy("value").collect()] == ["ahead,1,A,5", "broken", "far,1,A,5"]
    assert stream.refused(frame).columns == frame.columns
    assert stream.ratings_of(frame, ahead="3 days").count() == 6
    # Without arrival times the clock of the batch holds.
    plain = frame.drop("arrived")
    assert [r.value for r in stream.refused(plain).orderBy("value").collect()] == ["broken", "far,1,A,5"]


def test_one_bad_clock_closes_no_window(spark, rows, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "trends"), work_path(spark, "checkpoint")
    append([(day(0), "x,1,A,5"), (day(0), "x,1,A,4"), (dt.datetime(2100, 1, 1), "bad,1,A,5")])
    stream.start_trends(messages(), path, checkpoint, available_now=True).awaitTermination()
    append([(day(1), "x,1,A,3"), (day(20), "y,1,A,3")])
    stream.start_trends(messages(), path, checkpoint, available_now=True).awaitTermination()
    # Had the year 2100 moved the watermark, the second batch would have been late.
    got = rows(readers.read_trends(spark, path).select("dish", "numreviews", "totalscore"))
    assert got == [("x", 1, 3)]


def test_trends_show_before_a_window_closes(spark, rows, feed):
    append, messages = feed
    paths = [work_path(spark, n) for n in ("live", "days", "checkpoint")]

    def trigger(data):
        append(data)
        stream.start_live_trends(messages(), *paths, available_now=True).awaitTermination()
        return rows(readers.read_live_trends(spark, paths[0]).select("citystate", "dish", "numreviews", "totalscore", "promotext", "window_end"))

    first = [(day(0), "x,1,A,5,hi"), (day(0, 2), "x,1,A,4"), (day(0), "y,2,B,3"), (day(0), "y,2,B,3")]
    # Windows that end after the first day and are still open show at once.
    assert trigger(first) == [("A", "x", 2, 9, "hi", day(1, 0)), ("B", "y", 2, 6, "", day(1, 0))]
    second = [(day(0, 3), "x,1,A,3"), (day(3), "z,1,A,5"), (day(3, 4), "z,1,A,5"), (day(3), "z,1,A,1")]
    assert trigger(second) == [("A", "x", 3, 12, "hi", day(4, 0)), ("A", "z", 3, 11, "", day(4, 0)), ("B", "y", 2, 6, "", day(1, 0))]
    third = [(day(16), "w,1,A,4"), (day(16), "w,1,A,4")]
    assert trigger(third) == [("A", "w", 2, 8, "", day(17, 0)), ("A", "z", 3, 11, "", day(17, 0)), ("B", "y", 2, 6, "", day(1, 0))]

    # The last ones shown are the rows that the closed windows of these ends have.
    data = first + second + third
    batch = rat.trending(rat.window_ratings(stream.ratings_of(spark.createDataFrame(data, MESSAGES))))
    live = readers.read_live_trends(spark, paths[0])
    final = batch.join(live.select("citystate", "window_end").distinct(), ["citystate", "window_end"])
    columns = ["citystate", "dish", "businessid", "promotext", "window_end"]
    assert rows(live.select(*columns, "numreviews", "totalscore", "avgrating")) == rows(final.select(*columns, "num", "score", "avg"))


def test_a_batch_of_live_trends_may_run_again(spark, rows):
    """Days are merged once, also where a batch died between its two tables."""
    days = rat.daily_ratings(stream.ratings_of(spark.createDataFrame(
        [(day(0), "x,1,A,5"), (day(0), "x,1,A,4"), (day(20), "x,1,A,1")], MESSAGES
    )).withColumn("ts", F.col("ts").cast("timestamp")))
    merged = rat.merge_days(None, days)
    assert rows(rat.merge_days(merged, days).select("num", "score")) == rows(merged.select("num", "score")) == [(1, 1)]


def test_a_processing_time_trigger_takes_what_comes(spark, feed):
    append, messages = feed
    path, checkpoint = work_path(spark, "bad"), work_path(spark, "checkpoint")
    run = stream.start_quarantine(messages(), path, checkpoint, every="1 second")
    try:
        for n in range(2):
            append([(day(n), f"broken {n}")])
            end = time.time() + 60
            while time.time() < end and spark.read.schema(MESSAGES).parquet(path).count() <= n:
                time.sleep(0.2)
        assert {r.value for r in spark.read.schema(MESSAGES).parquet(path).collect()} == {"broken 0", "broken 1"}
        # Two batches at least, one after the other.
        assert run.lastProgress["batchId"] >= 1 and run.isActive
    finally:
        run.stop()
    assert stream._trigger(False, "1 second") == {"processingTime": "1 second"}


def test_old_versions_of_a_stream_are_deleted(spark, feed):
    append, messages = feed
    paths = [work_path(spark, n) for n in ("live", "days", "checkpoint")]
    for n in range(6):
        append([(day(n), "x,1,A,5")])
        stream.start_live_trends(messages(), *paths, available_now=True).awaitTermination()
    assert len(versions.switches(spark, paths[0])) == stream.KEEP_VERSIONS
    assert len([v for v in list_names(spark, f"{paths[0]}/data") if "=" in v]) == stream.KEEP_VERSIONS


# Responses and samples.


def test_responses_that_cannot_be_used_are_set_aside(spark, rows):
    good = '{"result_list": [{"completion_list": [{"type": "dish", "value": "taco"}]}]}'
    values = [good, good[:30], "", "  ", None, "[]", '"text"', '{"status": "error"}', '{"result_list": []}', '{"result_list": null}', "{}}", good + " "]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")
    terms, refused = readers.split_completions(frame)
    assert rows(terms) == [("dish", "taco")] * 2
    reasons = {r.id: r.reason for r in refused.collect()}
    assert {k: v for k, v in reasons.items() if k in (1, 2, 3, 4, 7, 9)} == {
        1: "malformed", 2: "empty", 3: "empty", 4: "empty", 7: "no results", 9: "no results",
    }
    assert not {0, 8, 11} & set(reasons) and {5, 6} <= set(reasons)
    assert rows(readers.parse_completions(frame)) == rows(terms)
    path, aside = work_path(spark, "terms"), work_path(spark, "aside")
    harvest.harvest(frame, path, aside)
    assert spark.read.json(aside).count() == len(reasons) and [r.value for r in spark.read.text(path).collect()] == ["dish,taco"]


def test_samples_have_exactly_so_many_rows(spark, rows):
    frame = spark.createDataFrame([(i % 500, f"v{i}") for i in range(2000)], "k int, v string")
    for n in (0, 1, 20, 777, 1999, 2000, 5000):
        picked = [rows(exact_sample(frame.repartition(p), ["k", "v"], n)) for p in (1, 7)]
        assert picked[0] == picked[1] and len(picked[0]) == min(n, 2000) and len(set(picked[0])) == len(picked[0])
    assert rows(exact_sample(frame, ["k"], 20)) != rows(exact_sample(frame, ["k"], 20, seed=1))
    # Rows of one key are settled, null keys too; columns are those of the input.
    same = spark.createDataFrame([(None, i) for i in range(50)] + [(1, i) for i in range(50)], "k int, v int")
    picked = [sorted(exact_sample(f, ["k"], 60).collect(), key=str) for f in (same, same.repartition(5))]
    assert picked[0] == picked[1] and len(picked[0]) == 60
    assert exact_sample(same, ["k"], 10).columns == same.columns and exact_sample(same.limit(0), ["k"], 10).count() == 0
    # Every row is about as likely as any other.
    hits = [0] * 20
    for seed in range(200):
        for r in exact_sample(spark.range(20), ["id"], 5, seed).collect() if seed < 12 else []:
            hits[r.id] += 1
    assert sum(hits) == 60 and max(hits) <= 9
