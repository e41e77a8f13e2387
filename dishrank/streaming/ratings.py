"""Keep dishes and trends current from a stream of rating messages.

Several queries read the same messages: one adds each new rating once to the stored
dishes, one replaces a city's trends when a 14-day window closes, and one shows the
trends of windows that are still open. Messages that are malformed, or further ahead of
their arrival than ``AHEAD``, pass into none of them but into the quarantine: a single
time in the far future would move the watermark and close every window.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ratings import (
    daily_ratings, latest_trends, merge_days, merge_ratings, open_trends, parse_messages, rating_delta, trending,
    windows_of_days,
)
from ..schemas import DAILY
from ..session import delete_path, path_exists, touch
from ..sources.readers import read_dishes
from ..sources.sinks import replace_dishes, replace_trends
from ..sources.versions import current_version, read_version, vacuum, write_version

LATENESS = "1 day"
# How far ahead of its arrival a message's time may be (clocks of senders differ).
AHEAD = "1 day"
# Versions of a table that stay readable after a batch replaced them.
KEEP_VERSIONS = 3

# Stored dishes are rewritten per city, so they are brought up to date once a
# day, like the windows slide. Windows close once a day, so their state is committed
# once a minute and not more often.
DISHES_EVERY = "1 day"
TRENDS_EVERY = "1 minute"
QUARANTINE_EVERY = "1 minute"

# Window state grows with dishes and days, so it is kept on disk, not on the heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def too_far_ahead(messages: DataFrame, ahead: str = AHEAD) -> Column:
    """Whether a message's ``ts`` is more than ``ahead`` after it arrived.

    A column ``arrived`` says when it did; without one the time of the batch holds.
    """
    arrived = F.col("arrived").cast("timestamp") if "arrived" in messages.columns else F.current_timestamp()
    return F.coalesce(F.col("ts").cast("timestamp") > arrived + F.expr(f"INTERVAL {ahead}"), F.lit(False))


def ratings_of(messages: DataFrame, ahead: str = AHEAD) -> DataFrame:
    """Valid ratings of a message stream ``(value, ts, ...)``, times far ahead left out."""
    return parse_messages(messages.where(~too_far_ahead(messages, ahead))).where("valid").drop("valid")


def refused(messages: DataFrame, ahead: str = AHEAD) -> DataFrame:
    """Messages for the quarantine output: malformed, or far ahead of their arrival."""
    parsed = parse_messages(messages)
    return parsed.where(~F.col("valid") | too_far_ahead(parsed, ahead)).select(*messages.columns)


def days_of(messages: DataFrame, lateness: str = LATENESS, ahead: str = AHEAD) -> DataFrame:
    """Daily rows per dish, kept in state until the watermark has passed the day."""
    if messages.sparkSession.conf.get("spark.sql.session.timeZone") != "UTC":
        raise ValueError("windows begin at midnight UTC: set spark.sql.session.timeZone to UTC")
    timed = ratings_of(messages, ahead).withColumn("ts", F.col("ts").cast("timestamp"))
    return daily_ratings(timed.withWatermark("ts", lateness))


def trending_windows(messages: DataFrame, lateness: str = LATENESS, ahead: str = AHEAD) -> DataFrame:
    """Closed 14-day windows in append mode.

    Chained windows: the state holds a row per dish and day, and only a closed
    day's row is added to the 14 windows it belongs to.
    """
    return windows_of_days(days_of(messages, lateness, ahead))


def use_disk_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _trigger(available_now: bool, every: str) -> dict:
    return {"availableNow": True} if available_now else {"processingTime": every}


def _start(rows: DataFrame, checkpoint: str, available_now: bool, every: str, step, mode: str = "append") -> StreamingQuery:
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.trigger(**_trigger(available_now, every)).foreachBatch(step).start()


def _version(checkpoint: str, batch_id: int) -> str:
    """Name of what a batch writes: the same when it runs again, another for another query."""
    return f"{batch_id:012d}-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"


def apply_delta(delta: DataFrame, dishes_path: str, staged_path: str) -> None:
    """Merge a delta into the dishes table; running it again changes nothing.

    The merged cities are written to ``staged_path`` first and then become a version of
    the table named by that path. If the second step is cut short, a repeat finds the
    finished stage and goes on from there, so no rating is ever added twice; readers see
    the table before or after the delta.
    """
    spark = delta.sparkSession
    marker = f"{staged_path.rstrip('/')}-complete"
    if not path_exists(spark, marker):
        cities = delta.select("citystate").distinct()
        dishes = read_dishes(spark, dishes_path)
        # The join prunes the folders that are read to the cities of the delta.
        touched = dishes.join(cities, "citystate", "left_semi")
        merge_ratings(touched, delta).write.mode("overwrite").parquet(staged_path)
        touch(spark, marker)
    version = hashlib.sha256(staged_path.encode()).hexdigest()[:32]
    replace_dishes(read_dishes(spark, staged_path), dishes_path, version)
    vacuum(spark, dishes_path, "citystate", KEEP_VERSIONS)


def start_dishes(
    messages: DataFrame, dishes_path: str, checkpoint: str, available_now: bool = False, every: str = DISHES_EVERY
) -> StreamingQuery:
    """Add every new rating to the stored dishes."""
    staged = f"{checkpoint}/staged"

    def step(batch: DataFrame, batch_id: int) -> None:
        delta = rating_delta(batch).persist()
        try:
            apply_delta(delta, dishes_path, f"{staged}/batch-{batch_id}")
        finally:
            delta.unpersist()
        # A batch only starts after the one before was committed.
        for old in (f"{staged}/batch-{batch_id - 1}", f"{staged}/batch-{batch_id - 1}-complete"):
            delete_path(batch.sparkSession, old)

    return _start(ratings_of(messages), checkpoint, available_now, every, step)


def start_trends(
    messages: DataFrame, trends_path: str, checkpoint: str, available_now: bool = False, every: str = TRENDS_EVERY,
    lateness: str = LATENESS,
) -> StreamingQuery:
    """Replace a city's trends whenever windows with its ratings close.

    Ratings of a day that ended ``lateness`` before the latest one seen are too late
    for the windows; ``start_late`` writes them out.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        replace_trends(latest_trends(trending(batch)), trends_path, _version(checkpoint, batch_id))
        vacuum(batch.sparkSession, trends_path, "citystate", KEEP_VERSIONS)

    use_disk_state(messages.sparkSession)
    return _start(trending_windows(messages, lateness), checkpoint, available_now, every, step)


def start_live_trends(
    messages: DataFrame, trends_path: str, days_path: str, checkpoint: str, available_now: bool = False,
    every: str = TRENDS_EVERY, lateness: str = LATENESS,
) -> StreamingQuery:
    """Show each city's trends of the window that ends with its newest day, while it is open.

    The daily rows that a trigger changed come out of the state at once (update mode) and
    are merged into a table of the last 14 days of each city; of the cities they touch the
    trends are ranked anew. Both tables change by versions named after the batch: run
    again, a batch finds what it wrote, and a reader sees all cities before or after it.
    When a window closes, its row in ``start_trends`` is the last one shown here.
    """
    key = "citystate"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, _version(checkpoint, batch_id)
        # Written first: the steps below read it several times, the state gives it once.
        batch.select(*DAILY.names).write.mode("overwrite").parquet(f"{checkpoint}/changed/{batch_id}")
        changed = spark.read.schema(DAILY).parquet(f"{checkpoint}/changed/{batch_id}")
        if changed.isEmpty():
            return  # a batch that only moves the watermark
        before = None
        if current_version(spark, days_path) is not None:
            before = read_version(spark, days_path, DAILY, key)
        write_version(merge_days(before, changed), days_path, version, key, ["dish", "businessid"])
        days = read_version(spark, days_path, DAILY, key).join(changed.select(key).distinct(), key, "left_semi")
        write_version(open_trends(days), trends_path, version, key, ["dish", "businessid"])
        for path in (days_path, trends_path):
            vacuum(spark, path, key, KEEP_VERSIONS)
        for old in range(batch_id - 2, batch_id):
            delete_path(spark, f"{checkpoint}/changed/{old}")

    use_disk_state(messages.sparkSession)
    return _start(days_of(messages, lateness), checkpoint, available_now, every, step, mode="update")


def start_quarantine(
    messages: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str = QUARANTINE_EVERY
) -> StreamingQuery:
    """Append the messages that no other query takes to ``path``."""
    writer = refused(messages).writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(**_trigger(available_now, every)).start()


def late_ratings(batch: DataFrame, latest, lateness: str) -> DataFrame:
    """Ratings of a batch whose day was closed by what came before ``latest``."""
    ends = F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")
    return batch.where(ends <= F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {lateness}"))


def start_late(
    messages: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str = TRENDS_EVERY,
    lateness: str = LATENESS,
) -> StreamingQuery:
    """Write the ratings that come too late for the trends below ``path``.

    The latest time of all batches before is kept beside the checkpoint, one small
    table per batch, so a batch that is run again gives the same rows.
    """
    seen = f"{checkpoint}/latest"

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        before = f"{seen}/batch-{batch_id - 1}"
        latest = spark.read.parquet(before).first().ts if path_exists(spark, before) else None
        if latest is not None:
            out = late_ratings(timed, latest, lateness).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
            out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        newest = timed.agg(F.greatest(F.max("ts"), F.lit(latest).cast("timestamp")).alias("ts"))
        newest.write.mode("overwrite").parquet(f"{seen}/batch-{batch_id}")
        delete_path(spark, f"{seen}/batch-{batch_id - 2}")

    return _start(ratings_of(messages), checkpoint, available_now, every, step)
