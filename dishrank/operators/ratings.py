"""Rating messages: parse, encode, sum up over windows, merge into dishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import rating_fields, rating_key, rating_value
from ..functions.weights import trending_score
from ..schemas import DISH_KEY
from .ranking import top_k

WINDOW_DAYS = 14
TRENDS_PER_CITY = 3


def parse_messages(messages: DataFrame) -> DataFrame:
    """Fields of each message in ``value`` next to the other columns, with ``valid``."""
    split = messages.withColumn("parts", F.split("value", ","))
    return split.withColumns(rating_fields(F.col("parts"))).drop("parts")


def split_valid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed ratings, and the malformed messages for the quarantine."""
    parsed = parse_messages(messages)
    return parsed.where("valid").drop("valid"), parsed.where("not valid").select(*messages.columns)


def encode_messages(ratings: DataFrame) -> DataFrame:
    """Ratings ``(dish, businessid, citystate, score, promotext)`` as ``(key, value)``."""
    return ratings.select(
        rating_key(F.col("dish"), F.col("businessid")).alias("key"),
        rating_value(*[F.col(c) for c in ["dish", "businessid", "citystate", "score", "promotext"]]).alias("value"),
    )


def daily_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings combined per day and dish; works on a batch and on a stream.

    Every 14-day window is made of whole days, so each rating is added once
    here instead of once for each of the 14 windows it belongs to.
    """
    return ratings.groupBy(F.window("ts", "1 day").alias("day"), *DISH_KEY).agg(
        F.count(F.lit(1)).alias("num"),
        F.sum(F.col("score").cast("long")).alias("score"),
        F.min(F.struct("ts", "promotext")).alias("first"),
    )


def _window_columns(start: Column, end: Column) -> list[Column]:
    return [
        start.cast("timestamp_ntz").alias("window_start"),
        end.cast("timestamp_ntz").alias("window_end"),
        *[F.col(c) for c in DISH_KEY],
        F.col("num"),
        F.col("score"),
        (F.col("score") / F.col("num")).alias("avg"),
        F.col("first.promotext").alias("promotext"),
        trending_score(F.col("num"), F.col("score")).alias("weighted"),
    ]


def windows_of_days(days: DataFrame) -> DataFrame:
    """Sliding 14-day windows of a stream of daily rows, one more each day."""
    span = F.window(F.window_time("day"), f"{WINDOW_DAYS} days", "1 day").alias("window")
    summed = days.groupBy(span, *DISH_KEY).agg(
        F.sum("num").alias("num"), F.sum("score").alias("score"), F.min("first").alias("first")
    )
    return summed.select(*_window_columns(F.col("window.start"), F.col("window.end")))


def changes_of_days(days: DataFrame) -> DataFrame:
    """``(start, num, score, first)`` per dish: what a daily row adds, and takes away 14 days later.

    ``start`` is the number of the first day of the windows from which on the change holds.
    """
    day = F.unix_date(F.col("day.start").cast("date"))

    def change(start: Column, sign: int, first: Column) -> Column:
        return F.struct(
            start.alias("start"), (sign * F.col("num")).alias("num"), (sign * F.col("score")).alias("score"), first.alias("first")
        )

    no_quote = F.when(F.lit(False), F.col("first"))
    both = F.array(change(day - (WINDOW_DAYS - 1), 1, F.col("first")), change(day + 1, -1, no_quote))
    return days.select(*DISH_KEY, F.explode(both).alias("c")).select(*DISH_KEY, "c.*")


def window_ratings(ratings: DataFrame) -> DataFrame:
    """14-day windows of a batch of ratings.

    The daily rows are shuffled by dish; each becomes two changes there, and running
    sums over a dish's changes give what holds from one change to the next. Only the
    result has a row for each window. A dish has two rows per day at most, however often
    it was rated, so no group is large. The quote is the least over the additions of the
    last 14 starts, a frame of few rows. The number of partitions is given because AQE
    would size them by the rows before they are spread over the windows.
    """
    partitions = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    changes = changes_of_days(daily_ratings(ratings).repartition(partitions, *DISH_KEY))
    # Changes of one start are peers: they see the same sums, and all but the last last no day.
    in_order = Window.partitionBy(*DISH_KEY).orderBy("start")
    held = changes.select(
        *DISH_KEY, "start", F.lead("start").over(in_order).alias("next"),
        F.sum("num").over(in_order).alias("num"), F.sum("score").over(in_order).alias("score"),
        F.min("first").over(in_order.rangeBetween(1 - WINDOW_DAYS, 0)).alias("first"),
    ).where("num > 0 and next > start")
    spread = held.withColumn("day", F.explode(F.sequence("start", F.col("next") - 1)))
    return spread.select(*_window_columns(F.date_from_unix_date("day"), F.date_from_unix_date(F.col("day") + WINDOW_DAYS)))


def trending(windows: DataFrame, k: int = TRENDS_PER_CITY) -> DataFrame:
    """Top dishes of each window and city by trending score."""
    order = [F.desc("weighted"), F.asc("dish"), F.asc("businessid")]
    return top_k(windows, ["window_end", "citystate"], order, k, rank="rank")


def latest_trends(trends: DataFrame) -> DataFrame:
    """Each city's rows of the last window in which it was rated.

    A city has at most three rows per window here, so its group stays small.
    """
    last = F.max("window_end").over(Window.partitionBy("citystate"))
    return _trend_rows(trends.withColumn("last", last).where("window_end = last"))


def merge_days(before: DataFrame | None, changed: DataFrame) -> DataFrame:
    """Daily rows of the cities in ``changed``: theirs replaced, days older than a window left out.

    A city has a row per dish and day of 14 days at most, so it is no large group.
    """
    rows = changed
    if before is not None:
        touched = before.join(changed.select("citystate").distinct(), "citystate", "left_semi")
        rows = touched.join(changed.select("day", *DISH_KEY), ["day", *DISH_KEY], "left_anti").unionByName(changed)
    # A city's newest day is combined per task first.
    newest = rows.groupBy("citystate").agg(F.max("day.start").alias("newest"))
    kept = rows.join(newest, "citystate").where(
        F.datediff(F.col("newest").cast("date"), F.col("day.start").cast("date")) < WINDOW_DAYS
    )
    return kept.select(*changed.columns)


def open_trends(days: DataFrame, k: int = TRENDS_PER_CITY) -> DataFrame:
    """Each city's top dishes over its last 14 days, from the rows of ``merge_days``."""
    newest = days.groupBy("citystate").agg(F.max("day.end").alias("newest"))
    summed = days.groupBy(*DISH_KEY).agg(
        F.sum("num").alias("num"), F.sum("score").alias("score"), F.min("first").alias("first")
    )
    start = F.col("newest") - F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    windows = summed.join(newest, "citystate").select(*_window_columns(start, F.col("newest")))
    return _trend_rows(trending(windows, k), "window_end")


def _trend_rows(trends: DataFrame, *more: str) -> DataFrame:
    return trends.select(
        "citystate", "dish", "businessid",
        F.col("num").alias("numreviews"), F.col("score").alias("totalscore"),
        F.col("avg").alias("avgrating"), "promotext", *more,
    )


def rating_delta(ratings: DataFrame) -> DataFrame:
    """New ratings combined per dish, ready to be merged."""
    return ratings.groupBy(*DISH_KEY).agg(
        F.count(F.lit(1)).alias("num"), F.sum(F.col("score").cast("long")).alias("score")
    )


def merge_ratings(dishes: DataFrame, delta: DataFrame) -> DataFrame:
    """Add a delta to stored dishes; only stored dishes are updated, none added.

    Both sides are unique in the full key, so the join has no hot group.
    """
    num = F.col("numreviews") + F.coalesce("d.num", F.lit(0))
    total = F.col("totalscore") + F.coalesce("d.score", F.lit(0))
    joined = dishes.alias("s").join(delta.alias("d"), DISH_KEY, "left")
    updated = {
        "avgrating": F.when(F.col("d.num").isNull(), F.col("avgrating")).otherwise(total / num),
        "numreviews": num,
        "totalscore": total,
    }
    return joined.select(*[
        updated[c].alias(c) if c in updated else (F.col(c) if c in DISH_KEY else F.col(f"s.{c}"))
        for c in dishes.columns
    ])
