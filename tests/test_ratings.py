import datetime as dt

from pyspark.sql import functions as F

from dishrank.operators import ratings as rat
from dishrank.schemas import DISH_KEY

MESSAGES = [
    ("taco,b1,AustinTX", False, None),
    ("taco,b1,AustinTX,4", True, ""),
    ("taco,b1,AustinTX,4,great", True, "great"),
    ("taco,b1,AustinTX,4,great, really", True, "great"),
    ("taco,b1,AustinTX,four,great", False, None),
    ("taco,b1,AustinTX,4.0,great", False, None),
    ("taco,b1,AustinTX, 4,great", False, None),
    ("taco,b1,AustinTX,,great", False, None),
    ("taco,b1,AustinTX,4,", True, ""),
    ("taco,b1,AustinTX,99999999999,great", False, None),
    ("", False, None),
]


def test_message_fields(spark):
    frame = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)], "id int, value string")
    got = {r.id: r for r in rat.parse_messages(frame).collect()}
    for i, (_, valid, text) in enumerate(MESSAGES):
        assert got[i].valid is valid
        if valid:
            assert (got[i].dish, got[i].businessid, got[i].citystate, got[i].score) == ("taco", "b1", "AustinTX", 4)
            assert got[i].promotext == text
    good, bad = rat.split_valid(frame)
    assert good.count() == 4 and bad.count() == len(MESSAGES) - 4 and bad.columns == frame.columns


def test_encoding_is_undone_by_parsing(spark, rows):
    ratings = spark.createDataFrame(
        [("taco", "b1", "AustinTX", 4, "good"), ("pho", "b2", "AustinTX", 5, "")],
        "dish string, businessid string, citystate string, score int, promotext string",
    )
    messages = rat.encode_messages(ratings)
    assert rows(messages) == [("phob2", "pho,b2,AustinTX,5,"), ("tacob1", "taco,b1,AustinTX,4,good")]
    parsed = rat.parse_messages(messages).select("dish", "businessid", "citystate", "score", "promotext")
    assert rows(parsed) == rows(ratings)
    without = rat.encode_messages(ratings.withColumn("promotext", F.lit(None).cast("string")))
    assert "taco,b1,AustinTX,4" in [r.value for r in without.collect()]


def ratings_frame(spark, data):
    return spark.createDataFrame(
        data, "ts timestamp_ntz, citystate string, dish string, businessid string, score int, promotext string"
    )


def brute_windows(data):
    """Windows by adding every rating to each of its 14 windows."""
    out = {}
    for ts, city, dish, business, score, text in data:
        first = dt.datetime.combine(ts.date(), dt.time())
        for back in range(14):
            start = first - dt.timedelta(days=back)
            out.setdefault((start, city, dish, business), []).append((ts, text, score))
    weight = {1: 0.4, 2: 0.4, 3: 0.4, 4: 0.4, 5: 0.5, 6: 0.6, 7: 0.7, 8: 0.8, 9: 0.9}
    result = []
    for (start, *key), hits in out.items():
        n, total = len(hits), sum(h[2] for h in hits)
        weighted = 0.0 if n == 1 else total * weight.get(n, 1.0)
        result.append((start, start + dt.timedelta(days=14), *key, n, total, total / n, min(hits)[1], weighted))
    return sorted(result)


def test_windows_match_brute_force(spark, rows):
    data = [
        (dt.datetime(2024, 1, 1 + i % 20, i % 24, i % 60), f"C{i % 2}TX", f"d{i % 3}", f"b{i % 4}", 1 + i % 5, f"t{i}")
        for i in range(150)
    ] + [(dt.datetime(2024, 1, 5), "C0TX", "d0", "b0", 3, "midnight")]
    windows = rat.window_ratings(ratings_frame(spark, data))
    assert rows(windows) == brute_windows(data)

    ranked = {}
    for row in brute_windows(data):
        ranked.setdefault((row[1], row[2]), []).append((-row[-1], row[3], row[4]))
    expected = sorted((end, city, i + 1, d, b) for (end, city), r in ranked.items() for i, (_, d, b) in enumerate(sorted(r)[:3]))
    got = rat.trending(windows).select("window_end", "citystate", "rank", "dish", "businessid")
    assert rows(got) == expected


def test_latest_trends_take_each_citys_last_window(spark, rows):
    day = dt.datetime(2024, 1, 1)
    data = [(day, "A", "x", "1", 5, "a")] * 2 + [(day + dt.timedelta(days=3), "B", "y", "2", 4, "b")] * 2
    trends = rat.latest_trends(rat.trending(rat.window_ratings(ratings_frame(spark, data))))
    assert rows(trends) == [("A", "x", "1", 2, 10, 5.0, "a"), ("B", "y", "2", 2, 8, 4.0, "b")]


def test_hot_city_sends_three_rows_per_task(spark):
    """The plan limits the rows of a city and window before they are shuffled."""
    data = [(dt.datetime(2024, 1, 1), "Hot", f"d{i}", "b", 1 + i % 5, "t") for i in range(50)]
    plan = rat.trending(rat.window_ratings(ratings_frame(spark, data)))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_merge_updates_stored_dishes_only(spark, rows):
    stored = spark.createDataFrame(
        [("A", "x", "1", 4.0, 2, 8, "keep", 5), ("A", "y", "1", 3.0, 1, 3, "same", 3)],
        "citystate string, dish string, businessid string, avgrating double, numreviews long, totalscore long,"
        " promotext string, promoscore int",
    )
    delta = rat.rating_delta(spark.createDataFrame(
        [("A", "x", "1", 1), ("A", "x", "1", 3), ("A", "new", "1", 5), ("B", "x", "1", 5)],
        "citystate string, dish string, businessid string, score int",
    ))
    merged = rat.merge_ratings(stored, delta)
    assert merged.columns == stored.columns
    assert rows(merged) == [("A", "x", "1", 3.0, 4, 12, "keep", 5), ("A", "y", "1", 3.0, 1, 3, "same", 3)]
    assert DISH_KEY == ["citystate", "dish", "businessid"]
