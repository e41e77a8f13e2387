"""Fixed schemas of inputs and published tables."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("date", T.StringType()),
])

TIP = REVIEW

BUSINESS = T.StructType([
    T.StructField("business_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("full_address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
])

DISHES = T.StructType([
    T.StructField("dish", T.StringType()),
    T.StructField("businessid", T.StringType()),
    T.StructField("avgrating", T.DoubleType()),
    T.StructField("numreviews", T.LongType()),
    T.StructField("totalscore", T.LongType()),
    T.StructField("promotext", T.StringType()),
    T.StructField("promoscore", T.IntegerType()),
    T.StructField("citystate", T.StringType()),
])

BUSINESSES = T.StructType([
    T.StructField("businessid", T.StringType()),
    T.StructField("citystate", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("full_address", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("stars", T.DoubleType()),
    T.StructField("reviewcount", T.LongType()),
])

TRENDS = T.StructType([
    T.StructField("dish", T.StringType()),
    T.StructField("businessid", T.StringType()),
    T.StructField("numreviews", T.LongType()),
    T.StructField("totalscore", T.LongType()),
    T.StructField("avgrating", T.DoubleType()),
    T.StructField("promotext", T.StringType()),
    T.StructField("citystate", T.StringType()),
])

LIVE_TRENDS = T.StructType([*TRENDS.fields[:-1], T.StructField("window_end", T.TimestampNTZType()), TRENDS.fields[-1]])

# Ratings of a dish on one day, summed up.
DAILY = T.StructType([
    T.StructField("day", T.StructType([T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType())])),
    T.StructField("dish", T.StringType()),
    T.StructField("businessid", T.StringType()),
    T.StructField("num", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("first", T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("promotext", T.StringType())])),
    T.StructField("citystate", T.StringType()),
])

COMPLETION = T.StructType([
    T.StructField("result_list", T.ArrayType(T.StructType([
        T.StructField("completion_list", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("value", T.StringType()),
        ]))),
    ]))),
])

# Field of a parsed response that holds its text where it is no such document.
CORRUPT = "_corrupt"

DISH_KEY = ["citystate", "dish", "businessid"]
BUSINESS_KEY = ["businessid", "citystate"]
