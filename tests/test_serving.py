import json

import pytest
from pyspark.sql import functions as F

from dishrank import schemas
from dishrank.operators.ranking import top_k
from dishrank.operators.sampling import sample_by_key
from dishrank.plans import harvest, serving
from dishrank.session import work_path
from dishrank.sources import readers, sinks

ADDRESS = "3419 Toringdon Way\nBallantyne\nCharlotte, NC 28277"
DISHES = [
    ("CharlotteNC", "burger", "pub", 5.0, 1, "Try the blackened burger...so good!"),
    ("CharlotteNC", "salad", "pub", 5.0, 1, "They have a really nice side salad."),
    ("CharlotteNC", "dip", "pub", 4.0, 2, "Great wings and bleu cheese dipping sauce."),
    ("CharlotteNC", "fries", "pub", 3.4, 600, "Below the floor."),
    ("CharlotteNC", "slider", "fair", 4.6, 80, "Sliders!"),
    ("CharlotteNC", "burger", "fair", 5.0, 1, "Some delicious burgers."),
    ("CharlotteNC", "burger", "diner", 3.5, 1000, "Solid burger."),
    ("CharlotteNC", "burger", "closed", 4.9, 300, "No such business row."),
    ("AustinTX", "burger", "grill", 3.6, 5, "Smoky burger."),
]
BUSINESSES = [
    ("CharlotteNC", "pub", ADDRESS, "BV Pub", 28, 4.5),
    ("CharlotteNC", "fair", "217 Southside Dr\\nCharlotte, NC", "The Fair", 7, 4.5),
    ("CharlotteNC", "diner", "1 Main St", "Diner", 100, 3.0),
    ("AustinTX", "grill", "2 Main St", "Grill", 50, 4.0),
]
DICTIONARY = [("burger", "burger"), ("burger", "slider"), ("salad", "salad"), ("side", "fries"), ("dip", "dip")]


@pytest.fixture
def dishes(spark):
    return spark.createDataFrame(
        DISHES, "citystate string, dish string, businessid string, avgrating double, numreviews long, promotext string"
    )


@pytest.fixture
def businesses(spark):
    return spark.createDataFrame(
        BUSINESSES,
        "citystate string, businessid string, full_address string, name string, reviewcount long, stars double",
    )


@pytest.fixture
def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "category string, item string")


def test_restaurant_response(dishes, businesses):
    got = serving.restaurant_one(dishes, businesses, "Charlotte, NC", "pub")
    assert got.columns == serving.FIELDS
    assert [tuple(r) for r in got.collect()] == [
        ("burger", "pub", "5.0", 1, "Try the blackened burger...so good!", ADDRESS, "BV Pub", 28, 4.5),
        ("salad", "pub", "5.0", 1, "They have a really nice side salad.", ADDRESS, "BV Pub", 28, 4.5),
        ("dip", "pub", "4.0", 2, "Great wings and bleu cheese dipping sauce.", ADDRESS, "BV Pub", 28, 4.5),
    ]


def test_search_response(dishes, businesses, dictionary):
    """Many ratings outweigh a single five; a dish without a business row takes its place but is not shown."""
    got = serving.search_one(dishes, businesses, dictionary, "Charlotte, NC", "burger")
    assert [(r.dish, r.businessid, r.avgrating) for r in got.collect()] == [
        ("burger", "diner", "3.5"), ("slider", "fair", "4.6"), ("burger", "fair", "5.0"),
    ]
    assert got.where("businessid = 'fair'").first().address == "217 Southside Dr Charlotte, NC"
    assert serving.search_one(dishes, businesses, dictionary, "CharlotteNC", "slider").count() == 0


def test_all_at_once_equals_one_by_one(spark, rows, dishes, businesses, dictionary):
    everything = serving.search_all(dishes, businesses, dictionary)
    for city in ("CharlotteNC", "AustinTX"):
        for term in ("burger", "salad", "side", "dip"):
            one = serving.search_one(dishes, businesses, dictionary, city, term)
            same = everything.where((F.col("citystate") == city) & (F.col("term") == term)).select(*serving.FIELDS)
            assert rows(one) == rows(same)
    asked = spark.createDataFrame(
        [("Charlotte, NC", "burger"), ("CharlotteNC", "burger"), ("Austin, TX", "nothing")], "city string, term string"
    )
    some = serving.search_requests(asked, dishes, businesses, dictionary)
    assert rows(some) == rows(everything.where("citystate = 'CharlotteNC' and term = 'burger'"))
    pub = serving.restaurant_all(dishes, businesses).where("businessid = 'pub'").select(*serving.FIELDS)
    assert rows(pub) == rows(serving.restaurant_one(dishes, businesses, "CharlotteNC", "pub"))


def test_city_response_keeps_key_order(spark, rows, businesses):
    trends = spark.createDataFrame(
        [("CharlotteNC", d, "pub", 1, 5, r, "t") for d, r in [("taco", 5.0), ("pie", 1.0), ("ale", 2.0), ("zest", 5.0)]],
        "citystate string, dish string, businessid string, numreviews long, totalscore long, avgrating double, promotext string",
    )
    got = serving.city_one(trends, businesses, "Charlotte, NC").collect()
    assert [(r.dish, r.avgrating) for r in got] == [("ale", "2.0"), ("pie", "1.0"), ("taco", "5.0")]
    every = serving.city_all(trends, businesses).orderBy("rank").select(*serving.FIELDS)
    assert [tuple(r) for r in every.collect()] == [tuple(r) for r in got]


def test_json_rows(dishes, businesses):
    row = serving.as_json(serving.restaurant_all(dishes, businesses)).where("citystate = 'AustinTX'").first()
    assert json.loads(row.json) == {
        "dish": "burger", "businessid": "grill", "avgrating": "3.6", "dishnumreviews": 5, "promotext": "Smoky burger.",
        "address": "2 Main St", "name": "Grill", "restaurantnumreviews": 50, "stars": 4.0,
    }


def test_cities(dishes):
    assert [r.label for r in serving.list_cities(dishes).collect()] == ["Austin, TX", "Charlotte, NC"]


def test_ranking_limits_before_the_shuffle(dishes, businesses, dictionary):
    plan = serving.search_all(dishes, businesses, dictionary)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Partial")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_of_a_hot_group(spark, rows):
    frame = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    got = rows(top_k(frame, ["g"], [F.desc("id")], 2))
    assert got == [("cold", 2994), ("cold", 2997), ("hot", 2998), ("hot", 2999)]


def test_partition_replacement(spark, rows):
    path = work_path(spark, "trends")

    def trends(data):
        return spark.createDataFrame(
            data,
            "citystate string, dish string, businessid string, numreviews long, totalscore long, avgrating double, promotext string",
        )

    sinks.replace_trends(trends([("A", "x", "1", 1, 5, 5.0, "t"), ("B", "y", "1", 1, 5, 5.0, "t")]), path)
    sinks.replace_trends(trends([("A", "z", "2", 2, 8, 4.0, "t")]), path)
    assert rows(readers.read_trends(spark, path).select("citystate", "dish")) == [("A", "z"), ("B", "y")]


def test_lookup_reads_one_folder(spark, dishes):
    path = work_path(spark, "dishes")
    sinks.publish_dishes(dishes.withColumn("totalscore", F.lit(1)).withColumn("promoscore", F.lit(1)), path)
    wanted = readers.read_dishes(spark, path).where("citystate = 'AustinTX' and dish = 'burger'")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(citystate" in plan and "EqualTo(dish,burger)" in plan
    assert wanted.count() == 1


def test_harvest(spark, rows, tmp_path):
    responses = [
        {"result_list": [
            {"result_type": "a", "completion_list": [{"type": "dish", "value": "taco"}, {"type": "cuisine", "value": "thai"}]},
            {"result_type": "b", "completion_list": [{"type": "dish", "value": "ignored"}]},
        ]},
        {"result_list": [{"completion_list": [{"type": "dish", "value": "bun"}, {"type": "dish", "value": "taco"}]}]},
        {"result_list": []},
    ]
    for i, response in enumerate(responses):
        (tmp_path / f"{i}.json").write_text(json.dumps(response, indent=1))
    found = readers.read_completions(spark, str(tmp_path))
    assert rows(found) == [("cuisine", "thai"), ("dish", "bun"), ("dish", "taco"), ("dish", "taco")]
    assert [tuple(r) for r in harvest.terms_by_type(found).collect()] == [
        ("cuisine", "thai", 1), ("dish", "bun", 2), ("dish", "taco", 2),
    ]
    path = work_path(spark, "terms")
    harvest.harvest(spark.createDataFrame([(json.dumps(r),) for r in responses], "value string"), path)
    assert rows(spark.read.text(path)) == [("cuisine,thai",), ("dish,bun",), ("dish,taco",)]


def test_sample_is_stable(spark, rows):
    frame = spark.range(5000)
    first = rows(sample_by_key(frame, "id", 0.2))
    assert first == rows(sample_by_key(frame.repartition(7), "id", 0.2))
    assert 850 < len(first) < 1150


def test_readers(spark, rows, tmp_path):
    (tmp_path / "dict.txt").write_text("noodle|asian:ramen\nbeer:beer\n")
    assert rows(readers.read_dictionary(spark, str(tmp_path / "dict.txt"))) == [
        ("asian", "ramen"), ("beer", "beer"), ("noodle", "ramen"),
    ]
    (tmp_path / "business.json").write_text('{"business_id": "b", "city": "X", "stars": 4.5, "review_count": 3, "open": true}\n')
    assert rows(readers.read_businesses(spark, str(tmp_path / "business.json")).select("business_id", "stars", "review_count")) == [
        ("b", 4.5, 3)
    ]
    spark.createDataFrame([("b", "text", "2024-01-01", 5)], "business_id string, text string, date string, votes int").write.parquet(
        str(tmp_path / "reviews")
    )
    assert rows(readers.read_reviews(spark, str(tmp_path / "reviews"))) == [("b", "text", "2024-01-01")]
    assert rows(readers.read_tips(spark, str(tmp_path / "reviews"), "votes int")) == [("b", "text", "2024-01-01", 5)]
    sinks.json_to_parquet(spark, str(tmp_path / "business.json"), str(tmp_path / "business"), schemas.BUSINESS)
    assert spark.read.parquet(str(tmp_path / "business")).columns == schemas.BUSINESS.names
    assert readers.kafka_options("host:1", "newreview", max_offsets=10)["maxOffsetsPerTrigger"] == "10"
