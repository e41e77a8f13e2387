"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..operators import dictionary as dic
from ..operators import mentions as men
from ..operators import ratings as rat
from ..operators import lemma_rules, scoring, sentiment_model
from ..operators.composed_sentiment import score_composed
from ..operators.published import businesses_view, dishes_view, join_business, of_category
from ..operators.sampling import exact_sample, sample_by_key
from ..operators.sentiment import longest_sentences, score_sentences
from ..plans import build, harvest, serving
from ..schemas import DISH_KEY
from ..session import work_path
from ..sources import readers, sinks
from ..sources.stages import Stages
from ..streaming import ratings as stream
from .standins import STREAM_START, UNSTORED_DISH, Tables

Query = Callable[[SparkSession, str], DataFrame]

SHOWN_CITY = "NATION 15, AF"
SHOWN_CITYSTATE = "NATION15AF"
SHOWN_DISH = "blue bolt"
SHOWN_BUSINESS = "7"
TEXT_TERM = "the"
SAMPLE_FRACTION = 0.1
SAMPLE_ROWS = 20
LARGE_SAMPLE_ROWS = 20_000
# Every so many messages one more comes with a time in the year 2100.
BAD_CLOCK_EVERY = 1000
BAD_CLOCK = "2100-01-01"

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
])

_QUERIES: dict[str, Query] = {}
_PUBLISHED: dict[tuple[str, str], tuple[str, str]] = {}


def query(step: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return step(Tables(spark, sf_dir))

    _QUERIES[step.__name__] = run
    return step


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def entry(spark: SparkSession) -> DataFrame:
    return _QUERIES["search_dishes"](spark, "/root/testdata/sf0.001")


# Frames several queries start from.


def joined(t: Tables) -> DataFrame:
    return join_business(scoring.dish_scores(t.mentions()), t.business())


def dishes(t: Tables) -> DataFrame:
    return dishes_view(joined(t))


def businesses(t: Tables) -> DataFrame:
    """Published businesses straight from their source, unique by key."""
    return businesses_view(t.business().withColumnRenamed("business_id", "businessid"))


def dictionary(t: Tables) -> DataFrame:
    return dic.parse_dictionary(t.dictionary_lines())


def ratings(t: Tables) -> DataFrame:
    return rat.split_valid(t.rating_messages())[0]


def stored_dishes(t: Tables) -> DataFrame:
    """Dishes table as it stands when the stream starts."""
    early = ratings(t).where((F.col("ts") < STREAM_START) & (F.col("dish") != UNSTORED_DISH))
    return early.groupBy(*DISH_KEY).agg(
        F.avg("score").alias("avgrating"),
        F.count(F.lit(1)).alias("numreviews"),
        F.sum(F.col("score").cast("long")).alias("totalscore"),
        F.max("promotext").alias("promotext"),
        F.max("score").alias("promoscore"),
    ).select("citystate", "dish", "businessid", "avgrating", "numreviews", "totalscore", "promotext", "promoscore")


def trends(t: Tables) -> DataFrame:
    return rat.latest_trends(rat.trending(rat.window_ratings(ratings(t))))


def published(t: Tables) -> tuple[str, str]:
    """Paths of the published tables, written once per application and folder."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _PUBLISHED:
        paths = work_path(t.spark, "dishes"), work_path(t.spark, "businesses")
        build.publish(joined(t), *paths, stage_path=work_path(t.spark, "joined"))
        _PUBLISHED[key] = paths
    return _PUBLISHED[key]


def stored_table(t: Tables) -> DataFrame:
    return readers.read_dishes(t.spark, published(t)[0])


def stored_places(t: Tables) -> DataFrame:
    return readers.read_published_businesses(t.spark, published(t)[1])


def message_stream(t: Tables) -> DataFrame:
    return t.rating_messages(readers.read_parquet_stream(t.spark, t.path("events"), EVENTS))


# Sources and sinks.


@query
def read_reviews(t: Tables) -> DataFrame:
    path = work_path(t.spark, "reviews")
    t.reviews().write.parquet(path)
    return readers.read_reviews(t.spark, path).select("business_id", "text", "date")


@query
def read_tips(t: Tables) -> DataFrame:
    path = work_path(t.spark, "tips")
    t.tips().write.parquet(path)
    return readers.read_tips(t.spark, path).select("business_id", "text", "date")


@query
def read_businesses(t: Tables) -> DataFrame:
    path = work_path(t.spark, "business-json")
    sinks.write_business_json(t.business().withColumn("categories", _categories()), path)
    rows = readers.read_businesses(t.spark, path)
    return rows.withColumn("categories", F.array_join("categories", "|"))


def _categories():
    return F.when(F.col("stars") >= 3, F.array(F.lit("Restaurants"), "state")).otherwise(F.array("state"))


@query
def restaurants_only(t: Tables) -> DataFrame:
    return of_category(t.business().withColumn("categories", _categories()), "Restaurants").drop("categories")


@query
def dictionary_terms(t: Tables) -> DataFrame:
    path = work_path(t.spark, "dictionary")
    t.dictionary_lines().write.text(path)
    return readers.read_dictionary(t.spark, path)


@query
def list_dishes(t: Tables) -> DataFrame:
    return dic.list_items(dictionary(t))


@query
def category_items(t: Tables) -> DataFrame:
    return dic.category_items(dictionary(t))


@query
def category_expand(t: Tables) -> DataFrame:
    """Each city asks for every category it has a dish of."""
    asked = stored_table(t).join(dictionary(t), F.col("dish") == F.col("item"))
    requests = asked.select("citystate", F.col("category").alias("term")).distinct()
    return dic.expand_categories(requests, dictionary(t))


@query
def publish_dishes(t: Tables) -> DataFrame:
    path = work_path(t.spark, "dishes")
    sinks.publish_dishes(dishes(t), path)
    return readers.read_dishes(t.spark, path)


@query
def publish_businesses(t: Tables) -> DataFrame:
    path = work_path(t.spark, "businesses")
    sinks.publish_businesses(businesses_view(joined(t)), path)
    return readers.read_published_businesses(t.spark, path)


@query
def business_keys(t: Tables) -> DataFrame:
    return stored_places(t).select("businessid", "citystate")


@query
def dishes_limit(t: Tables) -> DataFrame:
    return stored_table(t).orderBy(*DISH_KEY).limit(1000)


@query
def dishes_by_city(t: Tables) -> DataFrame:
    return stored_table(t).where(F.col("citystate") == SHOWN_CITYSTATE)


@query
def dishes_by_city_dish(t: Tables) -> DataFrame:
    return stored_table(t).where((F.col("citystate") == SHOWN_CITYSTATE) & (F.col("dish") == SHOWN_DISH))


@query
def dishes_by_business(t: Tables) -> DataFrame:
    """The dishes of the first business of a city."""
    city = stored_table(t).where(F.col("citystate") == SHOWN_CITYSTATE)
    return city.join(city.agg(F.min("businessid").alias("businessid")), "businessid", "left_semi")


@query
def dishes_of_business(t: Tables) -> DataFrame:
    """One business looked up by its own key alone."""
    return serving.dishes_of_business(stored_table(t), SHOWN_BUSINESS)


@query
def places_of_dish(t: Tables) -> DataFrame:
    return serving.places_of_dish(stored_table(t), stored_places(t), SHOWN_DISH)


@query
def stage_roundtrip(t: Tables) -> DataFrame:
    return sinks.stage_roundtrip(scoring.dish_scores(t.mentions()), work_path(t.spark, "scores"))


@query
def stage_resumed(t: Tables) -> DataFrame:
    """Scores from a stage that an earlier run of the same job has finished."""
    root = work_path(t.spark, "stages")
    Stages(t.spark, root)(scoring.dish_scores(t.mentions()), "scores")
    again = Stages(t.spark, root)
    rows = again(scoring.dish_scores(t.mentions()), "scores")
    if again.written:
        raise AssertionError("a finished stage was written again")
    return rows


@query
def joined_persisted(t: Tables) -> DataFrame:
    """Both published keys from one evaluation of the joined rows, kept in memory and on disk."""
    dishes_path, businesses_path = work_path(t.spark, "dishes"), work_path(t.spark, "businesses")
    build.publish(joined(t), dishes_path, businesses_path)
    places = readers.read_published_businesses(t.spark, businesses_path).select("businessid", "citystate", "name")
    return readers.read_dishes(t.spark, dishes_path).join(places, ["businessid", "citystate"]).select(
        "citystate", "businessid", "name", "dish", "numreviews"
    )


@query
def completions_parse(t: Tables) -> DataFrame:
    path = work_path(t.spark, "completions")
    t.completion_responses().write.text(path)
    return readers.read_completions(t.spark, path, per_line=True)


@query
def completions_by_type(t: Tables) -> DataFrame:
    return harvest.terms_by_type(readers.parse_completions(t.completion_responses()))


@query
def completions_checked(t: Tables) -> DataFrame:
    """Terms of the usable ones among responses of which some are damaged."""
    return readers.split_completions(t.damaged_responses())[0]


@query
def completions_quarantine(t: Tables) -> DataFrame:
    """The damaged responses, set aside with the reason while the terms are written."""
    path = work_path(t.spark, "refused")
    harvest.harvest(t.damaged_responses(), work_path(t.spark, "terms"), path)
    return t.spark.read.schema("value string, reason string").json(path)


@query
def completions_export(t: Tables) -> DataFrame:
    path = work_path(t.spark, "terms")
    harvest.harvest(t.completion_responses(), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


# Keys, weights and formats.


@query
def citystate_key(t: Tables) -> DataFrame:
    return t.business().select(
        "business_id",
        fn.citystate_key(F.col("city"), F.col("state")).alias("stored"),
        fn.normalise_city(F.concat_ws(", ", "city", "state")).alias("looked_up"),
    )


@query
def clean_address(t: Tables) -> DataFrame:
    return t.business().select("business_id", fn.clean_address(F.col("full_address")).alias("address"))


@query
def format_rating(t: Tables) -> DataFrame:
    scores = scoring.dish_scores(t.mentions())
    return scores.select("businessid", "dish", fn.format_rating(F.col("avgrating")).alias("avgrating"))


@query
def round_rating(t: Tables) -> DataFrame:
    scores = scoring.dish_scores(t.mentions())
    return scores.select("businessid", "dish", fn.round_at(F.col("avgrating").cast("decimal(18,9)"), 2).cast("string").alias("rounded"))


@query
def trending_weight(t: Tables) -> DataFrame:
    num, total = F.col("numreviews"), F.col("totalscore")
    return scoring.dish_scores(t.mentions()).select(
        "businessid", "dish",
        fn.trending_weight(num).alias("weight"), fn.trending_score(num, total).alias("weighted"),
    )


@query
def confidence_weight(t: Tables) -> DataFrame:
    num = F.col("numreviews")
    return scoring.dish_scores(t.mentions()).select(
        "businessid", "dish", "numreviews", fn.confidence_weight(num).alias("weight")
    )


@query
def list_cities(t: Tables) -> DataFrame:
    return serving.list_cities(stored_table(t))


@query
def promo_snippet(t: Tables) -> DataFrame:
    return t.mentions().select(
        "business_id", "promo_text",
        fn.snippet(F.col("promo_text"), F.col("dish"), fn.SNIPPET_LIST).alias("in_list"),
        fn.snippet(F.concat(F.lit("they say the "), "promo_text", F.lit(" is good")), F.col("dish"), fn.SNIPPET_SEARCH).alias("in_search"),
    )


# Text.


@query
def sentences(t: Tables) -> DataFrame:
    return men.sentence_rows(t.reviews()).select("review_id", "sentence_pos", "sentence")


@query
def tokens(t: Tables) -> DataFrame:
    rows = men.token_rows(men.sentence_rows(t.reviews()), t.lemma_table())
    return rows.select("review_id", "sentence_pos", "token_pos", "form", "lemma")


@query
def clip_sentence(t: Tables) -> DataFrame:
    """Every sentence clipped around a word, also where the word is absent."""
    rows = men.sentence_rows(t.reviews())
    return rows.select(
        "review_id", "sentence_pos", fn.clip_sentence(F.col("sentence"), F.lit(TEXT_TERM)).alias("clipped")
    )


@query
def term_mentions(t: Tables) -> DataFrame:
    rows = men.token_rows(men.sentence_rows(t.reviews()), t.lemma_table())
    found = men.mention_rows(rows, t.text_dictionary(), t.lemma_table())
    return found.select("review_id", "sentence_pos", "token_pos", "dish")


def _found(t: Tables, policy: str) -> DataFrame:
    return men.find_mentions(t.reviews(), t.text_dictionary(), t.lemma_table(), policy)


@query
def last_mention(t: Tables) -> DataFrame:
    return _found(t, "last").select("review_id", "sentence_pos", "dish", "promo_text")


@query
def first_mention(t: Tables) -> DataFrame:
    return _found(t, "first_sentence").select("review_id", "sentence_pos", "dish", "promo_text")


@query
def mentions_scored(t: Tables) -> DataFrame:
    """Every item of every review, each with the score of its sentence."""
    found = sinks.stage_roundtrip(_found(t, "all"), work_path(t.spark, "mentions"))
    scored = score_sentences(found, "promo_text", t.lexicon())
    return scored.select("review_id", "sentence_pos", "dish", "score")


@query
def mentions_large_dictionary(t: Tables) -> DataFrame:
    """Every item of every review, with all longer words of the documents as dictionary."""
    # Read several times, so it is written once.
    dictionary = sinks.stage_roundtrip(t.word_dictionary(), work_path(t.spark, "words"))
    found = men.find_mentions(t.reviews(), dictionary, t.lemma_table(), "all")
    return found.select("review_id", "sentence_pos", "dish")


@query
def mentions_ngram(t: Tables) -> DataFrame:
    """Last item of each review, with the two-word beginnings of sentences as dictionary."""
    found = men.find_mentions(t.reviews(), t.pair_dictionary(), t.lemma_table(), "last", max_ngram=2)
    return found.select("review_id", "sentence_pos", "dish", "promo_text")


@query
def sentiment_large_lexicon(t: Tables) -> DataFrame:
    """Score of every sentence, with a polarity for every word of the documents."""
    rows = score_sentences(men.sentence_rows(t.reviews()), "sentence", t.word_lexicon())
    return rows.select("review_id", "sentence_pos", "score")


@query
def sentence_sentiment(t: Tables) -> DataFrame:
    rows = score_sentences(men.sentence_rows(t.reviews()), "sentence", t.lexicon())
    return rows.select("review_id", "sentence_pos", "score")


@query
def sentence_sentiment_composed(t: Tables) -> DataFrame:
    """Score of every sentence with negators and intensifiers."""
    rows = score_composed(men.sentence_rows(t.reviews()), "sentence", t.word_lexicon(), t.modifiers())
    return rows.select("review_id", "sentence_pos", "score")


@query
def lemma_suffix_rules(t: Tables) -> DataFrame:
    """Rules that half of the listed forms teach."""
    return lemma_rules.learn_rules(t.ending_table().where("not held_out"))


@query
def learned_lemmas(t: Tables) -> DataFrame:
    """Lemmas of the forms held out, by the rules of the others, beside what the table lists."""
    table = sinks.stage_roundtrip(t.ending_table(), work_path(t.spark, "endings"))
    found = lemma_rules.apply_rules(table.where("held_out"), lemma_rules.learn_rules(table.where("not held_out")))
    return table.where("held_out").select("form", F.col("lemma").alias("listed")).join(found, "form", "left")


@query
def sentence_sentiment_ml(t: Tables) -> DataFrame:
    """Every sentence scored by a model of the quality labels of whole documents."""
    labels = t.read("labels").select("doc_id", F.col("quality").alias("label"))
    model = sentiment_model.fit_once(t.read("documents").select("doc_id", "text").join(labels, "doc_id"))
    rows = sentiment_model.score_sentences(men.sentence_rows(t.reviews()), "sentence", model)
    return rows.select("review_id", "sentence_pos", "score")


@query
def longest_sentence_sentiment(t: Tables) -> DataFrame:
    rows = score_sentences(longest_sentences(t.reviews()), "sentence", t.lexicon())
    return rows.select("review_id", "sentence", "score")


@query
def text_contains(t: Tables) -> DataFrame:
    return t.reviews().where(F.col("text").contains(TEXT_TERM)).select("review_id", "business_id")


@query
def sample_rows(t: Tables) -> DataFrame:
    return sample_by_key(t.reviews(), "review_id", SAMPLE_FRACTION).select("review_id", "business_id", "date")


@query
def take_sample(t: Tables) -> DataFrame:
    """Exactly 20 of the scored dishes, the same ones on every run."""
    return exact_sample(scoring.dish_scores(t.mentions()), ["businessid", "dish"], SAMPLE_ROWS)


@query
def take_large_sample(t: Tables) -> DataFrame:
    """Exactly 20,000 lines of orders, or all."""
    lines = t.read_spread("lineitem", "l_orderkey", "l_linenumber", "l_quantity", key=["l_orderkey"])
    return exact_sample(lines, ["l_orderkey", "l_linenumber"], LARGE_SAMPLE_ROWS, seed=7)


# Scores.


@query
def dish_scores(t: Tables) -> DataFrame:
    return scoring.dish_scores(t.mentions())


@query
def best_quote(t: Tables) -> DataFrame:
    return scoring.best_quote(t.mentions()).withColumn("promodate", F.col("promodate").cast("string"))


@query
def reviews_union_tips(t: Tables) -> DataFrame:
    mentions = t.mentions().withColumn("promo_date", F.col("promo_date").cast("string"))
    return scoring.union_all(mentions.where("kind = 'review'"), mentions.where("kind = 'tip'"))


@query
def scores_join_business(t: Tables) -> DataFrame:
    return joined(t)


@query
def multi_review_dishes(t: Tables) -> DataFrame:
    """First 20 dishes with more than one rating, in key order."""
    return dishes(t).where("numreviews > 1").orderBy(*DISH_KEY).limit(20)


@query
def business_sql_view(t: Tables) -> DataFrame:
    t.business().createOrReplaceTempView("dishrank_business")
    return t.spark.sql("SELECT business_id, city, state, stars FROM dishrank_business")


@query
def category_filter(t: Tables) -> DataFrame:
    """Parts whose category array holds a word."""
    parts = t.read("part").select("p_partkey", F.split("p_name", " ").alias("categories"))
    wanted = of_category(parts, "bolt")
    return wanted.select("p_partkey", F.array_join("categories", "|").alias("categories"))


@query
def build_dish_ratings(t: Tables) -> DataFrame:
    """The batch job: documents as reviews and conversation turns as tips."""
    rows = build.dish_ratings(
        t.reviews(), t.tips(), t.business(), t.text_dictionary(), t.lemma_table(), t.lexicon()
    )
    return dishes_view(rows)


# Lookups.


@query
def enrich_recommendations(t: Tables) -> DataFrame:
    return serving.enrich(serving.rated_dishes(stored_table(t)), stored_places(t))


@query
def search_dishes(t: Tables) -> DataFrame:
    return serving.search_all(stored_table(t), stored_places(t), dictionary(t))


@query
def search_requests(t: Tables) -> DataFrame:
    """Each business's city asks for each of the two words of the dishes rated there."""
    places = stored_places(t).select("citystate", "businessid", F.concat_ws(", ", "city", "state").alias("city"))
    asked = stored_table(t).join(places, ["citystate", "businessid"]).select(
        "city", F.explode(F.split("dish", " ")).alias("term")
    ).distinct()
    return serving.search_requests(asked, stored_table(t), stored_places(t), dictionary(t))


@query
def top_dishes_for_restaurant(t: Tables) -> DataFrame:
    return serving.restaurant_all(stored_table(t), stored_places(t))


@query
def top_dishes_by_city(t: Tables) -> DataFrame:
    """Trends of the rating stream with the rated users as restaurants."""
    return serving.city_all(trends(t), _rated_businesses(t))


def _rated_businesses(t: Tables) -> DataFrame:
    """A business row for each one rated in the stream."""
    rated = ratings(t).select("businessid", "citystate").distinct()
    key = F.col("businessid").cast("long")
    return rated.select(
        "businessid",
        "citystate",
        F.concat(F.lit("Place "), "businessid").alias("name"),
        F.concat("citystate", F.lit("\\n"), "businessid").alias("full_address"),
        (key * 7 % 300).alias("reviewcount"),
        (1 + (key % 9) * 0.5).cast("double").alias("stars"),
    )


@query
def recommendations_json(t: Tables) -> DataFrame:
    return serving.as_json(serving.search_all(stored_table(t), stored_places(t), dictionary(t)))


@query
def search_one_city(t: Tables) -> DataFrame:
    """One request against the published tables."""
    return serving.search_one(stored_table(t), stored_places(t), dictionary(t), SHOWN_CITY, "blue")


# Ratings.


@query
def parse_ratings(t: Tables) -> DataFrame:
    score = F.coalesce(F.col("score").cast("string"), F.lit(""))
    return rat.parse_messages(t.rating_messages()).select(
        "event_id", "dish", "businessid", "citystate", score.alias("score"), "promotext", "valid"
    )


@query
def encode_ratings(t: Tables) -> DataFrame:
    return rat.encode_messages(ratings(t))


@query
def window_ratings(t: Tables) -> DataFrame:
    return rat.window_ratings(ratings(t))


@query
def trending_top3(t: Tables) -> DataFrame:
    return rat.trending(rat.window_ratings(ratings(t)))


@query
def merge_ratings(t: Tables) -> DataFrame:
    late = ratings(t).where(F.col("ts") >= STREAM_START)
    return rat.merge_ratings(stored_dishes(t), rat.rating_delta(late))


@query
def replace_trends(t: Tables) -> DataFrame:
    """Trends before the stream starts, replaced in the cities rated in the last hour."""
    path = work_path(t.spark, "trends")
    windows = sinks.stage_roundtrip(rat.trending(rat.window_ratings(ratings(t))), work_path(t.spark, "windows"))
    early = windows.where(F.col("window_end") <= F.lit(STREAM_START).cast("timestamp_ntz"))
    sinks.replace_trends(rat.latest_trends(early), path)
    rated = ratings(t).select("citystate", "ts")
    end = rated.agg(F.max("ts").alias("end"))
    last = rated.join(end, F.col("ts") > F.col("end") - F.expr("INTERVAL 1 HOUR"), "left_semi").select("citystate").distinct()
    again = windows.join(last, "citystate", "left_semi")
    sinks.replace_trends(rat.latest_trends(again), path)
    return readers.read_trends(t.spark, path)


@query
def stream_trending(t: Tables) -> DataFrame:
    """Closed windows as the stream emits them."""
    path, checkpoint = work_path(t.spark, "windows"), work_path(t.spark, "checkpoint")
    stream.use_disk_state(t.spark)
    rows = stream.trending_windows(message_stream(t))
    run = (
        rows.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


@query
def stream_apply(t: Tables) -> DataFrame:
    """Stored dishes after the stream of later ratings was applied to them."""
    path, checkpoint = work_path(t.spark, "dishes"), work_path(t.spark, "checkpoint")
    sinks.publish_dishes(stored_dishes(t), path)
    late = message_stream(t).where(F.col("ts") >= STREAM_START)
    stream.start_dishes(late, path, checkpoint, available_now=True).awaitTermination()
    return readers.read_dishes(t.spark, path)


@query
def stream_trends(t: Tables) -> DataFrame:
    """Trends table after all windows the stream can close were applied."""
    path, checkpoint = work_path(t.spark, "trends"), work_path(t.spark, "checkpoint")
    stream.start_trends(message_stream(t), path, checkpoint, available_now=True).awaitTermination()
    return readers.read_trends(t.spark, path)


@query
def stream_quarantine(t: Tables) -> DataFrame:
    """Malformed messages set aside by the stream."""
    path, checkpoint = work_path(t.spark, "quarantine"), work_path(t.spark, "checkpoint")
    rows = message_stream(t)
    stream.start_quarantine(rows, path, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


def _with_bad_clocks(t: Tables) -> DataFrame:
    """The message stream, some of whose messages come again with a time in the year 2100."""
    again = F.when(F.col("event_id") % BAD_CLOCK_EVERY == 0, F.lit(BAD_CLOCK).cast("timestamp_ntz"))
    times = F.filter(F.array("ts", again), lambda x: x.isNotNull())
    rows = message_stream(t)
    return rows.withColumn("ts", F.explode(times)).select(*rows.columns)


@query
def stream_bad_clocks(t: Tables) -> DataFrame:
    """Closed windows of a stream with times in the far future: those without them."""
    path, checkpoint = work_path(t.spark, "windows"), work_path(t.spark, "checkpoint")
    stream.use_disk_state(t.spark)
    rows = stream.trending_windows(_with_bad_clocks(t))
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


@query
def stream_refused(t: Tables) -> DataFrame:
    """Malformed messages and those far ahead of their arrival, set aside by the stream."""
    path, checkpoint = work_path(t.spark, "quarantine"), work_path(t.spark, "checkpoint")
    rows = _with_bad_clocks(t)
    stream.start_quarantine(rows, path, checkpoint, available_now=True).awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(path)


@query
def stream_live_trends(t: Tables) -> DataFrame:
    """Trends of the windows that are still open when all messages have come, in three triggers."""
    feed, checkpoint = work_path(t.spark, "feed"), work_path(t.spark, "checkpoint")
    trends_path, days_path = work_path(t.spark, "live"), work_path(t.spark, "days")
    messages = t.rating_messages()
    for low, high in (("1900-01-01", "2024-01-12"), ("2024-01-12", "2024-01-22"), ("2024-01-22", "2100-01-01")):
        messages.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(feed)
        arriving = readers.read_parquet_stream(t.spark, feed, messages.schema)
        stream.start_live_trends(arriving, trends_path, days_path, checkpoint, available_now=True).awaitTermination()
    return readers.read_live_trends(t.spark, trends_path)


@query
def stream_late(t: Tables) -> DataFrame:
    """Ratings too late for the trends, when every third message comes in late order."""
    feed, path, checkpoint = work_path(t.spark, "feed"), work_path(t.spark, "late"), work_path(t.spark, "checkpoint")
    messages = t.rating_messages()
    # Three batches: the last days first, then the middle, then the beginning.
    for low, high in (("2024-01-22", "2100-01-01"), ("2024-01-12", "2024-01-22"), ("1900-01-01", "2024-01-12")):
        messages.where((F.col("ts") >= low) & (F.col("ts") < high)).write.mode("append").parquet(feed)
        arriving = readers.read_parquet_stream(t.spark, feed, messages.schema)
        stream.start_late(arriving, path, checkpoint, available_now=True).awaitTermination()
    rows = t.spark.read.schema("event_id long, dish string, businessid string, citystate string, score int").parquet(path)
    return rows.select("event_id", "dish", "businessid", "citystate", "score")
