import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from dishrank.operators import mentions as men
from dishrank.operators import sentiment as sen
from dishrank.operators import sentiment_model
from dishrank.operators.dictionary import category_items, expand_categories, list_items, parse_dictionary
from dishrank.operators.scoring import best_quote, dish_scores
from dishrank.plans.build import dish_ratings, publish, scored_mentions
from dishrank.session import work_path
from dishrank.sources import readers

LINES = ["noodle|asian:ramen", "noodle:pad thai", "burger:burger", "soup:ramen", "ribs:ribs\t", "burger:burger", "pasta: penne "]
REVIEWS = [
    ("r1", "b1", "The ramen was good. Two burgers came late! Nothing else.", "2024-01-01"),
    ("r2", "b1", "Ramen and burger, then ramen again. Fine.", "2024-01-02"),
    ("r3", "b2", "We had pad thai. Bad ramen.", "2024-01-03"),
    ("r4", "b2", "No food here.", "2024-01-04"),
    ("r5", "b2", "x" * 400 + " ramen " + "y" * 400, "not a date"),
    ("r6", "b3", "", "2024-01-06"),
]


@pytest.fixture
def dictionary(spark):
    return parse_dictionary(spark.createDataFrame([(x,) for x in LINES], "value string"))


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame(REVIEWS, "review_id string, business_id string, text string, date string")


@pytest.fixture
def lemmas(spark):
    return spark.createDataFrame([("were", "be"), ("was", "be")], "form string, lemma string")


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame([("good", 2), ("fine", 1), ("late", -1), ("bad", -2)], "word string, polarity int")


def test_dictionary(spark, rows, dictionary):
    assert rows(dictionary) == [
        ("asian", "ramen"), ("burger", "burger"), ("noodle", "pad thai"), ("noodle", "ramen"), ("pasta", "penne"),
        ("ribs", "ribs"), ("soup", "ramen"),
    ]
    assert [r.item for r in list_items(dictionary).collect()] == ["burger", "pad thai", "penne", "ramen", "ribs"]
    assert ("noodle", "pad thai", 2) in rows(category_items(dictionary))
    asked = spark.createDataFrame([("A", "noodle"), ("A", "ramen"), ("B", "noodle")], "citystate string, term string")
    assert rows(expand_categories(asked, dictionary).select("citystate", "term", "dish")) == [
        (c, "noodle", d) for c in "AB" for d in ("pad thai", "ramen")
    ]


@pytest.mark.parametrize("policy, expected", [
    ("last", [("r1", 1, "burger"), ("r2", 0, "ramen"), ("r3", 1, "ramen"), ("r5", 0, "ramen")]),
    ("first_sentence", [("r1", 0, "ramen"), ("r2", 0, "ramen"), ("r3", 1, "ramen"), ("r5", 0, "ramen")]),
    ("all", [("r1", 0, "ramen"), ("r1", 1, "burger"), ("r2", 0, "burger"), ("r2", 0, "ramen"),
             ("r3", 1, "ramen"), ("r5", 0, "ramen")]),
])
def test_mentions(rows, reviews, dictionary, lemmas, policy, expected):
    found = men.find_mentions(reviews, dictionary, lemmas, policy)
    assert found.columns == ["review_id", "business_id", "date", "sentence_pos", "dish", "promo_text"]
    assert rows(found.select("review_id", "sentence_pos", "dish")) == expected
    clipped = found.where("review_id = 'r5'").first().promo_text
    assert len(clipped) == 300 and clipped.index("ramen") == 150


def test_items_of_several_words(rows, reviews, dictionary, lemmas):
    found = men.find_mentions(reviews, dictionary, lemmas, "all", max_ngram=4)
    assert ("r3", 0, "pad thai") in rows(found.select("review_id", "sentence_pos", "dish"))
    single = men.find_mentions(reviews, dictionary, lemmas, "all", max_ngram=1)
    assert found.count() == single.count() + 1


MENU = ["hummus", "fries", "prawns", "ribs", "sandwich", "curry", "pastry", "radish", "cheese", "fish and chips", "t-bone"]


def large(dictionary, words=50_000):
    """The dictionary with so many items more that no size limit would let it pass."""
    spark = dictionary.sparkSession
    more = spark.range(words).select(F.lit("x").alias("category"), F.concat(F.lit("zz"), F.translate(
        F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("item"))
    return dictionary.union(more)


@pytest.mark.parametrize("grow", [lambda d: d, large])
def test_food_words_match(spark, rows, lemmas, grow):
    menu = grow(spark.createDataFrame([("m", i) for i in MENU] + [("m", None), ("n", "ribs")], "category string, item string"))
    text = (
        "We loved the hummus and two sandwiches. The curries were hot. Ribs! Pastries and radishes with cheeses."
        " Prawns, fries. One rib, one fry. Fish and chips or a T-Bone?"
    )
    reviews = spark.createDataFrame([(None, text), (None, text)], "key string, text string")
    found = men.find_mentions(reviews, menu, lemmas, "all", max_ngram=3)
    expected = [
        (0, "hummus"), (0, "sandwich"), (1, "curry"), (2, "ribs"), (3, "cheese"), (3, "pastry"), (3, "radish"),
        (4, "fries"), (4, "prawns"), (6, "fish and chips"), (6, "t-bone"),
    ]
    assert rows(found.select("sentence_pos", "dish")) == sorted(expected * 2)
    last = men.find_mentions(reviews, menu, lemmas, "last", max_ngram=3)
    assert rows(last.select("sentence_pos", "dish")) == [(6, "t-bone")] * 2


def test_a_listed_lemma_goes_before_a_plural(spark, rows):
    menu = spark.createDataFrame([("m", i) for i in ("mouse", "mice", "bee", "bees", "goose")], "category string, item string")
    table = spark.createDataFrame(
        [("geese", "goose"), ("geese", "zebra"), ("mouses", "goose"), (None, "bee"), ("x", None)], "form string, lemma string"
    )
    forms = {r.pattern: r.dish for r in men.dictionary_patterns(menu, table).collect()}
    assert forms == {
        "mouse": "mouse", "mice": "mice", "mices": "mice", "bee": "bee", "bees": "bees", "beeses": "bees", "goose": "goose",
        "gooses": "goose", "geese": "goose", "mouses": "goose",
    }


def test_planning_does_not_grow_with_the_dictionary(spark, reviews, dictionary, lemmas):
    start = time.perf_counter()
    men.find_mentions(reviews, large(dictionary, 100_000), lemmas)
    assert time.perf_counter() - start < 15  # about two seconds on a machine at rest


def test_unknown_policy(reviews, dictionary, lemmas):
    with pytest.raises(ValueError):
        men.find_mentions(reviews, dictionary, lemmas, "best")


@pytest.mark.parametrize("more", [0, 50_000])
def test_scores(spark, rows, lexicon, more):
    texts = {"good good good": 5, "fine": 4, "": 3, "late bad bad": 1, "Bad but fine": 2, "good late": 4}
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2 + [(9, None)], "id int, s string")
    words = lexicon.union(spark.range(more).select(F.concat(F.lit("zz"), F.col("id").cast("string")), F.lit(1)))
    expected = sorted([(i, s) for i, s in enumerate(texts.values())] * 2 + [(9, 3)])
    assert rows(sen.score_sentences(frame, "s", words).select("id", "score")) == expected


def test_polarities_of_a_word_add_up(spark, rows):
    words = spark.createDataFrame([("good", 1.0), ("good", 1.0), ("odd", 0.5), (None, 2.0), ("x", None)], "word string, polarity double")
    frame = spark.createDataFrame([(1, "good"), (2, "odd odd"), (3, "x")], "id int, s string")
    assert rows(sen.score_sentences(frame, "s", words).select("id", "score")) == [(1, 5), (2, 4), (3, 3)]


def test_trained_scores(spark):
    rng = random.Random(4)
    good, bad, other = ["great", "tasty", "lovely"], ["awful", "cold", "rude"], [f"w{i}" for i in range(60)]
    texts = [(" ".join(rng.choices(good if k % 2 else bad, k=3) + rng.choices(other, k=5)), k % 2) for k in range(400)]
    model = sentiment_model.fit(spark.createDataFrame(texts + [(None, 1), ("x", None)], "text string, label int"))
    frame = spark.createDataFrame(
        [(1, "Great, lovely and tasty!"), (2, "Cold. Awful and rude."), (3, None), (4, "w1 w2")], "id int, s string"
    )
    score = {r.id: r.score for r in sentiment_model.score_sentences(frame, "s", model).collect()}
    assert score[1] == 5 and score[2] == 1 and score[3] == 3 and score[4] in (2, 3, 4)
    held = [(" ".join(rng.choices(good if k % 2 else bad, k=2) + rng.choices(other, k=5)), k % 2) for k in range(100)]
    rows = sentiment_model.score_sentences(spark.createDataFrame(held, "s string, label int"), "s", model).collect()
    assert sum((r.score >= 3) == bool(r.label) for r in rows) >= 95


def test_quality_on_labels_held_out(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    labelled = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learned, work = labelled.where(~held_out), work_path(spark, "models")
    model = sentiment_model.fit_once(learned, work)
    right, area = sentiment_model.quality(model, labelled.where(held_out))
    # The labels tell the quality of whole documents, which words alone tell in part.
    assert right >= 0.8 and area >= 0.6
    # The second call loads what the first has saved; another choice of rows is another model.
    fitted, count = sentiment_model.fit, []
    sentiment_model.fit = lambda *a: count.append(1) or fitted(*a)
    try:
        assert sentiment_model.quality(sentiment_model.fit_once(learned, work), labelled.where(held_out)) == (right, area)
        assert not count
        sentiment_model.fit_once(learned.where("label = 0").limit(50).union(learned.where("label = 1").limit(50)), work)
        assert count == [1]
    finally:
        sentiment_model.fit = fitted


def test_longest_sentence(rows, reviews, lexicon):
    longest = sen.longest_sentences(reviews.select("review_id", "text"))
    got = dict(rows(longest))
    assert got["r1"] == "Two burgers came late!" and got["r2"] == "Ramen and burger, then ramen again."
    assert "r6" not in got


def test_scored_mentions_and_ratings(spark, rows, reviews, dictionary, lemmas, lexicon):
    scored = scored_mentions(reviews, dictionary, lemmas, lexicon)
    got = {(r.business_id, r.dish, r.score, r.promo_date) for r in scored.collect()}
    assert got == {
        ("b1", "burger", 2, dt.date(2024, 1, 1)), ("b1", "ramen", 3, dt.date(2024, 1, 2)),
        ("b2", "ramen", 1, dt.date(2024, 1, 3)), ("b2", "ramen", 3, None),
    }
    business = spark.createDataFrame(
        [("b1", "One", "1 St", "Las Vegas", "NV", 4.5, 10), ("b2", "Two", "2 St", "Austin", "TX", 3.5, 20)],
        "business_id string, name string, full_address string, city string, state string, stars double, review_count long",
    )
    tips = reviews.where("review_id = 'r1'")
    joined = dish_ratings(reviews, tips, business, dictionary, lemmas, lexicon)
    got = {(r.businessid, r.dish): (r.numreviews, r.totalscore, r.avgrating) for r in joined.collect()}
    assert got == {("b1", "burger"): (2, 4, 2.0), ("b1", "ramen"): (1, 3, 3.0), ("b2", "ramen"): (2, 4, 2.0)}

    for stage in (None, work_path(spark, "stage")):
        dishes, places = work_path(spark, "dishes"), work_path(spark, "businesses")
        publish(joined, dishes, places, stage)
        cities = readers.read_dishes(spark, dishes).select("citystate", "dish", "businessid", "numreviews")
        assert rows(cities) == [("AustinTX", "ramen", "b2", 2), ("LasVegasNV", "burger", "b1", 2), ("LasVegasNV", "ramen", "b1", 1)]
        keys = readers.read_published_businesses(spark, places).select("businessid", "citystate")
        assert rows(keys) == [("b1", "LasVegasNV"), ("b2", "AustinTX")]


def mention_frame(spark, data):
    return spark.createDataFrame(
        data, "business_id string, dish string, score int, promo_text string, promo_date date"
    )


def test_averages(spark, rows):
    data = [("Fred", "x", s, f"t{s}", None) for s in (88, 95, 91)] + [("Wilma", "x", s, f"t{s}", None) for s in (93, 95, 98)]
    got = {r.businessid: (round(r.avgrating, 2), r.promotext, r.promoscore) for r in dish_scores(mention_frame(spark, data)).collect()}
    assert got == {"Fred": (91.33, "t95", 95), "Wilma": (95.33, "t98", 98)}


def test_scores_do_not_depend_on_partitions(spark, rows):
    day = dt.date(2024, 1, 1)
    data = [("hot" if i % 3 else f"b{i % 7}", f"d{i % 2}", 1 + i % 5, f"text {i % 11}", day + dt.timedelta(days=i % 4)) for i in range(300)]
    results = [rows(dish_scores(mention_frame(spark, data).repartition(n))) for n in (1, 3, 8)]
    assert results[0] == results[1] == results[2]
    quotes = rows(best_quote(mention_frame(spark, data)).select("business_id", "dish", "promotext", "promoscore"))
    assert quotes == sorted((r[0], r[1], r[5], r[6]) for r in results[0])


def test_scoring_shuffles_once(spark):
    plan = dish_scores(mention_frame(spark, [("b", "d", 1, "t", None)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "partial_count" in plan


def test_text_is_no_shuffle_key_and_needs_no_python(reviews, dictionary, lemmas, lexicon):
    scored = scored_mentions(reviews, dictionary, lemmas, lexicon)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "hashpartitioning(text#" not in plan and "hashpartitioning(promo" not in plan


def test_spread_small_keeps_rows(spark):
    frame = spark.range(100).withColumn("k", F.col("id") % 7)
    assert readers.spread_small(frame, "id").count() == 100


@pytest.mark.parametrize("policy", men.POLICIES)
def test_large_tables_are_looked_up_in_slices(spark, rows, reviews, dictionary, lemmas, policy, monkeypatch):
    """What a table too large to broadcast gives equals what a small one gives, and no word moves alone."""
    from dishrank.operators import mentions

    texts = reviews.union(reviews).union(spark.createDataFrame([("r7", "b3", None, None)], reviews.schema))
    more = dictionary.union(spark.createDataFrame([("x", "late nothing"), ("x", "came late"), ("x", "good two")], dictionary.schema))
    expected = rows(men.find_mentions(texts, more, lemmas, policy, 3).drop("date"))
    called = []
    monkeypatch.setattr(mentions, "is_small", lambda table: called.append(table) or False)
    assert rows(men.find_mentions(texts, more, lemmas, policy, 3).drop("date")) == expected and len(called) == 1
    assert len({r[-2] for r in expected}) > 1


def test_scores_move_no_word_by_itself(spark, lexicon):
    """The lexicon meets different words of a slice, not those of each sentence."""
    from dishrank.operators.composed_sentiment import score_composed

    frame = spark.range(300).select(F.concat(F.lit("good fine late w"), F.col("id").cast("string")).alias("s"))
    modifiers = spark.createDataFrame([("good", "negate", 1.0)], "word string, kind string, factor double")
    for scored in (sen.score_sentences(frame, "s", lexicon), score_composed(frame, "s", lexicon, modifiers)):
        plan = scored._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_set" not in plan and "FlatMapCoGroups" in plan
        assert {r.score for r in scored.collect()} <= {1, 2, 3, 4, 5} and scored.count() == 300


@pytest.mark.parametrize("policy", men.POLICIES)
def test_items_too_many_to_broadcast_are_asked_for_by_slices(spark, rows, policy, monkeypatch):
    """A large table of items gives what a small one gives, and no word of a text moves by itself."""
    # The last pair has the key of an item and is none, in texts with and without an item; the longest item is anchored inside.
    texts = [
        "City boxes here. New york city series.", "Le chat. Les chat", "Les chat.", "Pad thai, box. Pad thais and les chats",
        "Mice traps. New york yes", "", "One", "Two boxes, new york city serie city box", None,
    ]
    reviews = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts * 3)], "k int, text string")
    items = ["city box", "le chat", "pad thai", "Pad-Thai", "mouse trap", "new york city series", "york yes", "new york", "one", None]
    menu = spark.createDataFrame([("m", i) for i in items], "category string, item string")
    table = spark.createDataFrame([("mice", "mouse"), ("x", None)], "form string, lemma string")
    expected = rows(men.find_mentions(reviews, menu, table, policy, 4))
    assert len({r[2] for r in expected}) > 3
    monkeypatch.setattr(men, "is_large", lambda table: True)
    monkeypatch.setattr(men, "neighbours", None)
    assert rows(men.find_mentions(reviews, menu, table, policy, 4)) == expected


def test_only_pairs_that_are_asked_for_come_back(spark, monkeypatch):
    """Of the words of all texts those that may begin an item are verified, for the last item the last ones."""
    from dishrank.sources.stages import fresh

    reviews = spark.range(300).select(F.concat(
        F.lit("Pad thai first. Pad thai then nothing of w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"),
        F.lit(" but words."),
    ).alias("text"))
    menu = spark.createDataFrame([("m", "pad thai"), ("m", "no such item")], "category string, item string")
    table = spark.createDataFrame([("x", "y")], "form string, lemma string")
    moved = {}
    monkeypatch.setattr(men, "is_large", lambda table: True)
    for policy, places in (("last", 1), ("all", 2)):
        men.find_mentions(reviews, menu, table, policy, 3, lambda df, name: moved.setdefault((policy, name), fresh(df, name)))
        assert moved[policy, f"places_{policy}_2"].agg(F.sum(F.size("places"))).first()[0] == 300 * places
        assert moved[policy, "hits"].count() == 300 * places
        # One row of a slice and part at most, however many words there are.
        assert moved[policy, "pairs_found"].agg(F.sum(F.length("pairs"))).first()[0] <= 4 * 300


def test_stages_of_items_are_told_apart_by_policy(spark, rows, lemmas, monkeypatch):
    """A run that finds the stages of another policy does not go on from its places."""
    from dishrank.sources.stages import Stages, fresh

    monkeypatch.setattr(men, "is_large", lambda table: True)
    reviews = spark.createDataFrame([(1, "The ramen was good. Two burgers came late!")], "k int, text string")
    menu = spark.createDataFrame([("x", "the ramen"), ("x", "came late")], "category string, item string")
    inputs = [fresh(frame.coalesce(1), "input") for frame in (reviews, menu, lemmas)]
    root = work_path(spark, "stages")
    for policy, expected in (("last", (1, "came late")), ("first_sentence", (0, "the ramen"))):
        found = men.find_mentions(*inputs, policy, 2, Stages(spark, root))
        assert rows(found.select("sentence_pos", "dish")) == [expected]
    again = Stages(spark, root)
    men.find_mentions(*inputs, "last", 2, again)
    assert again.used and not again.written
