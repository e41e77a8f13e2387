"""Stand-ins for businesses, reviews, tips and ratings, derived from the test tables.

Each function mirrors one common table expression of ``oracles.VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentences_of, words_of
from ..sources.readers import spread_small

TEXT_DICTIONARY = [
    ("article", "the"), ("preposition", "of"), ("preposition", "from"), ("preposition", "with"),
    ("connector", "and"), ("linking", "with"), ("verb", "be"),
]
LEMMAS = [("are", "be"), ("is", "be"), ("was", "be")]
LEXICON = [("that", 1), ("this", 2), ("it", -1), ("on", -2), ("by", 1), ("at", -1)]
# Modifiers for texts of invented words: frequent ones stand in for "not", "very" and "but".
ENDINGS = [("ing", ""), ("ing", "e"), ("ed", ""), ("ies", "y"), ("er", ""), ("tion", "t"), ("ment", ""), ("aux", "al"), ("ant", "er")]
MODIFIERS = [
    ("the", "negate", 1.0), ("la", "negate", 1.0), ("and", "intensify", 2.0), ("of", "intensify", 1.5), ("with", "clause", 1.0),
    ("this", "intensify", 2.0),
]

# The rating stream is cut here: earlier ratings are stored, later ones arrive.
STREAM_START = "2024-01-16"
# Ratings of this kind have no stored dish and must be ignored by the merge.
UNSTORED_DISH = "error"


class Tables:
    """Test tables below one folder, and the stand-ins made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def read_spread(self, name: str, *columns: str, key: list[str]) -> DataFrame:
        """Columns of a table that may be one file with one row group, so one split."""
        return spread_small(self.read(name).select(*columns), *key)

    def business(self) -> DataFrame:
        region = self.read("region").select("r_regionkey", F.upper(F.substring("r_name", 1, 2)).alias("state"))
        nation = self.read("nation").select(
            "n_nationkey", "n_regionkey", F.replace("n_name", F.lit("_"), F.lit(" ")).alias("city")
        )
        cities = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        key = F.col("s_suppkey")
        return self.read("supplier").join(cities, F.col("s_nationkey") == F.col("n_nationkey")).select(
            key.cast("string").alias("business_id"),
            F.col("s_name").alias("name"),
            F.concat("s_name", F.lit("\\n"), "city").alias("full_address"),
            "city",
            "state",
            (1 + (key % 9) * 0.5).cast("double").alias("stars"),
            (key * 7 % 300).cast("long").alias("review_count"),
        )

    def dictionary_lines(self) -> DataFrame:
        words = F.split("p_name", " ")
        line = F.concat(words[0], F.lit("|"), words[1], F.lit(":"), F.col("p_name"))
        return self.read("part").select("p_name").distinct().select(line.alias("value"))

    def mentions(self) -> DataFrame:
        part = self.read("part").select("p_partkey", "p_name")
        line = self.read_spread(
            "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate",
            key=["l_orderkey"],
        )
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").cast("string").alias("business_id"),
            F.col("p_name").alias("dish"),
            (1 + (F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast("int").alias("score"),
            F.concat("p_name", F.lit(" in order "), F.col("l_orderkey").cast("string")).alias("promo_text"),
            F.to_date("l_shipdate").alias("promo_date"),
            F.when(F.col("l_returnflag") == "R", "tip").otherwise("review").alias("kind"),
        )

    def reviews(self) -> DataFrame:
        key = F.col("doc_id")
        return self.read_spread("documents", "doc_id", "text", key=["doc_id"]).select(
            (key % 10).cast("string").alias("business_id"),
            "text",
            self._date(key).alias("date"),
            F.concat(F.lit("review-"), key.cast("string")).alias("review_id"),
        )

    def tips(self) -> DataFrame:
        key = F.col("conv_id")
        return self.read_spread("conversations", "conv_id", "turn", "text", key=["conv_id", "turn"]).select(
            (key % 10).cast("string").alias("business_id"),
            "text",
            self._date(key).alias("date"),
            F.concat(F.lit("tip-"), key.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("review_id"),
        )

    @staticmethod
    def _date(key):
        month = F.lpad((1 + key % 12).cast("string"), 2, "0")
        day = F.lpad((1 + key % 28).cast("string"), 2, "0")
        return F.concat(F.lit("2024-"), month, F.lit("-"), day)

    def rating_messages(self, events: DataFrame | None = None) -> DataFrame:
        """Messages ``(ts, event_id, key, value)``, some with three or four fields."""
        if events is None:
            events = self.read_spread("events", "event_id", "ts", "user_id", "event_type", key=["event_id"])
        event, user = F.col("event_id"), F.col("user_id").cast("string")
        city = F.concat(F.lit("NATION"), (F.col("user_id") % 25).cast("string"), F.lit("AF"))
        score = (1 + event % 5).cast("string")
        note = F.concat(F.lit("note "), event.cast("string"), F.lit(", with comma"))
        value = (
            F.when(event % 97 == 0, F.concat_ws(",", "event_type", user, F.lit("broken")))
            .when(event % 11 == 0, F.concat_ws(",", "event_type", user, city, score))
            .otherwise(F.concat_ws(",", "event_type", user, city, score, note))
        )
        return events.select("ts", "event_id", F.concat("event_type", user).alias("key"), value.alias("value"))

    def completion_responses(self, *kept: str) -> DataFrame:
        """One response per part; its second result must be ignored."""
        kind = F.get(F.split("p_name", " "), F.lit(1))

        def completion(kind, value):
            return F.struct(kind.alias("type"), value.alias("value"))

        wanted = F.struct(
            F.lit("dish").alias("result_type"),
            F.array(
                completion(kind, F.col("p_name")),
                completion(F.lower("p_type"), F.concat(F.lower("p_type"), F.lit(" "), kind)),
            ).alias("completion_list"),
        )
        other = F.struct(
            F.lit("restaurant").alias("result_type"),
            F.array(completion(F.lit("brand"), F.col("p_brand"))).alias("completion_list"),
        )
        return self.read("part").select(
            *kept, F.to_json(F.struct(F.array(wanted, other).alias("result_list"))).alias("value")
        )

    def damaged_responses(self) -> DataFrame:
        """The responses, with one of each of three kinds among every 50 parts damaged."""
        whole = self.completion_responses("p_partkey")
        at = F.col("p_partkey") % 50
        damaged = (
            F.when(at == 1, F.expr("left(value, length(value) div 2)")).when(at == 2, "  ")
            .when(at == 3, F.concat(F.lit('{"status": "'), F.col("p_partkey").cast("string"), F.lit('"}'))).otherwise(F.col("value"))
        )
        return whole.select(damaged.alias("value"))

    def _words(self) -> DataFrame:
        """Distinct words of the documents."""
        sentences = F.transform(sentences_of(F.col("text")), words_of)
        return self.reviews().select(F.explode(F.array_distinct(F.flatten(sentences))).alias("word")).distinct()

    def word_dictionary(self) -> DataFrame:
        """Every word of seven letters or more as an item, by its first letter."""
        long = self._words().where(F.length("word") >= 7)
        return long.select(F.substring("word", 1, 1).alias("category"), F.col("word").alias("item"))

    def pair_dictionary(self) -> DataFrame:
        """The first two words of every sentence as an item."""
        words = F.transform(sentences_of(F.col("text")), words_of)
        first = F.transform(F.filter(words, lambda w: F.size(w) >= 2), lambda w: F.array_join(F.slice(w, 1, 2), " "))
        items = self.reviews().select(F.explode(F.array_distinct(first)).alias("item")).distinct()
        return items.select(F.substring("item", 1, 1).alias("category"), "item")

    def ending_table(self) -> DataFrame:
        """Pairs ``(form, lemma)``: words whose ending leaves another word of the documents.

        Every other one by a digest is a pair to learn from, the others are held out.
        """
        words = self._words().where(F.length("word") >= 3)
        rewrites = F.array(*[F.struct(F.lit(a).alias("ending"), F.lit(b).alias("becomes")) for a, b in ENDINGS])
        cut = words.select("word", F.explode(rewrites).alias("r")).where(F.col("word").endswith(F.col("r.ending")))
        stem = F.substr("word", F.lit(1), F.length("word") - F.length("r.ending"))
        pairs = cut.select(F.col("word").alias("form"), F.concat(stem, "r.becomes").alias("lemma"))
        known = pairs.join(words.select(F.col("word").alias("lemma")), "lemma", "left_semi")
        return known.groupBy("form").agg(F.min("lemma").alias("lemma")).withColumn(
            "held_out", F.substring(F.md5(F.col("form").cast("binary")), 1, 1) >= "8"
        )

    def modifiers(self) -> DataFrame:
        return self.inline(MODIFIERS, ["word", "kind", "factor"])

    def word_lexicon(self) -> DataFrame:
        """A polarity from -2 to 2 for every word, and one more for long words."""
        every, more = F.length("word") % 5 - 2, F.when(F.length("word") >= 9, F.lit(1))
        both = F.filter(F.array(every, more), lambda p: p.isNotNull())
        return self._words().select("word", F.explode(both).alias("polarity"))

    def text_dictionary(self) -> DataFrame:
        return self.inline(TEXT_DICTIONARY, ["category", "item"])

    def lemma_table(self) -> DataFrame:
        return self.inline(LEMMAS, ["form", "lemma"])

    def lexicon(self) -> DataFrame:
        return self.inline(LEXICON, ["word", "polarity"])

    def inline(self, rows: list[tuple], names: list[str]) -> DataFrame:
        """Small parameter table as a local relation, whose size Spark knows."""

        def literal(value):
            return "'" + value + "'" if isinstance(value, str) else str(value)

        values = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
        return self.spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
