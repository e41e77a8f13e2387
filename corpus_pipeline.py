"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before it kept, written as Parquet and read again.
All but the last return the columns of ``documents``. A stage begins by deleting the work
tables of the one before: what a stage returns is to be written before the next one begins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishrank.llm import jaccard_join, language_id, packing, pii, substring_dedup
from dishrank.llm.staging import drop, ready, release, return_memory, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Texts less like every learned language than this are no text of any of them.
LEAST_SCORE = 0.1
# A text of this many n-grams (about five words) is also rejected below this share of the
# lowest score that such a text among those the profiles are fitted on has; a shorter one
# says too little to be told from letters at random.
JUDGED = 50
BELOW_LOWEST = 0.9


def _begin(spark: SparkSession) -> None:
    """What the stage before made on its way is of no more use."""
    ready(spark)
    return_memory(spark)
    release(spark)


def _with_text(df: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col(c)).alias(c) for c in COLUMNS])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones are in.

    Rejected are texts without letters, and those whose score is below a bound that the
    labelled texts set (``JUDGED``): letters at random, languages that were not learned.
    """
    _begin(spark)
    labelled = language_id.training_rows(docs)
    profiles = language_id.fit(labelled)
    lowest = language_id.lowest_score(labelled, profiles, JUDGED)
    bound = LEAST_SCORE if lowest is None else max(LEAST_SCORE, BELOW_LOWEST * lowest)
    return language_id.keep_known(docs.select(*COLUMNS), profiles, LEAST_SCORE, JUDGED, bound)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, rows without an id and of repeated ids included.

    The row of the smallest id stays, of one id or none the smallest set hash and then the
    smallest text. Rows without words are in no group: one of each id and text stays, and
    all without an id.
    """
    _begin(spark)
    first = jaccard_join.first_rows(docs)
    rows = docs.select(*COLUMNS)
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    keyed = rows.where(worded).select(
        F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
        jaccard_join.node_column(F.col("text")).alias("node"), F.struct("text", "doc_id", "lang", "source", "n_chars").alias("row"),
    )
    # Equal keys meet once per task, so frequent ones are in no single task.
    each = keyed.groupBy("unnamed", "id", "node").agg(F.min("row").alias("row"))
    chosen = each.join(first, ["unnamed", "id", "node"], "left_semi").select(*[f"row.{c}" for c in COLUMNS])
    wordless = rows.where(~worded)
    named = wordless.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "text"])
    return chosen.union(named).union(wordless.where(F.col("doc_id").isNull()))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; what is left empty goes."""
    _begin(spark)
    rows = substring_dedup.remove_repeated(docs, keep=("lang", "source"), untouched=True)
    return _with_text(rows.where(F.col("n_removed") < F.greatest("n_words", F.lit(1))), "kept_text")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    _begin(spark)
    return _with_text(docs.withColumn("clean", pii.redact_column(F.col("text"))), "clean")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard", one_of_similar),
    ("substring_dedup", without_repeats),
    ("pii", without_personal_data),
    ("packing", packed),
]

# Profiles and packing have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name, keep=True)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
