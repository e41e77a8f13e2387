"""Removal of lines that many documents have.

Texts are split into lines, each line is normalised (white space stripped at both ends,
A-Z lower-cased) and known by 128 bits, two hashes of different seeds. The hashes and places
of lines long enough are written, some 40 bytes a line, so texts are taken apart once.
Distinct documents are counted per line in two steps, by line and document and then by
line, so a line of a third of all documents is in no single task. Lines over the threshold,
one row each with the document that keeps it, go back to the places of the lines, and the
texts are put together again from the places that are left.

Defined results: a null or empty text is one empty line; a line that a document holds
several times counts once; rows of one id are one document; rows without an id count for
no line and lose none; of the documents that hold a frequent line the one of the largest
id keeps all its copies, whatever their places; repeated rows give repeated results; an
empty table gives an empty one. Columns of any other name are ignored unless named in
``keep``. A text's lines are held as one array while it is worked on, so a task needs a
few times the bytes of its longest text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import ready, staged, with_kept

LEAST_LENGTH = 40
LEAST_DOCUMENTS = 5

SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


LINE, ROW = ["line1", "line2"], ["row1", "row2"]


def _bits(names: list[str], *values: Column) -> list[Column]:
    """128 bits that stand for some values, as two columns."""
    first, second = names
    return [F.xxhash64(*values).alias(first), F.xxhash64(F.lit(second), *values).alias(second)]


def with_row_key(docs: DataFrame) -> DataFrame:
    """Rows of one id and one text lose the same lines, so they may share a key."""
    return docs.select("*", *_bits(ROW, F.col("id").cast("string"), F.coalesce("text", F.lit(""))))


def long_lines(docs: DataFrame, least_length: int) -> DataFrame:
    """``(id, row1, row2, place, line1, line2)`` of every line whose key has ``least_length`` code points."""
    lines = with_row_key(docs).select("id", *ROW, F.posexplode(lines_of(F.col("text"))).alias("place", "line"))
    # Normalising never makes a line longer.
    long = lines.where(F.length("line") >= least_length).withColumn("line", line_key(F.col("line")))
    return long.where(F.length("line") >= least_length).select("id", *ROW, "place", *_bits(LINE, F.col("line")))


def frequent_lines(held: DataFrame, least_documents: int) -> DataFrame:
    """``(line1, line2, keeper)`` of lines in enough documents, from rows of ``long_lines``."""
    once = held.select(*LINE, "id").distinct()
    counted = once.groupBy(*LINE).agg(F.count(F.lit(1)).alias("documents"), F.max("id").alias("keeper"))
    return counted.where(F.col("documents") >= least_documents).select(*LINE, "keeper")


def without_places(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the places in ``dropped``; null places drop nothing."""
    lines = lines_of(text)
    # Hashed, so the time is linear in the lines whatever is dropped.
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    joined = F.element_at(F.transform(
        F.array(lines), lambda held: F.array_join(F.transform(kept, lambda place: F.get(held, place)), "\n")
    ), 1)
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)


def drop_frequent(
    df: DataFrame, id: str = "doc_id", text: str = "text", least_documents: int = LEAST_DOCUMENTS,
    least_length: int = LEAST_LENGTH, keep: Sequence[str] = (),
) -> DataFrame:
    """Each document without its lines that ``least_documents`` documents hold.

    Returns ``id``, ``n_lines``, ``n_dropped``, ``kept_text`` and the columns named in
    ``keep``, one row per input row. Lines whose key is shorter than ``least_length``
    always stay.
    """
    ready(df.sparkSession)
    docs = with_kept(df, keep, id=id, text=text)
    named = docs.where(F.col("id").isNotNull())
    lines = staged(long_lines(named, least_length), "lines")
    frequent = staged(frequent_lines(lines, least_documents), "frequent_lines")
    gone = lines.join(frequent, LINE).where(F.col("id") != F.col("keeper"))
    dropped = gone.groupBy(*ROW, "id").agg(F.collect_set("place").alias("dropped"))
    # A row without an id matches none.
    rows = with_row_key(docs).join(dropped, [*ROW, "id"], "left")
    return rows.select(
        F.col("id").alias(id),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        without_places(F.col("text"), F.col("dropped")).alias("kept_text"),
        *[F.col(f"kept.`{c}`") for c in keep if c != id],
    )
