"""Looking up the words of many texts in a table of any size, without a row per word.

Rows are dealt to slices of bounded size by a hash of their place. Each different word of a slice meets the
table once, and what is found there comes back to the slice, where every word of its texts
takes its value. So what moves is the rows and the different words of each slice, and no word
of a text is sorted or kept apart from it; rows of one text are in many slices. A slice is
looked up by Arrow's own hash table in one call; which words a text has is up to the
caller's column expression.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.stages import Stage, fresh

# Bytes of a slice as it is written; a row of more is whole in one slice.
SLICE_BYTES = 8 << 20
# Slices at least for each task slot, so that they are dealt evenly.
SLICES_PER_SLOT = 4


def size_of(written: DataFrame) -> int:
    """Spark's own size of a table of files."""
    return int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _is_written(rows: DataFrame) -> bool:
    """Whether rows are a whole table of Parquet files."""
    plan = rows._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.toString().lower()


def is_small(written: DataFrame) -> bool:
    """Whether Spark broadcasts a table of files."""
    limit = written.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return size_of(written) <= limit


def looked_up(
    rows: DataFrame, text: str, words: Column, table: DataFrame, name: str, kind: T.DataType,
    use: Callable[[pa.ListArray, pa.Array], pa.Array], stage: Stage = fresh,
) -> DataFrame:
    """Add the column ``name`` of type ``kind``, made of what ``table(word, value)`` has for ``words``.

    ``words`` makes an array of words of the column ``text``; a null one is empty. A word is in the table once.
    ``use`` gets the arrays of words of many rows, and for all their words one after another the
    value or null; it gives one entry per row. Rows are written first (those that are a table
    of Parquet files are taken as they are), so which slice a row is dealt to is settled and
    their size is known.
    """
    written = rows if _is_written(rows) else stage(rows, "looked_up")
    slots = rows.sparkSession.sparkContext.defaultParallelism
    count = max(SLICES_PER_SLOT * slots, -(-size_of(written) // SLICE_BYTES))
    # By a row's place in the files, so that rows of one text are dealt to many slices.
    number = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(count)).cast("int").alias("slice")
    asked = written.select(number, F.col(text)).repartition(count, "slice")
    asked = asked.select("slice", F.explode(words).alias("word")).distinct()
    answers = asked.join(table.select("word", "value"), "word").select("slice", "word", "value")
    names = rows.columns
    # Words are made behind the exchange; the text alone is shorter.
    own = written.withColumn("own_slice", number).repartition(count, "own_slice").withColumn("slice_words", words)

    def meet(own: pa.Table, answers: pa.Table) -> pa.Table:
        lists = own["slice_words"].combine_chunks()
        at = pc.index_in(lists.flatten(), value_set=answers["word"].combine_chunks())
        made = use(lists, answers["value"].combine_chunks().take(at))
        return own.select(names).append_column(name, made)

    schema = T.StructType([*rows.schema.fields, T.StructField(name, kind)])
    return own.groupBy("own_slice").cogroup(answers.groupBy("slice")).applyInArrow(meet, schema)

