"""What each filter removes, alone and behind others, for every order of the filters.

Each document gets a row number when the facts about it are written, and every filter a
posting list of the numbers that fail it, sorted, per part and range of numbers. A block
(part and range) is then audited by merges of these lists alone: for each set of filters
that may come before, a galloping k-way union gives the documents already removed, and a
galloping difference the size of what the next filter removes beyond them. Sizes of all
blocks are added up, and every order reads its steps from the sums. Copies of a text are
found over the whole table by a 128-bit digest.

Ranges are bounded, so a part of a third of all documents is spread over many blocks. Texts
that occur again are a written table whose size is looked at: a small one is broadcast, for
a large one the join is salted.

Defined results: a null text is empty; a null part is the empty string; each row is a
document, so repeated rows count repeatedly; rows of one id do not copy each other and a
row without an id is no copy; a label holds if any label row of the id has it; an empty
table gives no rows. A text's words are held as one array while it is worked on.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import ready, staged

# Row numbers of one block.
RANGE_BITS = 16
_TASK_BITS = 33

# Texts that occur again, of 24 bytes each: up to so many are broadcast, beyond that the
# join is salted.
BROADCAST_ROWS = 200_000
SALTS = 16

LEAST_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COPY = "E"

SIZES = "part string, before int, filter int, removed long, good long, toxic long"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides by itself, one boolean per letter."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


# Posting lists: sorted row numbers without repeats.


def reach(ids: Sequence[int], value: int, at: int) -> int:
    """First place from ``at`` on whose id is not below ``value``, by doubling steps."""
    step, end = 1, len(ids)
    low = at
    while at < end and ids[at] < value:
        low, at = at + 1, at + step
        step *= 2
    return bisect_left(ids, value, low, min(at, end))


def union(lists: Sequence[Sequence[int]]) -> list[int]:
    """Ids in any of the lists; runs up to the next list's head move as a whole."""
    out: list[int] = []
    heads = [(ids[0], k, 0) for k, ids in enumerate(lists) if ids]
    heapq.heapify(heads)
    while len(heads) > 1:
        head, k, at = heads[0]
        ids, bound = lists[k], min(heads[1:3])[0]
        # A head that another list has as well is written by the last of them.
        stop = reach(ids, bound, at) if head < bound else at + 1
        if head < bound:
            out += ids[at:stop]
        if stop < len(ids):
            heapq.heapreplace(heads, (ids[stop], k, stop))
        else:
            heapq.heappop(heads)
    for _, k, at in heads:
        out += lists[k][at:]
    return out


def beyond(ids: Sequence[int], others: Sequence[int]) -> int:
    """How many ids the other list does not have."""
    count = at = place = 0
    while at < len(ids):
        if place == len(others):
            return count + len(ids) - at
        place = reach(others, ids[at], place)
        if place == len(others):
            continue
        if others[place] == ids[at]:
            at, place = at + 1, place + 1
        else:
            stop = reach(ids, others[place], at)
            count, at = count + stop - at, stop
    return count


def block_sizes(failing: list[list[int]], good: list[list[int]], toxic: list[list[int]]) -> list[tuple[int, ...]]:
    """``(before, filter, removed, good, toxic)`` for every set of filters before and each other one."""
    count, out = len(failing), []
    for before in range(1 << count):
        gone = union([failing[f] for f in range(count) if before >> f & 1])
        for f in range(count):
            if not before >> f & 1:
                out.append((before, f, beyond(failing[f], gone), beyond(good[f], gone), beyond(toxic[f], gone)))
    return out


def _audit(count: int) -> Callable[[pa.Table], pa.Table]:
    names = ["part", "before", "filter", "removed", "good", "toxic"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(block: pa.Table) -> pa.Table:
        lists = [[[] for _ in range(count)] for _ in range(3)]
        for row in block.select(["filter", "ids", "good", "toxic"]).to_pylist():
            for own, name in zip(lists, ("ids", "good", "toxic")):
                own[row["filter"]] = row[name]
        part = block.column("part")[0].as_py()
        rows = [(part, *sizes) for sizes in block_sizes(*lists)]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


# Facts about documents.


def numbered(
    df: DataFrame, id: str, text: str, part: str, filters: Callable[[Column], dict[str, Column]] = text_filters
) -> DataFrame:
    """Written facts ``(row, id, part, digest, <letters>)``, one row per document, without texts."""
    docs = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{part}`").alias("part"))
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    rows = docs.select(
        # Numbers are written here once; nothing later counts rows again.
        F.monotonically_increasing_id().alias("row"), "id", F.coalesce("part", F.lit("")).alias("part"),
        digest.alias("digest"), *[failed.alias(letter) for letter, failed in filters(F.col("text")).items()],
    )
    return staged(rows, "facts")


def with_copies(facts: DataFrame) -> DataFrame:
    """Facts with ``E``: whether a smaller id has the same text."""
    groups = facts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copied = staged(groups.where("first < last").select("digest", "first"), "copied")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    if copied.count() <= BROADCAST_ROWS:
        joined = facts.join(F.broadcast(copied), "digest", "left")
    else:
        # Copies of one text, a third of all rows perhaps, meet its row in several tasks.
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        salted = facts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = salted.join(copied.withColumn("salt", salts), ["digest", "salt"], "left").drop("salt")
    return joined.withColumn(COPY, later).drop("digest", "first")


def with_labels(facts: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """Facts with ``good`` and ``toxic``; both are false for a document without labels."""
    held = labels.select(F.col(f"`{id}`").alias("id"), "quality", "toxic").where(F.col("id").isNotNull())
    each = held.groupBy("id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    joined = facts.join(each, "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def posting_lists(facts: DataFrame, letters: Sequence[str]) -> DataFrame:
    """``(part, block, filter, ids, good, toxic)``: failing row numbers of a block, sorted."""
    failed = F.filter(
        F.array(*[F.when(F.col(letter), F.lit(f)) for f, letter in enumerate(letters)]), lambda f: f.isNotNull()
    )
    rows = facts.select("part", "row", "good", "toxic", F.explode(failed).alias("filter"))
    # The task that numbered a row, and the row's place there: no block is larger than its range.
    task, place = F.shiftright("row", _TASK_BITS), F.col("row").bitwiseAND((1 << _TASK_BITS) - 1)
    block = F.shiftleft(task, _TASK_BITS - RANGE_BITS) + F.shiftright(place, RANGE_BITS)

    def ids(held: Column | None = None) -> Column:
        return F.sort_array(F.collect_list(F.col("row") if held is None else F.when(held, F.col("row"))))

    return rows.groupBy("part", block.alias("block"), "filter").agg(
        ids().alias("ids"), ids(F.col("good")).alias("good"), ids(F.col("toxic")).alias("toxic")
    )


def _steps(letters: Sequence[str]) -> Column:
    """``(filter_order, step, before, filter)`` of all orders, as an array."""
    bits = {letter: f for f, letter in enumerate(letters)}
    rows = []
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order):
            rows.append(f"('{''.join(order)}', {step + 1}, {before}, {bits[letter]})")
            before |= 1 << bits[letter]
    kind = "array<struct<filter_order: string, step: int, before: int, filter: int>>"
    return F.expr(f"array({', '.join(rows)})").cast(kind)


def audit(
    df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source",
    filters: Callable[[Column], dict[str, Column]] = text_filters,
) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed and lost there.

    ``filters`` gives the failure conditions of a text by letter; the filter ``E``, texts
    that a smaller id has as well, is always added. ``labels`` holds ``quality`` and
    ``toxic`` by ``id``.
    """
    ready(df.sparkSession)
    facts = numbered(df, id, text, part, filters)
    letters = [c for c in facts.columns if c not in ("row", "id", "part", "digest")] + [COPY]
    known = with_labels(with_copies(facts), labels, id)
    lists = staged(posting_lists(known, letters), "postings")
    blocks = lists.groupBy("part", "block").applyInArrow(_audit(len(letters)), SIZES)
    sizes = staged(blocks.groupBy("part", "before", "filter").agg(
        *[F.sum(c).alias(c) for c in ("removed", "good", "toxic")]
    ), "sizes")

    count, others = len(letters), (1 << len(letters)) - 1
    places = F.bit_count("before")
    weights = [factorial(n) * factorial(count - 1 - n) for n in range(count)]
    orders = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), places + 1)
    whole = F.expr(f"before + shiftleft(1, filter) = {others}")
    per_filter = sizes.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(whole, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders).alias("shapley"),
    )
    parts = facts.groupBy("part").agg(F.count(F.lit(1)).alias("documents"))
    steps = parts.select("part", "documents", F.explode(_steps(letters)).alias("s")).select("part", "documents", "s.*")
    found = steps.join(sizes, ["part", "before", "filter"], "left").join(per_filter, ["part", "filter"], "left")

    def of(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long")

    rows = found.select(
        "part", "documents", "filter_order", "step", of("removed").alias("removed"),
        (of("failing") - of("removed")).alias("redundant"), of("unique_fails").alias("unique_fails"),
        of("good").alias("good_lost"), of("toxic").alias("toxic_lost"), of("shapley").alias("shapley"),
    )
    # An order's steps are few, so its running sum is a small group.
    so_far = F.sum("removed").over(Window.partitionBy("part", "filter_order").orderBy("step"))
    return rows.withColumn("kept", F.col("documents") - so_far).drop("documents")
