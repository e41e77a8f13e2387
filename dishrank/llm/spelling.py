"""Spelling variants: words one edit apart, and the frequent form each stands for.

Texts are cut into letter runs and counted; the vocabulary that is left is compared with
itself. Two words one edit apart agree in the first or in the last half of the shorter
one, so each word goes to the groups of its two halves, for the lengths it can be the
shorter or the longer word of. A group too large for one list is halved again in the part
that is still open, until it is small or less than two code points are open. That is exact:
a pair goes on through the front halves if these agree and else through the back halves,
so it is found in one group only.

Each group is a sorted list. For every word the list behind it is scanned with a banded
edit matrix (three distances a row): rows of the prefix that a list word shares with the
one before are used again, and when a row exceeds one edit all list words with that
prefix are skipped.

Defined results: a null text has no words; rows with a null id or of equal ids count each
for itself; words are compared by code points, without normalisation; an empty vocabulary
gives an empty result. Other columns are ignored. Texts are cut between runs into pieces
of about ``PIECE`` code points first, so a very long one is never one array of words;
memory is some five times the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import partitions_for, ready, staged

LETTERS = r"A-Za-zÀ-ÿ"
PIECE = 1 << 16

LEAST_LENGTH = 6
LEAST_COUNT = 5
# A form is at least this many times as frequent as the word it stands for.
FORM_RATIO = 5

# Words of one list; a larger group is halved again.
GROUP_WORDS = 256
# Rows of the groups that one task takes.
TASK_ROWS = 20_000

PAIRS = "word string, near string, near_n long"
FAR = 1 << 20


# Words and their counts.


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, run)``: every maximal run of letters of every text."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    cut = F.regexp_extract_all(whole, F.lit(rf"(?s).{{0,{PIECE}}}[{LETTERS}]*"), F.lit(0))
    pieces = F.when(F.length(whole) <= PIECE, F.array(whole)).otherwise(cut)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.explode(pieces).alias("piece"))
    return rows.select("id", F.explode(F.regexp_extract_all("piece", F.lit(f"[{LETTERS}]+"), F.lit(0))).alias("run"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)`` of words long and frequent enough, from one row per occurrence in ``word``."""
    long = words.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# One sorted list.


def _shared(a: str, b: str) -> int:
    """Code points of the common prefix."""
    if a == b[:len(a)]:
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _row(above: tuple[int, int, int], word: str, done: int, letter: str) -> tuple[int, int, int]:
    """Distances of a prefix of ``done`` + 1 code points to ``done``, + 1 and + 2 of ``word``.

    ``above`` is the row of the prefix before; ``letter`` is the code point it grows by.
    """
    shorter, equal, longer = above
    size = len(word)
    if done > size:
        return FAR, FAR, FAR
    left = equal + 1
    if done and shorter + (word[done - 1] != letter) < left:
        left = shorter + (word[done - 1] != letter)
    if done == size:
        return left, FAR, FAR
    middle = min(equal + (word[done] != letter), longer + 1, left + 1)
    if done + 1 == size:
        return left, middle, FAR
    return left, middle, min(longer + (word[done + 1] != letter), middle + 1)


def near_pairs(words: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Places ``i < j`` of a sorted list whose words are exactly one edit apart."""
    count = len(words)
    shared = [0] + [_shared(a, b) for a, b in zip(words, words[1:])] + [-1]
    # Next place whose word shares less with the one before it.
    later = [count] * (count + 1)
    for at in range(count - 1, -1, -1):
        to = at + 1
        while shared[to] >= shared[at]:
            to = later[to]
        later[at] = to
    for i, word in enumerate(words[:-1]):
        size, at = len(word), i + 1
        rows = [(FAR, 0, 1 if size else FAR)]
        while at < count:
            target = words[at]
            for done in range(len(rows) - 1, len(target)):
                row = _row(rows[-1], word, done, target[done])
                if min(row) > 1:
                    # So is every list word with this prefix.
                    at += 1
                    while shared[at] > done:
                        at = later[at]
                    break
                rows.append(row)
            else:
                more = size - len(target)
                if -1 <= more <= 1 and rows[-1][more + 1] == 1:
                    yield i, at
                at += 1
            del rows[max(shared[at], 0) + 1:]


# Groups of words that agree in a half.


def halves(path: str, length: int) -> Iterator[tuple[str, int, int, int]]:
    """Moves of a path with the code points taken in front, behind, and by the move."""
    front = back = 0
    for move in path:
        taken = (length - front - back) // 2
        yield move, front, back, taken
        front, back = (front + taken, back) if move == "F" else (front, back + taken)


def met_here(a: str, b: str, path: str, length: int) -> bool:
    """Whether a pair whose shorter word has ``length`` code points belongs to this group."""
    if min(len(a), len(b)) != length:
        return False
    for move, front, back, taken in halves(path, length):
        ahead = a[front:front + taken] == b[front:front + taken]
        if move == "F" and not ahead:
            return False
        if move == "B" and (ahead or a[len(a) - back - taken:len(a) - back] != b[len(b) - back - taken:len(b) - back]):
            return False
    return True


def _scan(table: pa.Table) -> pa.Table:
    lists: dict[tuple, dict[str, int]] = {}
    for row in table.select(["key", "path", "length", "word", "n"]).to_pylist():
        lists.setdefault((row["key"], row["path"], row["length"]), {})[row["word"]] = row["n"]
    found: list[tuple[str, str, int]] = []
    for (_, path, length), counts in lists.items():
        if len(counts) == 1 or min(map(len, counts)) > length:
            continue
        # Words that agree behind are sorted from behind, so that they share prefixes.
        turn = -1 if path.startswith("B") else 1
        turned = sorted(word[::turn] for word in counts)
        for i, j in near_pairs(turned):
            a, b = turned[i][::turn], turned[j][::turn]
            if met_here(a, b, path, length):
                found += [(a, b, counts[b]), (b, a, counts[a])]
    columns = list(zip(*found)) if found else [[]] * 3
    kinds = [pa.string(), pa.string(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "near", "near_n"])


def _open(length: Column) -> Column:
    return length - F.col("front") - F.col("back")


def _halved(rows: DataFrame) -> DataFrame:
    """Each row in its two halves: one more part in front, or one more behind, must agree."""
    taken = F.floor(_open(F.col("length")) / 2).cast("int")
    moves = F.array(
        F.struct(F.lit("F").alias("move"), taken.alias("front"), F.lit(0).alias("back")),
        F.struct(F.lit("B").alias("move"), F.lit(0).alias("front"), taken.alias("back")),
    )
    split = rows.select("word", "n", "length", "path", "front", "back", F.explode(moves).alias("m")).select(
        "word", "n", "length", F.concat("path", "m.move").alias("path"),
        (F.col("front") + F.col("m.front")).alias("front"), (F.col("back") + F.col("m.back")).alias("back"),
    )
    kept = F.concat_ws(
        "\n", "path", "length", F.substr("word", F.lit(1), F.col("front")),
        F.substr("word", F.length("word") - F.col("back") + 1, F.col("back")),
    )
    return split.withColumn("key", F.unhex(F.md5(kept.cast("binary"))))


def grouped(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """``(key, path, length, word, n)``: words by what they agree in; any pair meets in one group."""
    lengths = F.array_distinct(F.array(F.greatest(F.length("word") - 1, F.lit(1)), F.length("word")))
    rows = words.select(
        "word", "n", F.explode(lengths).alias("length"), F.lit("").alias("path"), F.lit(0).alias("front"), F.lit(0).alias("back")
    )
    short = F.col("length") < 2
    whole = rows.where(short).withColumn("key", F.unhex(F.md5(F.col("length").cast("string").cast("binary"))))
    columns = ["key", "path", "length", "word", "n"]
    ready_rows, rows = [whole.select(*columns)], staged(_halved(rows.where(~short)), "halves")
    while True:
        sizes = rows.where(_open(F.col("length")) >= 2).groupBy("key").agg(F.count(F.lit(1)).alias("words"))
        large = staged(sizes.where(F.col("words") > most).select("key"), "large")
        if large.isEmpty():
            ready_rows.append(rows.select(*columns))
            break
        ready_rows.append(rows.join(large, "key", "left_anti").select(*columns))
        rows = staged(_halved(rows.join(large, "key", "left_semi")), "halves")
    result = ready_rows[0]
    for more in ready_rows[1:]:
        result = result.union(more)
    return result


def near_words(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """``(word, near, near_n)`` for every ordered pair of words one edit apart."""
    rows = staged(grouped(words, most), "groups")
    count = partitions_for(words.sparkSession, rows.count(), TASK_ROWS)
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
    return placed.groupBy("bucket").applyInArrow(_scan, PAIRS)


# Forms and their ends.


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: where the forms lead, from ``forms(word, form)``.

    Counts grow by a factor at every step, so there are no circles; each round doubles
    the steps taken, and chains are no longer than the logarithm of the largest count.
    """
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        after = staged(reached.join(ahead, "root", "left").select(
            "word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")
        ), "roots")
        reached = after.select("word", "root")
        if after.where("moved").isEmpty():
            return reached


def variant_groups(words: DataFrame, ratio: int = FORM_RATIO, most: int = GROUP_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of a vocabulary ``(word, n)``.

    ``form`` is the most frequent word one edit away (of equal counts the smallest), if
    it is ``ratio`` times as frequent; ``root`` is where the forms lead.
    """
    ready(words.sparkSession)
    words = staged(words.select("word", "n"), "vocabulary")
    near = near_words(words, most).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    frequent = -F.col("best.less") >= ratio * F.col("n")
    known = staged(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n"),
    ), "forms")
    ends = roots(known.where(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
