"""Packing token pieces into sequences of fixed size.

1. Each text is tokenised and cut into pieces of at most ``capacity`` tokens.
2. The lengths' histogram (at most ``capacity`` rows) goes to the driver. There the
   configuration linear program is solved by multiplicative weights. Lengths are put in
   classes (of two neighbouring lengths, more in small tables), which are the constraints:
   each is to be covered as often as it has pieces. A round prices the classes by their
   size and how far they are covered, finds the configuration of most worth by a bounded
   knapsack (dynamic programming over binary parts of the copies), and takes as much of
   it as the narrowest of its classes allows: no step covers a class by more than ``STEP``,
   whatever the widths of the program are. It ends when every class is covered but for
   ``1 - COVERED``.
3. Rounding takes whole numbers of each configuration, carrying the fractions on, within
   the demand, and deals the pieces of each class to the slots. Only what is left over is
   filled best-fit, in decreasing length, whole groups of equal sequences at a time. The
   work depends on ``capacity``, not on the table.
4. Each piece gets its number among the pieces of its length (counted per bucket, so
   that a frequent length is no single group), and the plan tells its sequence and place.

Defined results: a null or empty text is one piece that holds only the end id; an added
token that is written out in a text is one id, as the tokenizer reads it; repeated rows,
also of equal or null ids, are packed each by itself; equal lengths are placed in order of
id and piece, so results do not depend on partitions as far as ids differ; an empty table
gives an empty result. A text is never cut before it is tokenised: a worker holds it, its
words and its ids, some twenty times its bytes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .staging import bucket, plain, ready, shuffle_partitions, staged

CAPACITY = 2048
END_ID = 0
# Bounds of the program: rounds, classes, sizes priced in a round (so many of each of
# ``STRATA`` ranges of sizes, the least covered ones).
ROUNDS = 4_000
CLASSES = 1_024
PRICED = 256
STRATA = 16
# Pieces that a class has on the average, at least.
CLASS_PIECES = 8
# Share of a class that a step covers at most, share that must be covered in the end.
STEP = 0.5
COVERED = 0.955
# How fast a class loses worth as it is covered, and how much a large size is preferred.
LEARNING = 0.5
LARGE_FIRST = 0.05
# Pieces numbered together.
NUMBERED_TOGETHER = 20_000

# Entries of the memos of one Python worker; beyond them work is repeated, not lost.
RUN_MEMO = 200_000
WORD_MEMO = 200_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
# White space of Unicode; unlike str.split it leaves out 0x1c to 0x1f.
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MARKS = ".,!?;:"


def _byte_letters() -> dict[int, str]:
    """Letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of a lower-casing byte-level tokenizer that never joins text across white space.

    Each run of text without white space is looked up in a memo. Runs of Latin-1
    texts are stable under the tokenizer's normal form and need no pattern when they
    are letters, with marks behind them or not: their letters go to the tokenizer's
    model directly. All others go through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _letters(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            text = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
            ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            if len(self.words) < WORD_MEMO:
                self.words[word] = ids
        return ids

    def _whole(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()

    def _latin(self, run: str) -> bytes:
        word = run.rstrip(_MARKS)
        if not word.isalpha():
            return self._whole(run)
        marks = run[len(word):]
        return self._letters(word) + self._letters(marks) if marks else self._letters(word)

    def encode(self, text: str) -> bytes:
        """Ids of a text as the bytes of unsigned 32-bit integers."""
        lower = text.lower()
        if any(token in text or token in lower for token in self.added):
            # Written in small letters or not makes a difference here, which memos do not know.
            return self._whole(text)
        try:
            text.encode("latin-1")
            text, single = lower, self._latin
        except UnicodeEncodeError:
            single = self._whole
        known, out = self.known, []
        for run in _SPACE.split(text) if _ODD_SPACE.search(text) else text.split():
            ids = known.get(run)
            if ids is None:
                ids = single(run)
                if len(known) < RUN_MEMO:
                    known[run] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces_column(text: Column, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> Column:
    """Pieces ``array<struct<length, ids_crc32>>`` of each text's ids and the end id."""

    @F.arrow_udf("array<struct<length: int, ids_crc32: bigint>>")
    def pieces(texts: pa.Array) -> pa.Array:
        own, end = word_tokenizer(path), np.array([end_id], dtype="<u4").tobytes()
        counts, lengths, sums = [0], [], []
        for at in range(0, len(texts), 500):
            for one in texts.slice(at, 500).to_pylist():
                ids = own.encode(one or "") + end
                for begin in range(0, len(ids), 4 * capacity):
                    part = ids[begin:begin + 4 * capacity]
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                counts.append(len(lengths))
        rows = pa.StructArray.from_arrays(
            [pa.array(lengths, pa.int32()), pa.array(sums, pa.int64())], names=["length", "ids_crc32"]
        )
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows)

    return pieces(text)


@dataclass
class Group:
    """Equal sequences: how many, the slots ``(length, copies)`` of each, and room left."""

    count: int
    slots: list[tuple[int, int]] = field(default_factory=list)
    room: int = 0


def best_configuration(prices: np.ndarray, sizes: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """Bounded knapsack by dynamic programming: index of a size to copies, worth most at these prices."""
    parts: list[tuple[int, int]] = []
    for i in range(len(sizes)):
        copies, part = min(int(most[i]), capacity // int(sizes[i])), 1
        while copies > 0:
            parts.append((i, min(part, copies)))
            copies -= part
            part *= 2
    worth = np.zeros(capacity + 1)
    taken = np.zeros((len(parts), capacity + 1), dtype=bool)
    for row, (i, copies) in enumerate(parts):
        size = int(sizes[i]) * copies
        with_it = worth[:capacity + 1 - size] + prices[i] * copies
        np.greater(with_it, worth[size:], out=taken[row, size:])
        np.maximum(with_it, worth[size:], out=worth[size:])
    found: dict[int, int] = {}
    room = capacity
    for row in range(len(parts) - 1, -1, -1):
        if taken[row, room]:
            i, copies = parts[row]
            found[i] = found.get(i, 0) + copies
            room -= int(sizes[i]) * copies
    return found


def _priced(covered: np.ndarray, strata: np.ndarray) -> np.ndarray:
    """The least covered classes of every range of sizes that are still open, in order of size."""
    is_open = np.flatnonzero(covered < COVERED)
    order = is_open[np.lexsort((covered[is_open], strata[is_open]))]
    own = strata[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    # Ranges with few open classes leave their share to the others.
    return np.sort(order[np.argsort(place, kind="stable")[:PRICED]])


def configurations(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[list[tuple[dict[int, int], float]], np.ndarray]:
    """Fractional solution of the configuration program, and how far each size is covered.

    The solution is configurations (index of a size to copies) and how often each is taken.
    """
    covered = np.zeros(len(sizes))
    worth = sizes.astype(float) ** (1 + LARGE_FIRST)
    strata = np.minimum(sizes * STRATA // (capacity + 1), STRATA - 1)
    chosen: dict[tuple, float] = {}
    for _ in range(rounds):
        priced = _priced(covered, strata)
        if not len(priced):
            break
        weights = worth[priced] * np.exp(-LEARNING * covered[priced])
        found = best_configuration(weights, sizes[priced], demand[priced], capacity)
        key = tuple((int(priced[i]), n) for i, n in sorted(found.items()))
        step = min(min(STEP, 1 - covered[i]) * demand[i] / n for i, n in key)
        chosen[key] = chosen.get(key, 0.0) + step
        for i, n in key:
            covered[i] += step * n / demand[i]
    return [(dict(key), amount) for key, amount in chosen.items()], covered


def unit_of(pieces: int, capacity: int) -> int:
    """Neighbouring lengths of one class: a power of two."""
    unit = 1
    while unit < capacity and (capacity // unit > CLASSES or pieces * unit < CLASS_PIECES * capacity):
        unit *= 2
    return unit


def _dealt(taken: list[list[tuple[int, int]]], count: int) -> Iterator[tuple[int, list[int]]]:
    """``(sequences, their lengths)`` of ``count`` sequences whose slots are filled by runs ``(length, pieces)``."""
    places = [0] * len(taken)
    left = [runs[0][1] for runs in taken]
    while count:
        here = min(left)
        yield here, [runs[at][0] for runs, at in zip(taken, places)]
        count -= here
        for slot, runs in enumerate(taken):
            left[slot] -= here
            if not left[slot] and count:
                places[slot] += 1
                left[slot] = runs[places[slot]][1]


def rounded(
    sizes: np.ndarray, left: np.ndarray, solution: Sequence[tuple[dict[int, int], float]], class_of: np.ndarray, capacity: int
) -> list[Group]:
    """Whole numbers of each configuration as groups of sequences; ``left`` loses the pieces they hold.

    ``class_of`` is each length's class. A class's pieces fill a configuration's slots from
    its longest length on in one slot and from its shortest in the next, so that the sums of
    a group differ little.
    """
    members = [np.flatnonzero(class_of == k) for k in range(int(class_of.max()) + 1)]
    spare = np.array([left[m].sum() for m in members])
    groups: list[Group] = []
    carried = 0.0
    for configuration, amount in solution:
        carried += amount
        count = min(int(carried + 1e-9), *(int(spare[k]) // n for k, n in configuration.items()))
        carried = min(carried - count, 1.0)
        if count <= 0:
            continue
        taken, down = [], True
        for k, n in configuration.items():
            spare[k] -= count * n
            for _ in range(n):
                runs, wanted = [], count
                for i in members[k][::-1] if down else members[k]:
                    some = min(wanted, int(left[i]))
                    if some:
                        runs.append((int(sizes[i]), some))
                        left[i] -= some
                        wanted -= some
                taken.append(runs)
                down = not down
        for sequences, lengths in _dealt(taken, count):
            slots = [(size, lengths.count(size)) for size in sorted(set(lengths), reverse=True)]
            groups.append(Group(sequences, slots, capacity - sum(lengths)))
    return groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[Group]:
    """Groups of equal sequences that hold every piece of the histogram once."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    groups: list[Group] = []
    if len(sizes) and sizes[-1] == capacity:
        groups.append(Group(int(left[-1]), [(capacity, 1)]))
        sizes, left = sizes[:-1], left[:-1]
    if not len(sizes):
        return groups
    unit = unit_of(int(left.sum()), capacity)
    # A class is as large as its longest length could be; sizes are counted in units.
    classes, class_of = np.unique(-(-sizes // unit), return_inverse=True)
    demand = np.bincount(class_of, weights=left).astype(np.int64)
    solution, _ = configurations(classes, demand, capacity // unit, rounds)
    groups += rounded(sizes, left, solution, class_of, capacity)
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []

    def offer(group: Group) -> None:
        if group.count and group.room >= sizes[0]:
            if group.room not in by_room:
                by_room[group.room] = []
                rooms.insert(bisect_right(rooms, group.room), group.room)
            by_room[group.room].append(group)

    for group in groups:
        offer(group)
    for i in range(len(sizes) - 1, -1, -1):
        size, count = int(sizes[i]), int(left[i])
        while count:
            at = bisect_right(rooms, size - 1)
            if at == len(rooms):
                per = capacity // size
                for number, copies in ((count // per, per), (1, count % per)):
                    if number and copies:
                        fresh = Group(number, [(size, copies)], capacity - size * copies)
                        groups.append(fresh)
                        offer(fresh)
                break
            room = rooms[at]
            group = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            # As many pieces into each sequence as fit, in as many sequences as they fill.
            copies = min(room // size, count)
            filled = min(group.count, count // copies)
            if filled < group.count:
                rest = Group(group.count - filled, list(group.slots), group.room)
                group.count = filled
                groups.append(rest)
                offer(rest)
            group.slots.append((size, copies))
            group.room -= size * copies
            count -= filled * copies
            offer(group)
    return groups


def place_column(length: Column, number: Column, groups: Sequence[Group]) -> Column:
    """``struct<sequence_id, offset>`` of the piece with this number among its length."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for group in groups:
        offset = 0
        for size, copies in group.slots:
            first = used.get(size, 0)
            runs.setdefault(size, []).append((first, group.count, base, offset))
            used[size] = first + group.count * copies
            offset += size * copies
        base += group.count
    table = {size: np.array(rows, dtype=np.int64) for size, rows in runs.items()}

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        size, rank = np.asarray(lengths, dtype=np.int64), np.asarray(numbers, dtype=np.int64)
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for one in np.unique(size):
            here = size == one
            rows, own = table[int(one)], rank[here]
            run = rows[np.searchsorted(rows[:, 0], own, side="right") - 1]
            within = own - run[:, 0]
            sequence[here] = run[:, 2] + within % run[:, 1]
            offset[here] = run[:, 3] + within // run[:, 1] * one
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    return place(length, number)


def numbered(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add ``number``, from 0, among the pieces of one ``length``."""
    rows = pieces.withColumn("bucket", bucket(F.struct("id", "piece"), buckets))
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    counts = counts.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32"))
    return rows.withColumn("own", own).join(counts, ["length", "bucket"]).withColumn(
        "number", F.col("own") - 1 + F.col("before")
    )


def pack(
    df: DataFrame, path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    end_id: int = END_ID, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    spark = ready(df.sparkSession)
    docs = plain(df, id=id, text=text)
    cut = docs.select("id", F.posexplode(pieces_column(F.col("text"), path, capacity, end_id)).alias("piece", "p"))
    pieces = staged(cut.select("id", "piece", "p.length", "p.ids_crc32"), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = plan(histogram, capacity, rounds)
    buckets = max(shuffle_partitions(spark), -(-sum(histogram.values()) // NUMBERED_TOGETHER))
    rows = numbered(pieces, buckets).withColumn("at", place_column(F.col("length"), F.col("number"), groups))
    return rows.select(
        F.col("id").alias(id), "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("length").cast("long").alias("length"), "ids_crc32", "at.sequence_id", "at.offset",
    )
