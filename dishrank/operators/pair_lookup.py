"""Which pairs of neighbouring words of many texts a table of any size may hold.

For a table of pairs too large to broadcast. What moves is 32 bits for each different pair
of a slice of texts: texts are written first, a slice is some rows of a file in a row, and
its pairs go packed to the parts of the exchange that hold the pairs of the table. Those
that are there come back to the slice, where the texts look at their pairs again and keep
the places that count. A pair that every text has is one entry of each slice, and no word
moves by itself.

A pair is known here by its part and 32 bits more, so a few that are not in the table come
back as well. Whoever takes the places compares the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences_of, words_of
from ..sources.stages import Stage
from .lookup import is_small, size_of

# Bytes of a slice as it is written, on an average; a row of more is whole in one slice.
SLICE_BYTES = 2 << 20
# Written bytes of texts and of the table that one part of an exchange stands for.
PART_BYTES = 8 << 20
# Pairs of the table that are packed together.
PACKED_PAIRS = 1 << 20

PACKED = "part int, slice long, pairs binary"


def is_large(table: DataFrame) -> bool:
    """Whether a table of files is too large to broadcast, so that pairs are looked up in slices."""
    return not is_small(table)


def split_texts(keyed: DataFrame, stage: Stage) -> DataFrame:
    """``(text_key, sentences)`` of ``keyed(text_key, text)``, written, without texts that have no sentence."""
    found = keyed.select("text_key", sentences_of(F.col("text")).alias("sentences"))
    return stage(found.where(F.size("sentences") > 0), "sentences")


def sliced(texts: DataFrame) -> Column:
    """Number of a row's slice: so many rows in a row of a written file."""
    each = max(1, SLICE_BYTES * texts.count() // max(1, size_of(texts)))
    return F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {each}")).alias("slice")


def _pairs(parts: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives the number of each pair of hashed words: its part above 32 bits of its own."""

    def number(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        both = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        part = ((both >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return (part << np.uint64(32)) | (both & np.uint64(0xFFFFFFFF))

    return number


def _begins() -> Callable[[pa.ListArray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What gives the words of many sentences, the places of those with one behind, and the offsets of sentences."""

    def run(sentences: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = sentences.flatten().to_numpy(zero_copy_only=False)
        # Offsets from zero, whatever part of a longer array this is.
        offsets = sentences.offsets.to_numpy()
        offsets = offsets - offsets[0]
        begins = np.ones(len(words), bool)
        begins[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
        return words, np.flatnonzero(begins), offsets

    return run


def _packing() -> Callable[[np.ndarray, int], pa.RecordBatch]:
    """What packs different numbers of pairs, one row per part."""

    def run(numbers: np.ndarray, owner: int) -> pa.RecordBatch:
        numbers = np.unique(numbers)
        part = (numbers >> np.uint64(32)).astype(np.int32)
        edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        own = numbers.astype(np.uint32)
        packed = [own[a:b].tobytes() for a, b in zip(edges, np.r_[edges[1:], len(part)])]
        return pa.RecordBatch.from_arrays(
            [pa.array(part[edges], pa.int32()), pa.array(np.full(len(edges), owner), pa.int64()), pa.array(packed, pa.binary())],
            names=["part", "slice", "pairs"],
        )

    return run


def _asking(parts: int):
    """What packs the different pairs of each slice; its rows come one after another."""
    number, begins, pack = _pairs(parts), _begins(), _packing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, []
        for batch in batches:
            slices = batch.column("slice").to_numpy()
            edges = np.flatnonzero(np.r_[True, slices[1:] != slices[:-1]]) if len(slices) else []
            for a, b in zip(edges, np.r_[edges[1:], len(slices)]):
                if held and slices[a] != owner:
                    yield pack(np.concatenate(held), owner)
                    held = []
                owner = int(slices[a])
                words, at, _ = begins(batch.column("hashed").slice(a, b - a))
                held.append(np.unique(number(words[at], words[at + 1])))
        if held:
            yield pack(np.concatenate(held), owner)

    return run


def _listing(parts: int, bound: int):
    """What packs the pairs of the table."""
    number, pack = _pairs(parts), _packing()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(number(batch.column("first").to_numpy(), batch.column("second").to_numpy()))
            size += len(held[-1])
            if size >= bound:
                yield pack(np.concatenate(held), 0)
                held, size = [], 0
        if held:
            yield pack(np.concatenate(held), 0)

    return run


def _answering():
    """What keeps, of the pairs asked for, those that the table has."""

    def run(asked: pa.Table, listed: pa.Table) -> pa.Table:
        table = np.unique(np.frombuffer(b"".join(listed["pairs"].to_pylist()), np.uint32))
        rows = []
        if len(table):
            for part, owner, packed in zip(*(asked[name].to_pylist() for name in ("part", "slice", "pairs"))):
                pairs = np.frombuffer(packed, np.uint32)
                there = table[np.minimum(np.searchsorted(table, pairs), len(table) - 1)] == pairs
                if there.any():
                    rows.append((part, owner, pairs[there].tobytes()))
        kinds = {"part": pa.int32(), "slice": pa.int64(), "pairs": pa.binary()}
        return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())})

    return run


def _placing(parts: int, policy: str, reach: int):
    """What keeps the places whose pair is among the answers, of each text those that ``policy`` may take."""
    number, begins = _pairs(parts), _begins()
    kinds = {"text_key": pa.binary(), "sentence_pos": pa.int32(), "sentence": pa.string(), "places": pa.list_(pa.int32())}

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows or not answers.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        known = np.unique(np.concatenate([
            np.frombuffer(packed, np.uint32) | (np.uint64(part) << np.uint64(32))
            for part, packed in zip(answers["part"].to_pylist(), answers["pairs"].to_pylist())
        ]))
        hashed = own["hashed"].combine_chunks()
        per_text = hashed.offsets.to_numpy()
        per_text = per_text - per_text[0]
        words, at, per_sentence = begins(hashed.flatten())
        pairs = number(words[at], words[at + 1])
        at = at[known[np.minimum(np.searchsorted(known, pairs), len(known) - 1)] == pairs]
        sentence = np.searchsorted(per_sentence, at, side="right") - 1
        text = np.searchsorted(per_text, sentence, side="right") - 1
        if policy != "all" and len(at):
            # One sentence of each text, there the last place and those from which an item may begin behind it.
            heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
            tails = np.r_[heads[1:], len(at)] - 1
            run_of = np.cumsum(np.r_[False, text[1:] != text[:-1]])
            kept = sentence == sentence[tails if policy == "last" else heads][run_of]
            at, sentence, text = at[kept], sentence[kept], text[kept]
            tails = np.flatnonzero(np.r_[sentence[1:] != sentence[:-1], True])
            run_of = np.cumsum(np.r_[False, sentence[1:] != sentence[:-1]])
            kept = at > at[tails][run_of] - reach
            at, sentence, text = at[kept], sentence[kept], text[kept]
        heads = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(at) else np.zeros(0, np.int64)
        chosen = sentence[heads]
        places = pa.array((at - per_sentence[sentence]).astype(np.int32))
        return pa.table({
            "text_key": own["text_key"].combine_chunks().take(pa.array(text[heads])),
            "sentence_pos": pa.array((chosen - per_text[text[heads]]).astype(np.int32)),
            "sentence": own["sentences"].combine_chunks().flatten().take(pa.array(chosen)),
            "places": pa.ListArray.from_arrays(pa.array(np.r_[heads, len(at)].astype(np.int32)), places),
        })

    return run


class PairLookup:
    """The pairs of ``table(first, second)`` in written ``texts(text_key, sentences)``.

    ``hashed`` makes the 64 bits by which a word is in the table.
    """

    def __init__(self, texts: DataFrame, table: DataFrame, hashed: Callable[[Column], Column], stage: Stage):
        self.hashed = hashed
        self.texts = texts.select(sliced(texts), "text_key", "sentences")
        slots = texts.sparkSession.sparkContext.defaultParallelism
        size = size_of(texts)
        self.count = max(slots, -(-size // PART_BYTES))
        self.parts = max(slots, -(-(size + size_of(table)) // PART_BYTES))
        asked = self.texts.select("slice", F.explode("sentences").alias("sentence"))
        asked = asked.select("slice", self._words(F.col("sentence")).alias("hashed")).mapInArrow(_asking(self.parts), PACKED)
        listed = table.select("first", "second").mapInArrow(_listing(self.parts, PACKED_PAIRS), PACKED)
        asked, listed = (side.repartition(self.parts, "part").groupBy("part") for side in (asked, listed))
        self.answers = stage(asked.cogroup(listed).applyInArrow(_answering(), PACKED), "pairs_found")

    def _words(self, sentence: Column) -> Column:
        return F.transform(words_of(sentence), self.hashed)

    def places(self, policy: str, reach: int, only: DataFrame | None = None) -> DataFrame:
        """``(text_key, sentence_pos, sentence, places)`` of the pairs found in the texts, or in those of ``only(text_key)``.

        With ``policy`` other than ``all`` only those of one sentence of each text, its last
        or first one with a pair: the last place, and the ``reach - 1`` words before it.
        """
        own = self.texts if only is None else self.texts.join(only, "text_key", "left_semi")
        # Words are hashed behind the exchange; the sentences alone are shorter.
        own = own.repartition(self.count, "slice").withColumn("hashed", F.transform("sentences", self._words))
        answers = self.answers.repartition(self.count, "slice").groupBy("slice")
        kinds = "text_key binary, sentence_pos int, sentence string, places array<int>"
        return own.groupBy("slice").cogroup(answers).applyInArrow(_placing(self.parts, policy, reach), kinds)
