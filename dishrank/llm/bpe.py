"""Byte-level BPE by backtracking over longest matches, and decoding.

A piece of text is encoded from left to right: an Aho-Corasick automaton over the
vocabulary (bytes mapped to Latin-1) gives the longest token at every byte, and the
encoder takes it, falls back to the token's own prefixes, or steps back one token,
until every two neighbours are compatible. Two tokens are compatible if merging
their joined bytes by rank gives just these two; a text of compatible neighbours is
the one that the merges give. Compatibility is memoised, no place is left twice, so
the time is linear in the piece.

Defined results: a null text is encoded as an empty text, no ids and no bytes when
decoded; null ids decode to no bytes; each row is worked on by itself, so repeated rows
give repeated results and an empty table an empty one; other columns take no part. A text
is never cut: a worker holds it, its pieces and its ids, some ten times its bytes.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


# Entries of the memos of one Python worker; beyond them work is repeated, not lost.
CHUNK_MEMO = 400_000
PIECE_MEMO = 200_000
PAIR_MEMO = 1_000_000

# A single space between other characters always begins a new piece.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[list[int], tuple[int, int] | None]:
    """Ids by merging the pair of lowest rank again and again, and the last pair merged."""
    parts, last = [piece[i:i + 1] for i in range(len(piece))], None
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        last = ranks[parts[at]], ranks[parts[at + 1]]
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts], last


class Encoder:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.lettered = r"| ?\p{L}+|" in pattern
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.sizes = [len(t) for t in self.tokens]
        # How each token was merged last; tokens no merge reaches stand for a whole piece only.
        self.split: list[tuple[int, int] | None] = [None] * size
        reached = ahocorasick.Automaton()
        usable = set()
        for token, rank in ranks.items():
            ids, last = merged(token, ranks)
            if ids == [rank]:
                self.split[rank] = last
                usable.add(token)
                reached.add_word(token.decode("latin-1"), rank)
        reached.make_automaton()
        self.matches = reached
        self.shorter = [-1] * size
        for token in usable:
            for end in range(len(token) - 1, 0, -1):
                if token[:end] in usable:
                    self.shorter[ranks[token]] = ranks[token[:end]]
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        lengths = np.array(self.sizes, dtype=np.int64)
        self.table = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.table_lengths, self.table_starts = lengths, np.cumsum(lengths) - lengths

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges never join these two neighbours across their border."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, before = left, right, 1 << 60
        while True:
            if self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 60) < before:
                result = False
                break
            # Undo the later of the two tokens' last merges; a merge across the
            # border must not have come before it (on equal ranks the left is first).
            halves_a, halves_b = self.split[a], self.split[b]
            if halves_a is None and halves_b is None:
                result = True
                break
            if halves_b is None or (halves_a is not None and a > b):
                before, a = a, halves_a[1]
            else:
                before, b = b + 1, halves_b[0]
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[left, right] = result
        return result

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        # Most pieces: the longest matches from left to right fit as they are.
        text = piece.decode("latin-1")
        greedy = [rank for _, rank in self.matches.iter_long(text)]
        pairs = self.pairs
        for pair in zip(greedy, greedy[1:]):
            fits = pairs.get(pair)
            if fits is None:
                fits = self.compatible(*pair)
            if not fits:
                break
        else:
            return greedy
        longest = [-1] * (len(piece) + 1)
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        for end, rank in self.matches.iter(text):
            longest[end + 1 - sizes[rank]] = rank  # later matches of one start are longer
        open_place = bytearray(b"\x01") * (len(piece) + 1)
        found: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            end = at + sizes[token]
            if open_place[end] and (not found or compatible(found[-1], token)):
                found.append(token)
                at, token = end, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                # Nothing fits here, so nobody needs to come here again.
                open_place[at] = 0
                token = found.pop()
                at -= sizes[token]
        return found

    def piece_ids(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode("utf-8"))).tobytes()
            if len(self.pieces) < PIECE_MEMO:
                self.pieces[piece] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        # Letters after a space are one piece, without asking the pattern.
        if self.lettered and chunk[1:].isalpha() and chunk[0] == " ":
            return self.piece_ids(chunk)
        return b"".join([self.piece_ids(p) for p in self.pattern.findall(chunk)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as the bytes of 32-bit integers."""
        parts = _CUT.split(text) if "  " in text else text.split(" ")
        out = [self.encode_chunk(parts[0])]
        known = self.chunks
        for part in parts[1:]:
            ids = known.get(part)
            if ids is None:
                ids = self.encode_chunk(" " + part)
                if len(known) < CHUNK_MEMO:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of many ids, one after the other."""
        lengths = self.table_lengths[ids]
        ends = np.cumsum(lengths)
        run = np.arange(int(ends[-1]) if len(ends) else 0)
        return self.table[run + np.repeat(self.table_starts[ids] - (ends - lengths), lengths)]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker; building it takes about two seconds."""
    return Encoder(path, pattern)


def _encoded(own: Encoder, texts: pa.Array) -> pa.ListArray:
    ids = [own.encode(x) if x else b"" for x in texts.to_pylist()]
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    values = np.frombuffer(b"".join(ids), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _decoded(own: Encoder, rows: pa.ListArray) -> pa.Array:
    out = []
    for at in range(0, len(rows), 500):
        part = rows.slice(at, 500)
        flat = np.asarray(part.flatten(), dtype=np.int64)
        sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(part), 0), dtype=np.int64)
        ends = np.r_[0, np.cumsum(own.table_lengths[flat])][np.r_[0, np.cumsum(sizes)]]
        data = own.decode(flat).tobytes()
        out += [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return pa.array(out, pa.binary())


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """Token ids of each text as ``array<int>``; empty for a null text."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _encoded(encoder(path, pattern), texts)

    return encode(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """Bytes that the ids of each row stand for; empty for null."""

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        return _decoded(encoder(path, pattern), rows)

    return decode(ids)


def round_trip_column(text: Column, path: str, pattern: str) -> Column:
    """``ids`` of each text and the bytes ``decoded`` from these ids, as one struct.

    A decoding chained to an encoding would make Spark encode twice where both are used.
    """

    @F.arrow_udf("ids array<int>, decoded binary")
    def round_trip(texts: pa.Array) -> pa.Array:
        own = encoder(path, pattern)
        ids = _encoded(own, texts)
        return pa.StructArray.from_arrays([ids, _decoded(own, ids)], names=["ids", "decoded"])

    return round_trip(text)
