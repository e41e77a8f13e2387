"""Words of a batch of texts and rolling hashes of word windows, as numpy arrays.

A batch is worked on as one byte buffer; no Python code runs per word.
Hashes are polynomials modulo 2**64 over random byte values (for a word) and
over mixed word hashes (for a window), each finished by a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once; numpy needs about 60 times as much for a moment.
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective mixer of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _powers(count: int) -> np.ndarray:
    powers = np.full(max(count, 1), _BASE, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


@dataclass
class Words:
    """Words of consecutive texts: byte spans, the text each is in, and hashes."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text_of: np.ndarray
    hashes: np.ndarray
    per_text: np.ndarray


def buffers_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[places[0]:places[-1]], places - places[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Consecutive rows of a batch with about ``limit`` bytes of text at most.

    A single longer text makes a slice of its own; texts are never cut.
    """
    if not batch.num_rows:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    total, begin = np.cumsum(lengths, dtype=np.int64), 0
    while begin < batch.num_rows:
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of bytes other than space and 0x09 to 0x0D in each text."""
    data, offsets = buffers_of(texts)
    if lower:
        data = _LOWER[data]
    count = len(texts)
    inside = ~_SEPARATOR[data]
    begins, lasts = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    lasts[:-1] &= ~inside[1:]
    heads = offsets[:-1]
    heads = heads[heads < len(data)]
    begins[heads] = inside[heads]
    tails = heads[heads > 0] - 1
    lasts[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(lasts) + 1 - starts
    text_of = np.searchsorted(offsets, starts, side="right") - 1
    per_text = np.bincount(text_of, minlength=count)[:count] if count else np.zeros(0, np.int64)
    if not len(starts):
        return Words(data, starts, lengths, text_of, np.zeros(0, np.uint64), per_text)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int32)
    place -= np.repeat(firsts.astype(np.int32), lengths)
    values = _BYTE_VALUES[data[inside]]
    values *= _powers(int(lengths.max()))[place]
    hashes = mix(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    return Words(data, starts, lengths, text_of, hashes, per_text)


def window_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each window of ``width`` words of one text, and its first word."""
    count = len(words.hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, dtype=np.uint64)
    for i in range(width):
        total *= _STEP
        total += words.hashes[i:i + count]
    whole = np.flatnonzero(words.text_of[:count] == words.text_of[width - 1:])
    return mix(total[whole]), whole


def kept_texts(words: Words, keep: np.ndarray, count: int) -> pa.Array:
    """Per text its kept words joined by one space."""
    chosen = np.flatnonzero(keep)
    lengths = words.lengths[chosen]
    ends = np.cumsum(lengths + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
    if len(chosen):
        run = np.arange(int(lengths.sum()), dtype=np.int64)
        firsts = np.cumsum(lengths) - lengths
        source = run + np.repeat(words.starts[chosen] - firsts, lengths)
        target = run + np.repeat(np.arange(len(chosen)), lengths)
        out[target] = words.data[source]
    spans = np.bincount(words.text_of[chosen], weights=lengths + 1, minlength=count).astype(np.int64)[:count]
    stops = np.cumsum(spans)
    # The space after a text's last word is left out.
    whole = out.tobytes()
    return pa.array(
        [whole[stop - span:stop - 1 if span else stop].decode("utf-8") for span, stop in zip(spans.tolist(), stops.tolist())],
        pa.string(),
    )
