"""Removal of word windows that another document has as well.

Every window of ``width`` consecutive words gets a rolling hash. The hashes are
exchanged by value, the smallest document id of each is found, and the windows of
all other documents are sent back to them, where overlapping windows merge into
maximal removal intervals.

What one task sends is packed: for each exchange partition one row with the hashes
of a slice of documents. Within a slice a window that several documents share is
resolved at once and sent for its smallest document only, so a passage that a third
of all documents share costs one entry per slice.

A window is known by 64 bits; two different windows are taken for one with
probability 2**-64 per pair, and lie in one partition only by another hash as well.

Texts of an id with more bytes than ``HEAVY_BYTES`` are dealt to several buckets by a
salt, and what they ask for is answered to the salt that asked, so a repeated id of a
third of all rows is in no single task. Rows without an id never meet other rows.

Defined results: a null text has no words; a text shorter than a window keeps all
its words; rows with equal ids do not remove from each other; rows with a null id
are left as they are and remove nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .staging import PARTITION_BYTES, partitions_for, ready, staged, with_kept
from .words import kept_texts, mix, slices, window_hashes, words_of

WIDTH = 13

# Text bytes of one id above which its rows are salted, rows in a row that share a salt.
HEAVY_BYTES = PARTITION_BYTES
SALTED_ROWS = 1_000

# A bucket below zero holds windows that are asked for: -1 less the salt of who asks.
PACKED = "part int, bucket int, ids binary, counts binary, hashes binary"
_ID_SALT = np.uint64(0xA0761D6478BD642F)


def id_buckets(ids: np.ndarray, count: int, salts: np.ndarray | int = 0) -> np.ndarray:
    """Bucket of each id and salt; ``bucket_column`` is the same rule as an expression."""
    return np.mod(np.mod(ids ^ (ids >> 17), count) + salts, count).astype(np.int32)


def bucket_column(id: Column, count: int, salt: Column) -> Column:
    plain = F.pmod(id.bitwiseXOR(F.shiftright(id, 17)), F.lit(count).cast("long"))
    return F.pmod(plain + salt, F.lit(count).cast("long")).cast("int")


def packed_rows(
    target: np.ndarray, ids: np.ndarray, hashes: np.ndarray
) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Per target its ids, entries per id and hashes; ids come in the order given."""
    order = np.argsort(target, kind="stable")
    target, ids, hashes = target[order], ids[order], hashes[order]
    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    for begin, end in zip(edges, np.r_[edges[1:], len(target)]):
        own = ids[begin:end]
        runs = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts = np.diff(np.r_[runs, len(own)]).astype(np.int32)
        yield int(target[begin]), own[runs].tobytes(), counts.tobytes(), hashes[begin:end].tobytes()


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and hashes of packed rows, one of each per entry."""
    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)

    return np.repeat(joined("ids", np.int64), joined("counts", np.int32)), joined("hashes", np.uint64)


def _smallest(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each entry the smallest id among entries of the same hash."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    edges = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(ids[order], edges)
    result = np.empty_like(ids)
    result[order] = np.repeat(least, np.diff(np.r_[edges, len(ids)]))
    return result


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = ["part", "bucket", "ids", "counts", "hashes"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _send(width: int, parts: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"))
                hashes, first = window_hashes(words, width)
                if not len(hashes):
                    continue
                ids = piece.column("id").to_numpy(zero_copy_only=False).astype(np.int64)[words.text_of[first]]
                salts = piece.column("salt").to_numpy(zero_copy_only=False).astype(np.int64)[words.text_of[first]]
                least = _smallest(ids, hashes)
                mine = ids == least
                rows = []
                for salt in np.unique(salts[mine]).tolist():
                    # Of a window that a document holds several times one entry will do.
                    chosen = np.flatnonzero(mine & (salts == salt))
                    _, once = np.unique(hashes[chosen], return_index=True)
                    chosen = chosen[np.sort(once)]
                    part = (mix(hashes[chosen] + np.uint64(1)) % np.uint64(parts)).astype(np.int32)
                    rows += [(p, -1 - salt, *rest) for p, *rest in packed_rows(part, ids[chosen], hashes[chosen])]
                others = np.flatnonzero(~mine)
                # The same windows of one id and salt are answered once.
                to = id_buckets(ids[others], buckets, salts[others])
                order = np.lexsort((hashes[others], ids[others], to))
                others, to = others[order], to[order]
                fresh = np.ones(len(others), dtype=bool)
                fresh[1:] = (to[1:] != to[:-1]) | (ids[others][1:] != ids[others][:-1]) | (hashes[others][1:] != hashes[others][:-1])
                others, to = others[fresh], to[fresh]
                rows += [(int(b) % parts, b, *rest) for b, *rest in packed_rows(to, ids[others], hashes[others])]
                yield _table(rows)

    return run


def _resolve(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        local = table.filter(pa.compute.greater_equal(table.column("bucket"), 0))
        asked = table.filter(pa.compute.less(table.column("bucket"), 0))
        ids, hashes = unpack(asked)
        entries = np.array([len(h) // 8 for h in asked.column("hashes").to_pylist()], dtype=np.int64)
        salts = np.repeat(-1 - np.asarray(asked.column("bucket"), dtype=np.int64), entries)
        rows = []
        if len(ids):
            gone = ids > _smallest(ids, hashes)
            ids, hashes, salts = ids[gone], hashes[gone], salts[gone]
            order = np.argsort(ids, kind="stable")
            ids, hashes, salts = ids[order], hashes[order], salts[order]
            rows = [(0, b, *rest) for b, *rest in packed_rows(id_buckets(ids, buckets, salts), ids, hashes)]
        own = _table(rows)
        return pa.concat_tables([pa.Table.from_batches([own]), local.cast(own.schema)])

    return run


def _pair_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(hashes + mix(ids.view(np.uint64) ^ _ID_SALT))


def _cut(width: int, untouched: bool):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({
                "id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()),
                "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()),
                "kept": texts.column("kept"),
            })
        ids, hashes = unpack(replies)
        gone = np.unique(_pair_keys(ids, hashes))
        out = []
        for piece in slices(texts, "text"):
            words = words_of(piece.column("text"))
            hashes, first = window_hashes(words, width)
            known = piece.column("id").is_valid().to_numpy()
            own = pa.compute.fill_null(piece.column("id"), 0).to_numpy().astype(np.int64)
            cover = np.zeros(len(words.starts) + 1, dtype=np.int64)
            if len(hashes) and len(gone):
                holder = words.text_of[first]
                keys = _pair_keys(own[holder], hashes)
                at = np.minimum(np.searchsorted(gone, keys), len(gone) - 1)
                hit = first[(gone[at] == keys) & known[holder]]
                cover += np.bincount(hit, minlength=len(cover)) - np.bincount(hit + width, minlength=len(cover))
            keep = np.cumsum(cover)[:-1] == 0
            removed = np.bincount(words.text_of[~keep], minlength=piece.num_rows)[:piece.num_rows]
            kept = kept_texts(words, keep, piece.num_rows)
            if untouched:
                whole = pa.compute.fill_null(piece.column("text"), "")
                kept = pa.compute.if_else(pa.array(removed == 0), whole, kept)
            out.append(pa.table({
                "id": piece.column("id"),
                "n_words": pa.array(words.per_text, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": kept,
                "kept": piece.column("kept"),
            }))
        return pa.concat_tables(out)

    return run


def _alone(width: int, untouched: bool):
    """Rows that nothing is removed from, batch by batch."""
    cut, nothing = _cut(width, untouched), pa.Table.from_batches([_table([])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from cut(pa.Table.from_batches([batch]), nothing).to_batches()

    return run


def repeated_windows(docs: DataFrame, width: int, parts: int, buckets: int) -> DataFrame:
    """Packed windows of documents that also start in a document of smaller id."""
    sent = docs.where(F.col("text").isNotNull()).select("id", "text", "salt").mapInArrow(
        _send(width, parts, buckets), PACKED
    )
    return sent.groupBy("part").applyInArrow(_resolve(buckets), PACKED)


def with_salt(named: DataFrame, sizes: DataFrame, most: int, count: int) -> DataFrame:
    """Rows with the salt that deals an id of many bytes to several buckets; 0 for all others.

    Rows of such ids are written, for their salts come from where they lie and must not
    change when a task runs again. Neighbours share a salt, so that what one slice asks
    for is still sent once.
    """
    if most <= HEAVY_BYTES:
        return named.withColumn("salt", F.lit(0).cast("long"))
    heavy = sizes.where(F.col("bytes") > HEAVY_BYTES).select(
        "id", F.least(F.ceil(F.col("bytes") / HEAVY_BYTES), F.lit(count)).cast("long").alias("salts")
    )
    heavy = staged(heavy, "heavy")
    place = F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) DIV {SALTED_ROWS}")
    salted = named.select("*", F.spark_partition_id().alias("task"), place.alias("place")).join(heavy, "id")
    salted = staged(salted.select(
        "id", "text", "kept", F.pmod(F.xxhash64("task", "place"), F.col("salts")).cast("long").alias("salt")
    ), "salted")
    light = named.join(heavy, "id", "left_anti").withColumn("salt", F.lit(0).cast("long"))
    return light.select("id", "text", "kept", "salt").union(salted)


def remove_repeated(
    df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, keep: Sequence[str] = (),
    untouched: bool = False,
) -> DataFrame:
    """Each document without the words of windows that a smaller id holds too.

    Returns ``id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by
    one space) and the columns named in ``keep``, one row per input row. With
    ``untouched`` a text that loses nothing stays as it is, white space included.
    """
    spark = ready(df.sparkSession)
    docs = with_kept(df, keep, id=id, text=text).withColumn("id", F.col("id").cast("long"))
    sizes = docs.groupBy("id").agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"))
    total, most, nameless = sizes.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max(F.when(F.col("id").isNotNull(), F.col("bytes"))), F.lit(0)),
        F.coalesce(F.max(F.col("id").isNull()), F.lit(False)),
    ).first()
    # An odd count keeps ids of one stride apart.
    count = partitions_for(spark, total) | 1
    named = with_salt(docs.where(F.col("id").isNotNull()), sizes, most, count)
    replies = staged(repeated_windows(named, width, count, count), "windows")
    placed = named.withColumn("bucket", bucket_column(F.col("id"), count, F.col("salt"))).drop("salt")

    def schema(rows: DataFrame) -> T.StructType:
        return T.StructType([
            T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
            T.StructField("kept", rows.schema["kept"].dataType),
        ])

    result = placed.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(_cut(width, untouched), schema(placed))
    if nameless:
        # Nothing is removed from them, so they need not be brought together.
        rows = docs.where(F.col("id").isNull()).select("id", "text", "kept")
        result = result.union(rows.mapInArrow(_alone(width, untouched), schema(rows)))
    return result.select(
        F.col("id").alias(id), "n_words", "n_removed", "kept_text", *[F.col(f"kept.`{c}`") for c in keep if c != id]
    )
