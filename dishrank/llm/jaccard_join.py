"""Links between documents whose sets of word shingles are similar, and their groups.

1. Every shingle is hashed and exchanged once, packed as in the window removal. The
   exchange answers with each shingle's document count (held to ``COMMON``); shingles of
   one document alone are dropped, for they are in no intersection. A document that has
   too few others left can link with nothing.
2. Documents of one set become one node. A node's rarest shingles, as many as two
   similar sets cannot both miss, are its keys. A tile holds the nodes of one key and
   one size band; the band below takes them as well, so that all sizes within the
   ratio meet.
3. In rounds, each tile compares one of its nodes to the others and drops it. A pair is
   bounded by hashed bitmaps of its sets (bits that one side alone has are missing
   overlap) before the sorted sets are intersected. Linked nodes form components, and a
   tile that holds one component only is done.
4. Tiles that are left after ``ROUNDS`` are cut into blocks. Block by block all pairs of
   different components are bounded by their bitmaps as arrays, and those that the bound
   lets through are intersected. So no link between components is lost, and a group of
   near copies never gives all its pairs.

A shingle that ``COMMON`` documents of one slice share is counted as common there and
sends one entry, so a passage of a third of all documents is no hot partition.

Defined results: a document without words has no shingles and no link; one of fewer
words than a shingle has its whole sequence as its one; rows of equal sets link; rows of
a null id have no component; an empty table gives an empty result. Shingles and sets
are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .staging import drop, partitions_for, plain, ready, staged, text_bytes
from .substring_dedup import id_buckets
from .words import Words, mix, slices, window_hashes, words_of

WIDTH = 5
THRESHOLD = 80  # per cent
# Document counts are told apart below this one only.
COMMON = 16
# A little over 1 / 0.8, so that rounding cannot part similar sizes by two bands.
BAND = 1.26
# Bits of a bitmap for each shingle.
BITS = 8
ROUNDS = 2
# Rows of a tile's block.
BLOCK = 1_024

_SHORT = np.uint64(0xC2B2AE3D27D4EB4F)
_SHORT_SIZES = np.arange(64, dtype=np.uint64) * _SHORT
_PART = np.uint64(0x165667B19E3779F9)
_UNNAMED = np.uint64(0x27D4EB2F165667C5)
ASKED, MARKED, INFO, ANSWER, UNNAMED = range(5)
PACKED = "part int, bucket int, kind int, ids binary, counts binary, hashes binary, more binary"
_NAMES = ["part", "bucket", "kind", "ids", "counts", "hashes", "more"]
_KINDS = [pa.int32()] * 3 + [pa.binary()] * 4


def shingle_sets(words: Words, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the text of each, by text and hash."""
    hashes, first = window_hashes(words, width)
    text_of = words.text_of[first]
    starts = np.cumsum(words.per_text) - words.per_text
    for size in range(1, width):
        texts = np.flatnonzero(words.per_text == size)
        total = np.zeros(len(texts), dtype=np.uint64)
        for i in range(size):
            total = total * _SHORT + words.hashes[starts[texts] + i]
        hashes = np.r_[hashes, mix(total + _SHORT_SIZES[size])]
        text_of = np.r_[text_of, texts]
    order = np.lexsort((hashes, text_of))
    hashes, text_of = hashes[order], text_of[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text_of[1:] != text_of[:-1])
    return hashes[fresh], text_of[fresh]


def set_sizes(text_of: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(text_of, minlength=count)[:count].astype(np.int32)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Wrapping sum of each text's values; texts in order, some without any."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def set_nodes(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each text's set; texts in order."""
    return mix(_sums(mix(hashes ^ _PART), sizes) + sizes.astype(np.uint64))


def node_column(text: Column, width: int = WIDTH) -> Column:
    """Hash of each text's set, as in ``SETS``."""

    @F.arrow_udf(T.LongType())
    def node(texts: pa.Array) -> pa.Array:
        batch, out = pa.RecordBatch.from_arrays([texts], names=["text"]), []
        for piece in slices(batch, "text"):
            hashes, text_of = shingle_sets(words_of(piece.column("text"), lower=True), width)
            out.append(set_nodes(hashes, set_sizes(text_of, piece.num_rows)).view(np.int64))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return node(text)


def _groups(target: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Per target the rows of the columns, in their order."""
    order = np.argsort(target, kind="stable")
    target, columns = target[order], [c[order] for c in columns]
    edges = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, np.int64)
    for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(target)]):
        yield int(target[begin]), *(c[begin:end] for c in columns)


def _runs(ids: np.ndarray) -> tuple[bytes, bytes]:
    heads = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return ids[heads].tobytes(), np.diff(np.r_[heads, len(ids)]).astype(np.int32).tobytes()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_NAMES)


def _send(width: int, parts: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                words = words_of(piece.column("text"), lower=True)
                hashes, text_of = shingle_sets(words, width)
                named = piece.column("id").is_valid().to_numpy(zero_copy_only=False)
                ids = pa.compute.fill_null(piece.column("id"), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = set_sizes(text_of, len(ids))
                nodes = set_nodes(hashes, sizes)
                # Rows of one id and one set are one; others of that id are not.
                rows_of = mix(mix(ids.view(np.uint64)) + nodes + np.where(named, np.uint64(0), _UNNAMED)).view(np.int64)
                out = []
                for b, r, n, node, id in _groups(id_buckets(rows_of[named], buckets), rows_of[named], sizes[named], nodes[named], ids[named]):
                    out.append((b % parts, b, INFO, r.tobytes(), n.tobytes(), node.tobytes(), id.tobytes()))
                # Of rows without id a slice sends each set once.
                unnamed = np.flatnonzero(~named)
                unnamed = unnamed[np.unique(rows_of[unnamed], return_index=True)[1]]
                for b, r, n, node, id in _groups(
                    id_buckets(rows_of[unnamed], buckets), rows_of[unnamed], sizes[unnamed], nodes[unnamed], ids[unnamed]
                ):
                    out.append((b % parts, b, UNNAMED, r.tobytes(), n.tobytes(), node.tobytes(), id.tobytes()))
                if len(unnamed) or not named.all():
                    sent = named.copy()
                    sent[unnamed] = True
                    hashes, text_of = hashes[sent[text_of]], text_of[sent[text_of]]
                _, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
                common = counts[inverse] >= COMMON
                cold, owner = hashes[~common], rows_of[text_of[~common]]
                for p, r, h in _groups((mix(cold + _PART) % np.uint64(parts)).astype(np.int32), owner, cold):
                    out.append((p, -1, ASKED, *_runs(r), h.tobytes(), None))
                hot, times = np.unique(hashes[common], return_counts=True)
                for p, h, n in _groups((mix(hot + _PART) % np.uint64(parts)).astype(np.int32), hot, times.astype(np.int32)):
                    out.append((p, -1, MARKED, None, n.tobytes(), h.tobytes(), None))
                owner = rows_of[text_of[common]]
                for b, r, h in _groups(id_buckets(owner, buckets), owner, hashes[common]):
                    out.append((b % parts, b, ANSWER, *_runs(r), h.tobytes(), bytes([COMMON]) * len(h)))
                yield _table(out)

    return run


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in table.column(name).to_pylist() if x), dtype=kind)


def _of_kind(table: pa.Table, *kinds: int) -> pa.Table:
    return table.filter(pa.compute.is_in(table.column("kind"), pa.array(kinds, pa.int32())))


def _answer(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        asked, marked = _of_kind(table, ASKED), _of_kind(table, MARKED)
        owner = np.repeat(_joined(asked, "ids", np.int64), _joined(asked, "counts", np.int32))
        hashes = _joined(asked, "hashes", np.uint64)
        extra, times = _joined(marked, "hashes", np.uint64), _joined(marked, "counts", np.int32)
        known, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        if len(extra) and len(known):
            at = np.minimum(np.searchsorted(known, extra), len(known) - 1)
            same = known[at] == extra
            counts = counts + np.bincount(at[same], weights=times[same], minlength=len(known)).astype(np.int64)
        each = np.minimum(counts, COMMON).astype(np.uint8)[inverse]
        shared = each >= 2
        out = []
        owner, hashes, each = owner[shared], hashes[shared], each[shared]
        order = np.argsort(owner, kind="stable")
        owner, hashes, each = owner[order], hashes[order], each[order]
        for b, r, h, c in _groups(id_buckets(owner, buckets), owner, hashes, each):
            out.append((0, b, ANSWER, *_runs(r), h.tobytes(), c.tobytes()))
        own = _table(out)
        return pa.concat_tables([pa.Table.from_batches([own]), _of_kind(table, INFO, ANSWER, UNNAMED).cast(own.schema)])

    return run


def band_of(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / math.log(BAND)).astype(np.int32)


def bitmap_words(band: np.ndarray) -> np.ndarray:
    """64-bit words of a band's bitmaps."""
    return np.ceil(np.power(BAND, band + 1.0) * BITS / 64).astype(np.int64).clip(1)


def _bitmaps(hashes: np.ndarray, sizes: np.ndarray, band: np.ndarray) -> pa.Array:
    """One bitmap of each set, as a list of longs."""
    words = bitmap_words(band)
    ends = np.cumsum(words)
    bits = np.zeros(int(ends[-1]) * 64 if len(ends) else 0, dtype=bool)
    width = np.repeat(words * 64, sizes)
    bits[np.repeat((ends - words) * 64, sizes) + (hashes % width.astype(np.uint64)).astype(np.int64)] = True
    values = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values))


SETS = "id long, n long, node long, band int, keys array<long>, shared array<long>, bits array<long>, low array<long>"


def _collect(table: pa.Table) -> pa.Table:
    """Per document its set size and, if it can link with any other, its keys and shared shingles."""
    info, unnamed, answers = _of_kind(table, INFO), _of_kind(table, UNNAMED), _of_kind(table, ANSWER)
    with_id = len(_joined(info, "ids", np.int64))
    info = pa.concat_tables([info, unnamed])
    rows, sizes = _joined(info, "ids", np.int64), _joined(info, "counts", np.int32).astype(np.int64)
    nodes, ids = _joined(info, "hashes", np.int64), _joined(info, "more", np.int64)
    known, first = np.unique(rows, return_index=True)
    owner = np.repeat(_joined(answers, "ids", np.int64), _joined(answers, "counts", np.int32))
    hashes, counts = _joined(answers, "hashes", np.uint64), _joined(answers, "more", np.uint8)
    del info, unnamed, answers
    at = np.searchsorted(known, owner)
    del owner
    order = np.lexsort((hashes, at))
    at, hashes, counts = at[order], hashes[order], counts[order]
    fresh = np.ones(len(at), dtype=bool)  # a repeated row asks twice
    fresh[1:] = (at[1:] != at[:-1]) | (hashes[1:] != hashes[:-1])
    at, hashes, counts = at[fresh], hashes[fresh], counts[fresh]
    del order, fresh
    n = sizes[first]
    shared = np.bincount(at, minlength=len(known))[:len(known)]
    prefix = n - -(-n * THRESHOLD // 100) + 1 - (n - shared)
    alive = (prefix >= 1) & (shared >= 1)
    chosen = alive[at] if len(at) else np.zeros(0, dtype=bool)
    at, hashes, counts = at[chosen], hashes[chosen], counts[chosen]
    del chosen
    live = np.flatnonzero(alive)
    own = shared[live]
    starts = np.cumsum(own) - own
    rare = np.lexsort((hashes, counts, at))
    place = np.arange(len(at)) - np.repeat(starts, own)
    keys = hashes[rare][place < np.repeat(prefix[live], own)]
    del rare, place, counts, at
    taken = np.minimum(prefix[live], own)

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values.view(np.int64)))

    band = band_of(n[live])
    found = [lists(keys, taken), lists(hashes, own), _bitmaps(hashes, own, band), _bitmaps(hashes, own, band - 1)]
    # Arrays go to the first row of their document only; the others repeat it.
    place_of = np.full(len(rows), -1)
    place_of[first[live]] = np.arange(len(live))
    pick = pa.array(np.where(place_of < 0, 0, place_of), pa.int64(), mask=place_of < 0)
    arrays = [a.take(pick) if len(a) else pa.nulls(len(rows), pa.list_(pa.int64())) for a in found]
    return pa.table({
        "id": pa.array(ids, mask=np.arange(len(ids)) >= with_id), "n": pa.array(sizes), "node": pa.array(nodes), "band": pa.array(band_of(sizes)),
        "keys": arrays[0], "shared": arrays[1], "bits": arrays[2], "low": arrays[3],
    })


def shingle_table(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Written table ``SETS``, one row per row of ``docs(id, text)``; of rows without id one per set and slice."""
    count = partitions_for(docs.sparkSession, text_bytes(docs, "text")) | 1
    sent = docs.mapInArrow(_send(width, count, count), PACKED)
    answers = staged(sent.groupBy("part").applyInArrow(_answer(count), PACKED), "answers")
    sets = staged(answers.where("bucket >= 0").groupBy("bucket").applyInArrow(_collect, SETS), "sets")
    drop(answers)
    return sets


def tile_rows(nodes: DataFrame) -> DataFrame:
    """``(key, tile, node, n, upper)``: each key in the node's own band and the one below."""
    keyed = nodes.select("node", "n", "band", F.explode("keys").alias("key"))
    return keyed.select(
        "key", "node", "n", F.explode(F.array(
            F.struct(F.col("band").alias("tile"), F.lit(False).alias("upper")),
            F.struct((F.col("band") - 1).alias("tile"), F.lit(True).alias("upper")),
        )).alias("t"),
    ).select("key", "t.tile", "node", "n", "t.upper")


def sizes_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def _missing(a: Column, b: Column) -> Column:
    """Bits of ``a`` that ``b`` lacks."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, x: s + x
    )


@F.arrow_udf(T.LongType())
def intersection_size(left: pa.Array, right: pa.Array) -> pa.Array:
    """Common elements of two sorted arrays of distinct values."""
    out = []
    for a, b in zip(left, right):
        x, y = np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64)
        at = np.searchsorted(x, y)
        out.append(int((x[np.minimum(at, len(x) - 1)] == y).sum()))
    return pa.array(out, pa.int64())


def linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar."""

    def side(name: str, *columns: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])

    enough = (F.col("n_a") + F.col("n_b")) * THRESHOLD
    signed = pairs.join(side("a", "n", "c", "band", "bits", "low"), "a").join(side("b", "n", "c", "band", "bits", "low"), "b")
    tile = F.least("band_a", "band_b")
    left = F.when(F.col("band_a") == tile, F.col("bits_a")).otherwise(F.col("low_a"))
    right = F.when(F.col("band_b") == tile, F.col("bits_b")).otherwise(F.col("low_b"))
    bound = F.least(F.col("c_a") - _missing(left, right), F.col("c_b") - _missing(right, left))
    near = signed.where(sizes_fit(F.col("n_a"), F.col("n_b"))).where(bound * (100 + THRESHOLD) >= enough)
    near = near.select("a", "b", "n_a", "n_b")
    full = near.join(side("a", "shared"), "a").join(side("b", "shared"), "b")
    common = full.withColumn("common", intersection_size("shared_a", "shared_b"))
    return common.where(F.col("common") * (100 + THRESHOLD) >= enough).select("a", "b")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bound_blocks(keys: tuple, rows: pa.Table) -> pa.Table:
    """Pairs of one pair of blocks whose bitmaps allow a link, one of the two in its own band.

    A pair that shares several keys is left to the tile of the smallest one.
    """
    first = np.asarray(rows.column("mine"), dtype=np.int64) == keys[2].as_py()
    second = np.asarray(rows.column("mine"), dtype=np.int64) == keys[3].as_py()
    n, c, node, component = (np.asarray(rows.column(k), dtype=np.int64) for k in ("n", "c", "node", "component"))
    upper = np.asarray(rows.column("upper")).astype(bool)
    bits = np.asarray(pa.compute.list_flatten(rows.column("map").combine_chunks()), dtype=np.int64)
    bits = bits.view(np.uint64).reshape(len(n), -1) if len(n) else bits.reshape(0, 1)
    lists = rows.column("keys").combine_chunks()
    shared = np.asarray(pa.compute.list_flatten(lists), dtype=np.int64)
    lengths = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    out_a, out_b = [], []
    other = np.flatnonzero(second)
    for i in np.flatnonzero(first & ~upper):
        fits = np.minimum(n[i], n[other]) * 100 >= np.maximum(n[i], n[other]) * THRESHOLD
        fits &= (component[other] != component[i]) & (upper[other] | (node[other] > node[i]) | ~first[other])
        near = other[fits]
        if not len(near):
            continue
        lacking = np.bitwise_count(bits[i] & ~bits[near]).sum(axis=1)
        spare = np.bitwise_count(bits[near] & ~bits[i]).sum(axis=1)
        bound = np.minimum(c[i] - lacking.astype(np.int64), c[near] - spare.astype(np.int64))
        near = near[bound * (100 + THRESHOLD) >= (n[i] + n[near]) * THRESHOLD]
        if not len(near):
            continue
        heads = np.cumsum(lengths[near]) - lengths[near]
        theirs = shared[np.arange(int(lengths[near].sum())) + np.repeat(starts[near] - heads, lengths[near])]
        common = np.isin(theirs, shared[starts[i]:starts[i] + lengths[i]])
        least = np.minimum.reduceat(np.where(common, theirs, np.iinfo(np.int64).max), heads)
        near = near[least == keys[0].as_py()]
        out_a.append(np.minimum(node[i], node[near]))
        out_b.append(np.maximum(node[i], node[near]))
    a = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
    b = np.concatenate(out_b) if out_b else np.zeros(0, np.int64)
    pairs = np.unique(np.stack([a, b]), axis=1)
    return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def pairs_across(open_tiles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of different components that share a tile and that bitmaps do not rule out."""
    maps = nodes.select("node", "c", F.col("band").alias("own"), "bits", "low", "keys")
    sizes = open_tiles.groupBy("key", "tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = open_tiles.join(sizes, ["key", "tile"]).join(maps, "node").select(
        "key", "tile", "node", "n", "c", "upper", "component", "blocks", "keys",
        F.when(F.col("own") == F.col("tile"), F.col("bits")).otherwise(F.col("low")).alias("map"),
        F.pmod(F.xxhash64("node"), F.col("blocks")).alias("mine"),
    )
    # A block of nodes in their own band meets every block of its tile, itself included.
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = rows.where(~F.col("upper")).select("*", F.col("mine").alias("i"), others.alias("j"))
    right = rows.select("*", others.alias("i"), F.col("mine").alias("j")).where("i <> j or upper")
    both = left.union(right).drop("blocks")
    return both.groupBy("key", "tile", "i", "j").applyInArrow(_bound_blocks, "a long, b long").distinct()


def similar_nodes(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """``(node, component)`` of nodes that link with another one; none if there is no link."""
    tiles = staged(tile_rows(nodes).withColumn("component", F.col("node")), "tiles")
    edges, named = None, None
    for number in range(rounds):
        leaders = tiles.where(~F.col("upper")).groupBy("key", "tile").agg(
            F.min(F.struct(F.xxhash64("node", F.lit(number)).alias("h"), "node", "n", "component")).alias("lead")
        )
        met = tiles.join(leaders, ["key", "tile"]).where(F.col("node") != F.col("lead.node"))
        pairs = met.where((F.col("component") != F.col("lead.component")) & sizes_fit(F.col("n"), F.col("lead.n")))
        pairs = pairs.select(*_ordered("node", "lead.node")).distinct()
        fresh = staged(linked(pairs, nodes), "edges")
        rest = met.drop("lead")
        if fresh.limit(1).count():
            edges = fresh if edges is None else edges.union(fresh)
            named = components(edges)
            rest = rest.drop("component").join(named, "node", "left").withColumn(
                "component", F.coalesce("component", "node")
            )
        mixed = rest.groupBy("key", "tile").agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.min("upper").alias("one")
        ).where("least < most and not one").select("key", "tile")
        before, tiles = tiles, staged(rest.join(mixed, ["key", "tile"], "left_semi"), "tiles")
        drop(before)
        if not tiles.limit(1).count():
            return named
    more = staged(linked(pairs_across(tiles, nodes), nodes), "edges")
    drop(tiles)
    if more.limit(1).count():
        named = components(more if edges is None else edges.union(more))
    return named


def named_nodes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` of the sets that could link with another, and all sets without their arrays.

    The table of sets itself is deleted: each array is kept once, with its node.
    """
    plain_sets = staged(sets.select("id", "n", "node"), "plain_sets")
    alive = sets.where(F.col("keys").isNotNull()).select(
        "node", "n", "band", "keys", "shared", "bits", "low", F.size("shared").alias("c")
    )
    nodes = staged(alive.dropDuplicates(["node"]), "nodes")
    drop(sets)
    named = similar_nodes(nodes)
    if named is None:
        named = nodes.select("node", F.col("node").alias("component"))
    return named, plain_sets


def first_rows(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``unnamed, id, node`` of the row that each group keeps, of all rows with words.

    The smallest id is kept, then the smallest set hash; a row without id (0 here) only
    where no row of the group has one. ``node_column`` finds it among the rows.
    """
    ready(df.sparkSession)
    sets = shingle_table(plain(df, id=id, text=text).withColumn("id", F.col("id").cast("long")), width)
    named, sets = named_nodes(sets)
    row = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), "node")
    least = sets.where("n > 0").groupBy("node").agg(F.min(row).alias("row"))
    met = least.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return met.groupBy("component").agg(F.min("row").alias("row")).select("row.unnamed", "row.id", "row.node")


def similar_groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``id, n_shingles, component_id`` of every row; the smallest linked id names a group."""
    ready(df.sparkSession)
    docs = plain(df, id=id, text=text).withColumn("id", F.col("id").cast("long"))
    sets = shingle_table(docs.where(F.col("id").isNotNull()), width)
    named, sets = named_nodes(sets)
    least = sets.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    # Names of nodes become the smallest document id of all their members.
    members = named.join(least, "node")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_nodes = members.join(smallest, "component").select("node", "component_id")
    own = least.join(linked_nodes, "node", "left").select(
        "node", F.coalesce("component_id", "least").alias("component_id")
    )
    found = sets.select("id", "n", "node").join(own, "node", "left").select(
        F.col("id").alias(id), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                _, text_of = shingle_sets(words_of(piece.column("text"), lower=True), width)
                yield pa.RecordBatch.from_arrays([pa.array(set_sizes(text_of, piece.num_rows), pa.int64())], names=["n"])

    nameless = docs.where(F.col("id").isNull()).select("text").mapInArrow(sizes, "n long").select(
        F.lit(None).cast("long").alias(id), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return found.union(nameless)
