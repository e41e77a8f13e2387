"""Exact top-k inner products by dual-tree search over cover trees.

The data are dealt into shards, each with a cover tree that is written beside it; every
block of queries, which has a tree of its own, meets every shard. A pair of nodes is dropped
when the best score it could give, from the centres and their covering radii, is below
the worst k-th score of the queries in the query node; pairs of leaves are scored by one
matrix product. The shards' winners are ranked together.

Vectors are integers (``floor(scale * x)``); products and sums of them are exact in
double precision up to 2**53, beyond which scores are rounded.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part; a query meets vectors of its own dimension; equal scores go to the smaller
id; repeated rows are candidates each, but no row of a query's own id is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import plain, ready, staged
from .vectors import BLOCKS, QUERY_BLOCK, SHARD_VECTORS, best_of, blocks, matrix, meet, placed, usable

LEAF = 256
QUERY_LEAF = 32
FAN = 32
# Ratio of the radii of a level and the next one below.
SHRINK = 0.5

FOUND = "query_row long, query_id long, vec_id long, score double"


@dataclass
class Node:
    """Points of a cover tree node: a centre among them and the radius that covers all."""

    members: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node]


def cover_tree(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Node:
    """Cover tree of the points.

    A node's children are centred on points taken farthest first, so centres lie further
    apart than what they cover, until a level's radius is covered or ``fan`` is reached.
    Levels that would part nothing are left out.
    """

    def build(members: np.ndarray, centre: int) -> Node:
        nearest = np.linalg.norm(points[members] - points[centre], axis=1)
        # A little slack keeps rounding on the safe side.
        node = Node(members, points[centre], float(nearest.max()) * (1 + 1e-12), [])
        if len(members) <= leaf or node.radius == 0.0:
            return node
        owner, centres, cover = np.zeros(len(members), dtype=np.int64), [centre], node.radius * SHRINK
        while len(centres) < 2 or (nearest.max() > cover and len(centres) < fan):
            chosen = int(members[int(nearest.argmax())])
            away = np.linalg.norm(points[members] - points[chosen], axis=1)
            closer = away < nearest
            owner[closer], nearest[closer] = len(centres), away[closer]
            centres.append(chosen)
        node.children = [build(members[owner == i], c) for i, c in enumerate(centres) if (owner == i).any()]
        return node

    return build(np.arange(len(points)), 0)


def packed_tree(root: Node, points: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A tree as bytes: its points in the order of its leaves, and two tables of its nodes.

    The nodes come before their children: first member, members, centre, children; radius.
    """
    order: list[np.ndarray] = []
    spans: list[list[int]] = []
    radii: list[float] = []
    done = 0

    def visit(node: Node) -> None:
        nonlocal done
        begin = done
        centre = int(node.members[int(np.flatnonzero((points[node.members] == node.centre).all(axis=1))[0])])
        spans.append([begin, len(node.members), centre, len(node.children)])
        radii.append(node.radius)
        if node.children:
            for child in node.children:
                visit(child)
        else:
            order.append(node.members)
            done += len(node.members)

    visit(root)
    return (
        np.concatenate(order).astype(np.int32).tobytes(), np.array(spans, dtype=np.int32).tobytes(),
        np.array(radii, dtype=np.float64).tobytes(),
    )


def unpacked_tree(order: bytes, spans: bytes, radii: bytes, points: np.ndarray) -> Node:
    """The tree of ``packed_tree``, without a distance being computed."""
    members = np.frombuffer(order, dtype=np.int32).astype(np.int64)
    table, covers = np.frombuffer(spans, dtype=np.int32).reshape(-1, 4).tolist(), np.frombuffer(radii, dtype=np.float64).tolist()
    at = 0

    def read() -> Node:
        nonlocal at
        (begin, count, centre, children), radius = table[at], covers[at]
        at += 1
        node = Node(members[begin:begin + count], points[centre], radius, [])
        node.children = [read() for _ in range(children)]
        return node

    return read()


class DualSearch:
    """Top-k of all queries of one tree among all points of another."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.query_ids, self.points, self.ids, self.k = queries, query_ids, points, ids, k
        self.scores = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pairs = 0

    def bound(self, query: Node, data: Node) -> float:
        """No inner product of the two nodes' points is above this."""
        length, other = np.linalg.norm(query.centre), np.linalg.norm(data.centre)
        best = float(query.centre @ data.centre)
        best += length * data.radius + other * query.radius + query.radius * data.radius
        return best + abs(best) * 1e-12

    def leaves(self, query: Node, data: Node) -> None:
        self.pairs += len(query.members) * len(data.members)
        names = self.ids[data.members]
        scores = self.queries[query.members] @ self.points[data.members].T
        scores[self.query_ids[query.members][:, None] == names[None, :]] = -np.inf
        # Only queries that a score reaches are ranked anew, ties included.
        reached = np.flatnonzero((scores >= self.scores[query.members, -1:]).any(axis=1))
        if not len(reached):
            return
        rows = query.members[reached]
        scores = np.concatenate([self.scores[rows], scores[reached]], axis=1)
        named = np.concatenate([self.found[rows], np.broadcast_to(names, (len(rows), len(names)))], axis=1)
        order = np.lexsort((named, -scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, order, axis=1)
        self.found[rows] = np.take_along_axis(named, order, axis=1)

    def run(self, query: Node, data: Node) -> None:
        """Best pairs first, so that the worst k-th score of a group rises early."""
        stack = [(query, data, self.bound(query, data))]
        while stack:
            query, data, bound = stack.pop()
            # Ties may still win by a smaller id, so only lower bounds are dropped.
            if bound < self.scores[query.members, -1].min():
                continue
            if not query.children and not data.children:
                self.leaves(query, data)
                continue
            if query.children and (not data.children or query.radius >= data.radius):
                pairs = [(child, data) for child in query.children]
            else:
                pairs = [(query, child) for child in data.children]
            bounded = [(a, b, self.bound(a, b)) for a, b in pairs]
            stack += sorted(bounded, key=lambda p: p[2])


def _search(k: int):
    def run(keys: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for shard in data.to_pylist():
            names, points = matrix(shard["ids"], shard["vectors"])
            tree = unpacked_tree(shard["order"], shard["spans"], shard["radii"], points)
            for number, query_ids, query_vectors in zip(
                queries.column("block").to_pylist(), queries.column("ids").to_pylist(), queries.column("vectors").to_pylist()
            ):
                asked, wanted = matrix(query_ids, query_vectors)
                search = DualSearch(wanted, asked, points, names, k)
                search.run(cover_tree(wanted, leaf=QUERY_LEAF), tree)
                row, place = np.nonzero(np.isfinite(search.scores))
                # Rows of one id that were given twice stay apart by their place in the block.
                rows = number * (1 << 20) + row
                out.append((rows, asked[row], search.found[row, place], search.scores[row, place]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({
            "query_row": pa.array(columns[0].astype(np.int64)), "query_id": pa.array(columns[1].astype(np.int64)),
            "vec_id": pa.array(columns[2].astype(np.int64)), "score": pa.array(columns[3].astype(np.float64)),
        })

    return run


def build_index(rows: DataFrame, shard: int = SHARD_VECTORS) -> DataFrame:
    """Written shards of rows ``(id, vector)``, each with its cover tree."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, points = matrix(row.column("ids")[0].as_py(), row.column("vectors")[0].as_py())
                for name, part in zip(("order", "spans", "radii"), packed_tree(cover_tree(points), points)):
                    row = row.append_column(name, pa.array([part], pa.binary()))
                yield row

    shards = blocks(rows, shard)
    spread = shards.repartition(max(1, int(shards.sparkSession.sparkContext.defaultParallelism)), "block", "dim")
    return staged(spread.mapInArrow(trees, f"{BLOCKS}, order binary, spans binary, radii binary"), "shards")


def top_k(queries: DataFrame, candidates: DataFrame, k: int, shard: int = SHARD_VECTORS) -> DataFrame:
    """``query_id, rank, vec_id, score`` from rows ``(id, vector)`` of whole numbers."""
    data = build_index(candidates, shard)
    asked = staged(blocks(queries, QUERY_BLOCK), "queries")
    return best_of(staged(meet(asked, data, _search(k), FOUND), "found"), k)


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))


def exact_top_k(
    df: DataFrame, k: int, every: int, id: str = "vec_id", vector: str = "embedding", scale: int = 1024
) -> DataFrame:
    """Rows whose id is a multiple of ``every`` as queries against all rows."""
    ready(df.sparkSession)
    rows = placed(plain(df, id=id, vector=vector)).where(F.col("id").isNotNull() & usable(F.col("vector")))
    rows = rows.select(F.col("id").cast("long").alias("id"), scaled(F.col("vector"), scale).alias("vector"), "place")
    found = top_k(rows.where(F.pmod("id", F.lit(every)) == 0), rows, k)
    return found.withColumn("score", F.col("score").cast("long"))
