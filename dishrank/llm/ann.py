"""Approximate nearest neighbours over robust-pruned directed graphs.

Vectors are dealt into shards, and each shard is a graph. A vector joins it by a greedy
beam search for its own neighbourhood; of what the search passed, relaxed distance
pruning keeps diverse edges: a candidate goes if a kept one is ``ALPHA`` times nearer to
it than the new vector is. Edges are added backwards as well, and lists that grow too
long are pruned in the same way. A query's beam search runs over every shard, and the
shards' winners are ranked together. All searches of a block advance together as arrays.

Nearness is the largest inner product. For the graph every vector gets one more
component that makes all lengths equal, so that nearer means a larger inner product.

The graphs hold each different vector once, under a hash of its components, and a
written table has the ids of each. Copies in a graph would prune each other's edges
away or fill them up, so most could not be reached. A vector that is found stands for
all its ids, of which a query takes the smallest ones up to ``k``.

Every vector is indexed. Defined results: vectors that are null, empty, zero or hold
null or non-finite components take no part; a query meets its own dimension; equal
scores go to the smaller id; a query's own id is no candidate; repeated rows are
candidates each. Two different vectors are taken for one with probability 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import plain, ready, staged
from .vectors import QUERY_BLOCK, SHARD_VECTORS, best_of, blocks, matrix, meet, nonzero, placed, usable

DEGREE = 28
ALPHA = 1.2
# Beam of the searches that build and of those that answer.
BUILD_BEAM = 56
QUERY_BEAM = 128
# Nodes that one search opens at once, and vectors that join a graph together.
OPENED = 4
JOINED = 256

INDEX = "dim int, block long, ids binary, vectors binary, graph binary, entry int"
FOUND = "query_row long, query_id long, node long, score double"


def lifted(points: np.ndarray) -> np.ndarray:
    """Points with one more component, all of one length."""
    squares = (points ** 2).sum(axis=1)
    last = np.sqrt(np.maximum(squares.max() - squares, 0.0))
    return np.c_[points, last].astype(np.float32)


def beam_search(
    points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """Nearest nodes found for each query and their squared distances, nearest first."""
    count, rows = len(queries), np.arange(len(queries))[:, None]
    ids = np.full((count, beam), -1, dtype=np.int32)
    away = np.full((count, beam), np.inf, dtype=np.float32)
    opened = np.ones((count, beam), dtype=bool)
    seen = np.zeros((count, len(points)), dtype=bool)
    ids[:, 0], opened[:, 0], seen[:, entry] = entry, False, True
    away[:, 0] = ((queries - points[entry]) ** 2).sum(axis=1)
    squares = (points ** 2).sum(axis=1)
    own = (queries ** 2).sum(axis=1)[:, None]
    while True:
        waiting = np.where(opened, np.inf, away)
        place = np.argpartition(waiting, OPENED, axis=1)[:, :OPENED]
        live = np.isfinite(waiting[rows, place])
        if not live.any():
            return ids, away
        opened[rows, place] = True
        nodes = np.where(live, ids[rows, place], 0)
        near = np.where(live[:, :, None], graph[nodes], -1).reshape(count, -1)
        near = np.sort(near, axis=1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        safe = np.where(fresh, near, 0)
        fresh &= ~seen[rows, safe]
        row, column = np.nonzero(fresh)
        target = near[row, column]
        seen[row, target] = True
        found = np.full(near.shape, np.inf, dtype=np.float32)
        found[row, column] = squares[target] + own[row, 0] - 2 * np.einsum("ij,ij->i", points[target], queries[row])
        all_away = np.concatenate([away, found], axis=1)
        order = np.argsort(all_away, axis=1, kind="stable")[:, :beam]
        ids = np.concatenate([ids, near], axis=1)[rows, order]
        opened = np.concatenate([opened, ~fresh], axis=1)[rows, order]
        away = all_away[rows, order]


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each node, of candidates padded with -1."""
    candidates = np.sort(candidates, axis=1)
    alive = (candidates >= 0) & (candidates != nodes[:, None])
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    vectors = points[np.where(alive, candidates, 0)]
    squares = (vectors ** 2).sum(axis=2)
    between = squares[:, :, None] + squares[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    away = ((vectors - points[nodes][:, None, :]) ** 2).sum(axis=2)
    away[~alive] = np.inf
    rows = np.arange(len(nodes))
    kept = np.full((len(nodes), degree), -1, dtype=np.int32)
    for place in range(degree):
        best = away.argmin(axis=1)
        some = np.isfinite(away[rows, best])
        if not some.any():
            break
        kept[some, place] = candidates[rows, best][some]
        # Squared distances, so the relaxation is squared too.
        near = alpha * alpha * between[rows, best] <= away
        away[near & some[:, None]] = np.inf
        away[rows, best] = np.inf
    return kept


class Graph:
    """Adjacency of one shard, in lists of up to twice the degree while it is built."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM):
        self.points, self.degree, self.alpha, self.beam = points, degree, alpha, beam
        self.lists = np.full((len(points), 2 * degree), -1, dtype=np.int32)
        self.used = np.zeros(len(points), dtype=np.int64)
        self.entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())

    def build(self) -> Graph:
        order = np.random.default_rng(len(self.points)).permutation(len(self.points))
        order = np.r_[self.entry, order[order != self.entry]]
        begin = 1
        while begin < len(order):
            # The first steps are small, so that the graph is there to be searched.
            end = min(len(order), begin + min(JOINED, begin))
            self._join(order[begin:end])
            begin = end
        for begin in range(0, len(order), 1024):
            nodes = order[begin:begin + 1024]
            self._set(nodes, robust_prune(self.points, nodes, self.lists[nodes], self.degree, self.alpha))
        return self

    def _set(self, nodes: np.ndarray, neighbours: np.ndarray) -> None:
        self.lists[nodes] = -1
        self.lists[nodes, :self.degree] = neighbours
        self.used[nodes] = (neighbours >= 0).sum(axis=1)

    def _join(self, nodes: np.ndarray) -> None:
        found, _ = beam_search(self.points, self.lists, self.entry, self.points[nodes], self.beam)
        near = robust_prune(self.points, nodes, found, self.degree, self.alpha)
        self._set(nodes, near)
        row, column = np.nonzero(near >= 0)
        self._backwards(near[row, column].astype(np.int64), nodes[row])

    def _backwards(self, holders: np.ndarray, added: np.ndarray) -> None:
        order = np.argsort(holders, kind="stable")
        holders, added = holders[order], added[order]
        while len(holders):
            heads = np.r_[True, holders[1:] != holders[:-1]]
            place = np.arange(len(holders)) - np.flatnonzero(heads)[np.cumsum(heads) - 1]
            slot = self.used[holders] + place
            fits = slot < self.lists.shape[1]
            self.lists[holders[fits], slot[fits]] = added[fits]
            self.used += np.bincount(holders[fits], minlength=len(self.used))
            holders, added = holders[~fits], added[~fits]
            full = np.unique(holders)
            for begin in range(0, len(full), 1024):
                nodes = full[begin:begin + 1024]
                self._set(nodes, robust_prune(self.points, nodes, self.lists[nodes], self.degree, self.alpha))


def with_node(rows: DataFrame) -> DataFrame:
    """Rows with the hash that equal vectors share; adding 0.0 makes one zero of the two."""
    whole = F.transform(F.col("vector").cast("array<double>"), lambda x: x + F.lit(0.0))
    return rows.select("id", whole.alias("vector")).withColumn("node", F.xxhash64("vector"))


def members_of(rows: DataFrame) -> DataFrame:
    """Written table ``node, id, copies`` of all rows ``(id, vector)``."""
    return staged(with_node(rows).groupBy("node", "id").agg(F.count(F.lit(1)).alias("copies")), "members")


def build_index(rows: DataFrame, shard: int = SHARD_VECTORS) -> DataFrame:
    """Written index of the different vectors of rows ``(id, vector)``, one row per shard."""

    def graphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, points = matrix(row.column("ids")[0].as_py(), row.column("vectors")[0].as_py())
                graph = Graph(lifted(points)).build()
                lists = np.ascontiguousarray(graph.lists[:, :graph.degree])
                yield row.append_column("graph", pa.array([lists.tobytes()], pa.binary())).append_column(
                    "entry", pa.array([graph.entry], pa.int32())
                )

    different = with_node(rows).select(F.col("node").alias("id"), "vector").dropDuplicates(["id"])
    shards = blocks(different, shard)
    spread = shards.repartition(max(1, int(shards.sparkSession.sparkContext.defaultParallelism)), "block", "dim")
    return staged(spread.mapInArrow(graphs, INDEX), "graphs")


def _search(k: int, beam: int):
    def run(keys: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for shard in index.to_pylist():
            names, points = matrix(shard["ids"], shard["vectors"])
            high = lifted(points)
            graph = np.frombuffer(shard["graph"], dtype=np.int32).reshape(len(points), -1)
            for number, query_ids, query_vectors in zip(
                queries.column("block").to_pylist(), queries.column("ids").to_pylist(), queries.column("vectors").to_pylist()
            ):
                asked, wanted = matrix(query_ids, query_vectors)
                flat = np.c_[wanted, np.zeros(len(wanted))].astype(np.float32)
                found, _ = beam_search(high, graph, shard["entry"], flat, max(beam, k + 1))
                row, place = np.nonzero(found >= 0)
                node = found[row, place]
                scores = np.einsum("ij,ij->i", wanted[row], points[node])
                order = np.lexsort((names[node], -scores, row))
                row, node, scores = row[order], node[order], scores[order]
                # One more than k, for the query's own vector; those equal to the last stay, for ids settle ties.
                first = np.searchsorted(row, row)
                last = np.minimum(first + k, np.searchsorted(row, row, side="right") - 1)
                best = scores >= scores[last]
                row, node, scores = row[best], node[best], scores[best]
                out.append((number * (1 << 20) + row, asked[row], names[node], scores))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({
            "query_row": pa.array(columns[0].astype(np.int64)), "query_id": pa.array(columns[1].astype(np.int64)),
            "node": pa.array(columns[2].astype(np.int64)), "score": pa.array(columns[3].astype(np.float64)),
        })

    return run


def search(queries: DataFrame, index: DataFrame, members: DataFrame, k: int, beam: int = QUERY_BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score`` of rows ``(id, vector)`` against an index and its members."""
    asked = staged(blocks(queries, QUERY_BLOCK), "queries")
    found = staged(meet(asked, index, _search(k, beam), FOUND), "found")
    place = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"))
    near = found.withColumn("place", F.rank().over(place)).where(F.col("place") <= k + 1)
    # No query takes more ids of one vector than k, its own left out.
    order = Window.partitionBy("node").orderBy("id")
    first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    met = near.drop("place").join(first.select("node", F.col("id").alias("vec_id"), "copies"), "node")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long"))))
    rows = met.where(F.col("vec_id") != F.col("query_id")).select("query_row", "query_id", "vec_id", "score", each.alias("copy"))
    return best_of(rows, k)


def nearest(df: DataFrame, k: int, every: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows whose id is a multiple of ``every`` as queries against all rows."""
    ready(df.sparkSession)
    rows = placed(plain(df, id=id, vector=vector))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector")) & nonzero(F.col("vector")))
    rows = rows.select(F.col("id").cast("long").alias("id"), "vector", "place")
    return search(rows.where(F.pmod("id", F.lit(every)) == 0), build_index(rows), members_of(rows), k)
