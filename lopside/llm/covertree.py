"""Exact top-k inner product by dual-tree search over cover trees.

Vectors are scaled to integers first, so scores are exact. Data are dealt into
shards and queries into blocks, both of bounded size; each (block, shard) pair
is one group: both sides are indexed by a cover tree, the two trees are
descended together, and a pair of nodes is left out when no vector of the one
can reach the worst k-th score in the other:

    max <q, x> <= <cq, cx> + rq |cx| + rx |cq| + rq rx

with centres c and covering radii r. Results of the shards are merged by rank.
A vector that a third of all rows hold is spread over the shards by id and
stands once in a shard's tree, with its smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
FANOUT = 16
QUERY_BLOCK = 4096
DATA_SHARD = 4096


class CoverTree:
    """Nested centres: a node's points lie within its radius of its centre, and
    the centres of its children are points of it, apart by more than the
    children's radius unless the fan-out ends the cover early."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[int, float, np.ndarray, list[int]]] = []
        if len(points):
            self._build(np.arange(len(points)), 0)

    def _distances(self, members: np.ndarray, center: int) -> np.ndarray:
        gap = self.points[members] - self.points[center]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def _build(self, members: np.ndarray, center: int) -> int:
        number = len(self.nodes)
        near = self._distances(members, center)
        radius = float(near.max())
        self.nodes.append((center, radius, members, []))
        if len(members) <= LEAF or radius == 0.0:
            return number
        owner, centers = np.zeros(len(members), dtype=int), [center]
        while len(centers) < FANOUT and near.max() > radius / 2:
            far = int(members[near.argmax()])
            gaps = self._distances(members, far)
            closer = gaps < near
            owner[closer], near = len(centers), np.minimum(near, gaps)
            centers.append(far)
        for i, c in enumerate(centers):
            self.nodes[number][3].append(self._build(members[owner == i], c))
        return number


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class _Search:
    """Best k (score, id) of each query, from a dual descent."""

    def __init__(self, queries, query_ids, data, ids, k: int):
        self.k, self.ids, self.query_ids = k, ids, query_ids
        big = (np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1]))
        kind = np.float64 if float(big) < 2.0**52 else np.int64
        self.q, self.x = queries.astype(kind), data.astype(kind)
        self.qf, self.xf = queries.astype(np.float64), data.astype(np.float64)
        self.q_norm = np.sqrt((self.qf**2).sum(axis=1))
        self.x_norm = np.sqrt((self.xf**2).sum(axis=1))
        self.q_tree, self.x_tree = CoverTree(self.qf), CoverTree(self.xf)
        self.found = np.zeros((len(queries), k), dtype=np.int64)
        self.score = np.zeros((len(queries), k), dtype=np.int64)
        self.worst = np.full(len(queries), -np.inf)
        self.filled = np.zeros(len(queries), dtype=np.int64)
        self.copies = {}  # of leaves

    def run(self) -> None:
        if not len(self.q) or not len(self.x):
            return
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            cq, rq, queries, q_children = self.q_tree.nodes[a]
            cx, rx, _, x_children = self.x_tree.nodes[b]
            if self._bound(cq, rq, cx, rx) < self.worst[queries].min():
                continue
            if not q_children and not x_children:
                self._leaves(queries, b)
                continue
            below_q = q_children or [a]
            below_x = x_children or [b]
            pairs = [(i, j) for i in below_q for j in below_x]
            # The most promising pair is taken off the stack first.
            pairs.sort(key=lambda p: self._bound(*self.q_tree.nodes[p[0]][:2], *self.x_tree.nodes[p[1]][:2]))
            stack += pairs

    def _bound(self, cq, rq, cx, rx) -> float:
        top = (float(self.qf[cq] @ self.xf[cx]) + rq * self.x_norm[cx] + rx * self.q_norm[cq] + rq * rx)
        return top + 1e-9 * abs(top) + 1.0

    def _copies(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(place among the node's points, id) of every row that is one of them."""
        if node not in self.copies:
            kept = self.ids[self.x_tree.nodes[node][2]]
            self.copies[node] = np.repeat(np.arange(len(kept)), [len(i) for i in kept]), np.concatenate(kept)
        return self.copies[node]

    def _leaves(self, queries: np.ndarray, node: int) -> None:
        points = self.x_tree.nodes[node][2]
        scores = self.q[queries] @ self.x[points].T
        places, ids = self._copies(node)
        if len(places) > len(points):
            scores = scores[:, places]
        could = scores >= self.worst[queries][:, None]
        could &= ids != self.query_ids[queries][:, None]
        row, col = np.divmod(np.flatnonzero(could), len(ids))
        if not len(row):
            return
        # The best so far of the queries that have candidates stand with them.
        touched = np.unique(row)
        n = self.filled[queries[touched]]
        before = np.arange(self.k) < n[:, None]
        row = np.concatenate([row, np.repeat(touched, n)])
        score = np.concatenate([scores[could].astype(np.int64), self.score[queries[touched]][before]])
        vec = np.concatenate([ids[col], self.found[queries[touched]][before]])
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = rank < self.k
        q, rank, score, vec = queries[row[best]], rank[best], score[best], vec[best]
        self.score[q, rank], self.found[q, rank] = score, vec
        np.maximum.at(self.filled, q, rank + 1)
        last = rank == self.k - 1
        self.worst[q[last]] = score[last]


def _groups(k: int):
    def search(queries, data):
        names = ["query_id", "vec_id", "score"]
        qs, xs = queries.column("v").to_pylist(), data.column("v").to_pylist()
        width = max(map(len, qs + xs), default=0)
        q, x = _matrix(qs, width), _matrix(xs, width)
        order = np.argsort(data.column("id").to_numpy(), kind="stable")
        x, all_ids = x[order], data.column("id").to_numpy()[order]
        unique, inverse = np.unique(x, axis=0, return_inverse=True) if len(x) else (x, np.zeros(0, int))
        inverse = inverse.ravel()
        by = np.argsort(inverse, kind="stable")
        cuts = np.searchsorted(inverse[by], np.arange(len(unique) + 1))
        ids = np.empty(len(unique), dtype=object)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            ids[i] = all_ids[by[a:b]][: k + 1]  # one of them may be the query's own
        s = _Search(q, queries.column("id").to_numpy(), unique, ids, k)
        s.run()
        rows = np.repeat(np.arange(len(q)), s.filled)
        within = np.concatenate([np.arange(n) for n in s.filled]) if len(q) else np.zeros(0, int)
        within = within.astype(int)
        return pa.table([pa.array(s.query_ids[rows]), pa.array(s.found[rows, within]),
                         pa.array(s.score[rows, within])], names=names)
    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best vectors of each query.

    Both tables have ``vec_id`` and ``embedding``; a component x counts as
    ``floor(scale * x)``, x as double, the score is the inner product, ties go to
    the smaller id, and a query's own id is no candidate. Vectors that are null
    or hold null or non-finite components take no part; of two lengths the
    shorter is padded with zeros; equal vectors are candidates each. Rows that
    repeat an id are one. Scores beyond 64 bits are not defined. Empty tables
    give an empty table.

    Work is pruned inside block and shard pairs; that every block meets every
    shard is what an exact search without known bounds costs.
    """
    def usable(df: DataFrame) -> DataFrame:
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
        kept = df.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & fine)
        return kept.select(F.col("vec_id").alias("id"), scaled.alias("v")).dropDuplicates(["id"])

    data, asked = usable(vectors), usable(queries)
    shards = max(1, math.ceil(vectors.count() / DATA_SHARD))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    data = data.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    columns = ["block", "shard", "id", "v"]
    found = asked.select(*columns).groupBy("block", "shard").cogroup(
        data.select(*columns).groupBy("block", "shard")
    ).applyInArrow(_groups(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
