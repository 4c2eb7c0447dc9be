"""Approximate nearest neighbours by random projections.

Each of several tables cuts space into cells: a few random directions, each cut
into intervals of one width. A reference row lies in one bucket per table, a
query row looks into its own bucket and the ones across the nearest interval
ends (multi-probe). Rows that meet are compared exactly inside the task, so every
distance is right; what is lost are neighbours that no table brought together.
Measure that with ``recall`` against the exact join.

The number of directions grows with the logarithm of the reference, which keeps
buckets about BUCKET_ROWS large. Buckets that differ in the last SLICE_DIRECTIONS
directions only are searched by one task: a query row looks into several of them and
is sent to it once. A larger slice is searched whole, in pieces of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.operators.neighbors import _arrow_type, _keys, _labels, _matrix, _result_schema, nearest_rows

BUCKET_ROWS = 4_096
PIECE_ROWS = 32_768  # rows of a piece of a larger slice
ASKED_ROWS = 32_768  # query rows of a piece
SLICE_DIRECTIONS = 2  # in which the buckets of a slice differ
CELLS = 3.0  # about how many intervals hold a direction's rows, at a width of 1.5


def _projected(x: np.ndarray, directions: np.ndarray, shifts: np.ndarray, width: float):
    """(interval numbers, places inside the interval from 0 to 1), rows x tables x directions."""
    at = np.einsum("nd,tmd->ntm", x, directions) / width + shifts
    cell = np.floor(at)
    return cell.astype(np.int64), at - cell


def _bucket(cells: np.ndarray, mixers: np.ndarray, start=np.uint64(0)) -> np.ndarray:
    """64-bit numbers of the buckets (..., directions); a rare clash adds candidates."""
    with np.errstate(over="ignore"):
        h = start + (cells.view(np.uint64) * mixers).sum(axis=-1, dtype=np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def _probes(places: np.ndarray, n: int) -> np.ndarray:
    """Steps (rows x tables x n x directions) to the cells nearest to the place:
    none first, then across one interval end or two, by squared distance."""
    rows, tables, m = places.shape
    steps = [np.zeros(m, np.int64)]
    for i in range(m):
        for s in (-1, 1):
            one = np.zeros(m, np.int64)
            one[i] = s
            steps.append(one)
    for a in steps[1 : 2 * m + 1]:
        for b in steps[1 : 2 * m + 1]:
            if np.flatnonzero(a)[0] < np.flatnonzero(b)[0]:
                steps.append(a + b)
    steps = np.array(steps)
    down, up = places ** 2, (1 - places) ** 2
    cost = down @ (steps == -1).T + up @ (steps == 1).T  # rows x tables x steps
    n = min(n, len(steps))
    best = np.argpartition(cost, n - 1, axis=2)[:, :, :n] if n < len(steps) else np.broadcast_to(
        np.arange(n), (rows, tables, n))
    return steps[best]


def knn_approximate(
    query: DataFrame, ref: DataFrame, k: int, key: str = "pid", vector: str = "x",
    label: str | None = None, exclude_self: bool = False, tables: int = 12, probes: int = 12,
    width: float = 1.5, seed: int = 42, block_rows: int = PIECE_ROWS, chunk_rows: int = ASKED_ROWS,
) -> DataFrame:
    """(q, r, dist, y, rank): up to ``k`` near ``ref`` rows of each query row,
    Euclidean, ties to the lower key. A query row that meets nothing has no row.

    ``width`` is in standard deviations of a projection. More ``tables`` and
    ``probes`` find more; each table sends the reference through the shuffle once,
    and a query row to each of the table's slices that it looks into.
    """
    n, dims, spread = _scale(ref, vector)
    if n == 0:
        return ref.sparkSession.createDataFrame([], _result_schema(
            query.select(F.col(key).alias("q")), ref.select(F.col(key).alias("r")))).drop("bag", "w")
    m = max(1, math.ceil(math.log(max(1.0, n / BUCKET_ROWS), CELLS)))
    rnd = np.random.default_rng(seed)
    directions = rnd.standard_normal((tables, m, dims))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    shifts = rnd.random((tables, m))
    mixers = rnd.integers(1, 2**63, (tables, m), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    length = max(width * spread, 1e-300)
    # Buckets that agree in the first directions of a table are a slice.
    leading = max(0, m - SLICE_DIRECTIONS)
    numbers = np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def place(batches, many: bool):
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, inside = _projected(_matrix(batch.column("x")), directions, shifts, length)
            cell = cell[:, :, None, :] + (_probes(inside, probes) if many else 0)  # rows x tables x steps x directions
            buckets = _bucket(cell, mixers[:, None, :])
            slices = _bucket(cell[..., :leading], mixers[:, None, :leading], numbers[:, None])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, _spots(slices, buckets)], names=[*batch.schema.names, "spots"])

    def placed(df: DataFrame, many: bool) -> DataFrame:
        schema = T.StructType([*df.schema.fields, T.StructField("spots", T.ArrayType(T.StructType([
            T.StructField("slice", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])))])
        rows = df.mapInArrow(lambda batches: place(batches, many), schema)
        return rows.withColumn("spot", F.explode("spots")).select(*df.columns, "spot.slice", "spot.buckets")

    y = (F.col(label) if label else F.lit(0)).cast("int").alias("y")
    asked = placed(query.select(F.col(key).alias("q"), F.col(vector).alias("x")), True)
    held = placed(ref.select(F.col(key).alias("r"), F.col(vector).alias("x"), y), False).withColumnRenamed("x", "rx")
    # Only slices with rows of both sides, and into how many pieces each side is cut.
    cut = lambda df, rows: df.groupBy("slice").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n"))
    sizes = cut(asked, chunk_rows).withColumnRenamed("n", "chunks").join(
        cut(held, block_rows).withColumnRenamed("n", "blocks"), "slice")
    upto = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name).cast("bigint") - 1))
    asked = asked.join(sizes, "slice").withColumn("chunk", F.pmod(F.xxhash64("q"), "chunks")).withColumn(
        "block", upto("blocks")).select("slice", "chunk", "block", "q", "x", "buckets")
    sent = held.join(sizes, "slice").withColumn("to_block", F.pmod(F.xxhash64("r"), "blocks")).withColumn(
        "to_chunk", upto("chunks")).select(
        F.col("slice").alias("to_slice"), "to_chunk", "to_block", "r", "rx", "y", F.col("buckets")[0].alias("bucket"))
    schema = _result_schema(asked, sent)
    schema = T.StructType([schema[name] for name in ("q", "r", "dist", "y")])
    found = asked.groupBy("slice", "chunk", "block").cogroup(
        sent.groupBy("to_slice", "to_chunk", "to_block")
    ).applyInArrow(_met(k, exclude_self, _arrow_type(schema["q"].dataType), _arrow_type(schema["r"].dataType)), schema)
    # A pair met in several tables has one rank; its copies go.
    order = Window.partitionBy("q").orderBy("dist", "r")
    ranked = found.withColumn("rank", F.dense_rank().over(order))
    return ranked.where(F.col("rank") <= k).dropDuplicates(["q", "rank"])


def _spots(slices: np.ndarray, buckets: np.ndarray) -> pa.ListArray:
    """Of each row the slices it has buckets in, each with those buckets."""
    n = len(slices)
    slices, buckets = slices.reshape(n, -1), buckets.reshape(n, -1)
    order = np.lexsort((buckets, slices), axis=1)
    slices, buckets = np.take_along_axis(slices, order, 1), np.take_along_axis(buckets, order, 1)
    first = np.ones(slices.shape, dtype=bool)
    first[:, 1:] = slices[:, 1:] != slices[:, :-1]
    once = first.copy()
    once[:, 1:] |= buckets[:, 1:] != buckets[:, :-1]  # a clash may name a bucket twice
    starts = np.flatnonzero(first[once])
    inner = pa.ListArray.from_arrays(
        pa.array(np.append(starts, int(once.sum())).astype(np.int32)), pa.array(buckets[once]))
    ends = np.concatenate([[0], np.cumsum(first.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
        [pa.array(slices[first]), inner], names=["slice", "buckets"]))


def _met(k: int, exclude_self: bool, q_type: pa.DataType, r_type: pa.DataType):
    """Make the cogrouped function: the k nearest of the rows that each query row
    meets in the buckets of a slice. A row's k-th distance so far bounds what is
    wanted of its next bucket."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, dist, qk, rk, y = np.zeros(0, int), np.zeros(0, int), np.zeros(0), None, None, None
        if left.num_rows and right.num_rows:
            qx, rx = _matrix(left.column("x")), _matrix(right.column("rx"))
            qk, rk = _keys(left.column("q")), _keys(right.column("r"))
            y = right.column("y").to_numpy()
            bucket = right.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            names, starts = np.unique(bucket[order], return_index=True)
            ends = np.append(starts[1:], len(order))
            looks = left.column("buckets").combine_chunks()
            seekers = np.repeat(np.arange(len(qk)), np.diff(looks.offsets.to_numpy()))
            wanted = looks.flatten().to_numpy()
            at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            here = names[at] == wanted
            seekers, at = seekers[here], at[here]
            by_bucket = np.argsort(at, kind="stable")
            seekers, at = seekers[by_bucket], at[by_bucket]
            bound = np.full(len(qk), np.inf)
            for i in np.unique(at).tolist():
                who = seekers[slice(*np.searchsorted(at, [i, i + 1]))]
                members = order[starts[i] : ends[i]]
                new, near, far = nearest_rows(
                    qx[who], qk[who], rx[members], rk[members], k, 2, exclude_self, bound[who])
                touched = np.zeros(len(qk), dtype=bool)
                touched[who[new]] = True
                again = touched[rows]
                some = tuple(np.concatenate([old[again], found]) for old, found in zip(
                    (rows, cols, dist), (who[new], members[near], far)))
                best, last = _nearest_of(*some, rk, k)
                bound[last[0]] = np.minimum(bound[last[0]], last[1])
                rows, cols, dist = (np.concatenate([old[~again], found]) for old, found in zip((rows, cols, dist), best))
        if not len(rows):
            return pa.table({"q": pa.array([], q_type), "r": pa.array([], r_type),
                             "dist": pa.array([], pa.float64()), "y": pa.array([], pa.int32())})
        return pa.table({"q": pa.array(qk[rows], q_type), "r": pa.array(rk[cols], r_type),
                         "dist": pa.array(dist), "y": _labels(y[cols])})

    return run


def _nearest_of(rows, cols, dist, rk, k: int):
    """The candidates of the ``k`` first (distance, key) of each row, one of each,
    and (rows, distance) of the k-th where there is one."""
    order = np.lexsort((rk[cols], dist, rows))
    rows, cols, dist = rows[order], cols[order], dist[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (dist[1:] != dist[:-1]) | (rk[cols[1:]] != rk[cols[:-1]])
    rows, cols, dist = rows[new], cols[new], dist[new]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    kept, last = rank < k, rank == k - 1
    return (rows[kept], cols[kept], dist[kept]), (rows[last], dist[last])


def _scale(ref: DataFrame, vector: str) -> tuple[int, int, float]:
    """(rows, dimensions, root mean square deviation of a component)."""
    cells = ref.select(F.posexplode(vector).alias("at", "v"))
    by_place = cells.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("var"))
    n, dims, var = by_place.agg(F.max("n"), F.count(F.lit(1)), F.avg("var")).first()
    return n or 0, dims, math.sqrt(var or 0.0)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(q, hits): how many of each query's ``k`` exact neighbours were found; rows
    at the distance of the k-th count as good as it."""
    last = exact.where(F.col("rank") <= k).groupBy("q").agg(
        F.max("dist").alias("reach"), F.count(F.lit(1)).alias("wanted"))
    near = found.join(last, "q").where(F.col("dist") <= F.col("reach")).groupBy("q").agg(F.count(F.lit(1)).alias("hits"))
    return last.join(near, "q", "left").select(
        "q", F.least(F.coalesce("hits", F.lit(0)), "wanted").alias("hits"), "wanted")
