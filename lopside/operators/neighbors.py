"""Exact k-nearest-neighbour join as block-against-block Arrow kernels.

A sample of the reference rows cuts space into cells (a k-d tree: halves along
the widest column), and each cell is cut into blocks of bounded size by key
hash, so a dense region or a mass of equal rows spreads over many blocks. Query
rows form chunks in the same way. A block and a chunk are one packed row each,
with the box around their vectors, and hold their rows in an order that keeps
runs of near rows together. A chunk first searches one block near it, which
bounds how far its rows' k-th neighbours can be. It then meets every block whose
box is within that reach, in a nested-loop join of the two packed tables: they
are read again for each pair of partitions, nothing is copied through a shuffle.
In a pair a run of query rows is compared with the runs of the block whose boxes
are within its reach, or everything at once where that is most of them. A task
keeps the k best of each row while it goes over its blocks, so at most k
candidates per row and partition of the reference leave it, and one window
merges them. No pair of rows is ever materialised, and nothing passes through
the driver but a bounded sample and one row of statistics per cell.

With ``weights`` (copies of a reference row per bag) the same pass answers
every bag at once; with ``projections`` each bag measures distance in its own
linear subspace and has a join of its own there.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.functions.hashing import seeded_hash
from lopside.session import materialize, small_table

BLOCK_ROWS = 8_192  # rows of one reference block: 2.6 MB at 40 columns
CHUNK_ROWS = 2_048
MERGED_ROWS = 8_192  # small blocks are searched together up to this many rows
FILLED = 0.75  # of a block, so that few cells are cut in two
MIN_CELLS = 4  # so that small inputs are cut, bounded and routed as large ones are
SAMPLE = 16  # rows per cell that place the cuts
SAMPLE_ROWS = 65_536  # at most
SAMPLE_PARTS = 1 << 20
AXES = 16  # coordinates of the boxes that the join itself compares
RUN_ROWS = 128  # rows of a block with a box of their own
GROUP_ROWS = 32  # rows of a chunk that are searched together
FIRST_RUNS = 4  # nearest runs that bound a group's rows
DENSE = 0.5  # share of runs within reach from which on all are compared at once
PACKED_BYTES = 64 << 20  # of one partition of packed rows
TILE_CELLS = 250_000  # distances held at once inside a kernel
SUM_CELLS = 65_536  # the same where columns are summed one by one
NARROW = (1e-12, 1e15)  # largest entries of vectors that are compared in 32 bits first
STAGE = 8  # columns summed before rows out of reach are left out
FEW = 16  # one in this many rows within reach are measured one by one
MANY = 4  # times k rows within a limit, before the k-th is searched for
SLACK = 1e-9
PARALLEL_BAGS = 4  # bags with projections that are laid out at once


@dataclass(frozen=True)
class _Layout:
    """Cells of the reference: cuts, middles, rows, first block and number of blocks."""

    cuts: "_Cuts"
    counts: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray

    @property
    def axes(self) -> list[int]:
        """The coordinates in which cells differ most."""
        spread = np.nan_to_num(self.cuts.centers.var(axis=0))
        return sorted(np.argsort(-spread, kind="stable")[:AXES].tolist())


@dataclass(frozen=True)
class _Cuts:
    """A k-d tree over a sample: node i sends rows of at most ``at[i]`` in column
    ``axis[i]`` to node ``low[i]``, others to ``high[i]``; leaves (axis -1) have a cell."""

    axis: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    cell: np.ndarray
    centers: np.ndarray  # of the cells

    @classmethod
    def fit(cls, sample: np.ndarray, cells: int) -> "_Cuts":
        """The fullest leaf is halved along its widest column until there are ``cells``."""
        nodes = [[-1, 0.0, 0, 0]]
        heap, leaves = [(-len(sample), 0, np.arange(len(sample)))], []
        while heap and len(heap) + len(leaves) < cells:
            _, node, rows = heapq.heappop(heap)
            x = sample[rows]
            axis = int(np.argmax(x.var(axis=0)))
            values = np.sort(x[:, axis])
            at = values[(len(values) - 1) // 2]
            if at == values[-1]:  # a mass at the top goes to the high side
                below = values[values < at]
                at = below[-1] if len(below) else at
            lower = x[:, axis] <= at
            if lower.all():
                leaves.append((node, rows))
                continue
            nodes[node] = [axis, float(at), len(nodes), len(nodes) + 1]
            for part in (rows[lower], rows[~lower]):
                heapq.heappush(heap, (-len(part), len(nodes), part))
                nodes.append([-1, 0.0, 0, 0])
        leaves += [(node, rows) for _, node, rows in heap]
        cell = np.zeros(len(nodes), dtype=np.int32)
        cell[[node for node, _ in leaves]] = np.arange(len(leaves))
        axis, at, low, high = (np.array(c) for c in zip(*nodes))
        centers = np.array([sample[rows].mean(axis=0) for _, rows in leaves])
        return cls(axis.astype(int), at.astype(float), low.astype(int), high.astype(int), cell, centers)

    def cells_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=int)
        rows = np.flatnonzero(self.axis[node] >= 0)
        while len(rows):
            here = node[rows]
            lower = x[rows, self.axis[here]] <= self.at[here]
            node[rows] = np.where(lower, self.low[here], self.high[here])
            rows = rows[self.axis[node[rows]] >= 0]
        return self.cell[node]


def knn_join(
    query: DataFrame, ref: DataFrame, k: int, p: int = 2, key: str = "pid",
    vector: str = "x", label: str | None = None, weights: str | None = None,
    n_bags: int = 1, projections: np.ndarray | None = None,
    exclude_self: bool = False, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(q, bag, r, dist, y, w, rank): the k nearest ``ref`` rows of each query row.

    Distance is Manhattan (p=1) or Euclidean (p=2); ties go to the lower key.
    With ``weights`` the neighbours are per bag and ``w`` is the copies.
    """
    if p not in (1, 2):
        raise ValueError("p is 1 or 2")
    fields = [F.col(key).alias("r"), F.col(vector).alias("rx")]
    fields.append((F.col(label) if label else F.lit(0)).cast("int").alias("y"))
    fields.append((F.col(weights) if weights else F.array(F.lit(1))).cast("array<int>").alias("bw"))
    # A row with a missing or infinite entry is at no distance from any other.
    finite = lambda column: F.forall(column, lambda v: F.abs(v) < F.lit(float("inf")))
    same = query is ref
    ref = materialize(ref.select(*fields).where(finite("rx")))
    if same:  # one copy serves both sides
        query = ref.select(F.col("r").alias("q"), F.col("rx").alias("x"))
    else:
        query = materialize(query.select(F.col(key).alias("q"), F.col(vector).alias("x")).where(finite("x")))
    n_bags = n_bags if weights else 1
    if projections is None:
        return _join(query, ref, k, p, n_bags, exclude_self, block_rows, chunk_rows)

    def one(bag: int) -> DataFrame:
        members = ref.where(F.get("bw", F.lit(bag)) > 0).withColumn("bw", F.array(F.get("bw", F.lit(bag))))
        return _join(
            _projected(query, "x", projections[bag]), _projected(members, "rx", projections[bag]),
            k, p, 1, exclude_self, block_rows, chunk_rows,
        ).withColumn("bag", F.lit(bag))

    # Each bag's layout is some small jobs, which would leave cores idle one after the other.
    with ThreadPool(min(PARALLEL_BAGS, n_bags)) as pool:
        found = pool.map(inheritable_thread_target(ref.sparkSession)(one), range(n_bags))
    return reduce(DataFrame.unionByName, found)


def _join(query, ref, k, p, n_bags, exclude_self, block_rows, chunk_rows) -> DataFrame:
    ref, layout = _lay_out(ref, block_rows)
    if layout is None:  # no reference rows: no neighbours
        return ref.sparkSession.createDataFrame([], _result_schema(query, ref))
    width = 8 * (layout.cuts.centers.shape[1] + 2)
    blocks = _packed(ref, "block", "r", "rx", ["y", "bw", "team"], _pieces(ref, int(layout.counts.sum()), width))
    chunked, n_query = _chunked(query, layout, k + exclude_self, chunk_rows)
    chunks = _packed(chunked, "chunk", "q", "x", ["home", "team"], _pieces(ref, n_query, width))
    q_type, r_type = chunks.schema["q"].dataType.elementType, blocks.schema["r"].dataType.elementType
    axes = layout.axes
    make = lambda chunk, pair, a: _Chunk(chunk, pair, a, k, p, n_bags, exclude_self, axes)
    sides = lambda table: table.drop("team").withColumnsRenamed({"x": "rx", "low": "rlow", "high": "rhigh"})

    # How far the rows of a chunk look, from one block near it.
    bounded = ["chunk", "team", "q", "x", "low", "high", "bound", "reach"]
    chunks = chunks.withColumns({"bound": F.lit(None).cast("binary"), "reach": F.lit(float("inf"))})
    first = chunks.join(sides(blocks), F.col("home") == F.col("block")).mapInArrow(
        _bounds(make, q_type), chunks.select(*bounded).schema)
    alone = chunks.join(blocks.select("block"), F.col("home") == F.col("block"), "left_anti").select(*bounded)
    chunks = first.unionByName(alone)
    chunks = _teams(chunks, n_bags, _pieces(chunks)) if chunk_rows < CHUNK_ROWS else materialize(chunks)
    if block_rows < MERGED_ROWS:
        blocks = _teams(blocks, n_bags, _pieces(blocks))

    gaps = [
        F.greatest(F.lit(0.0), F.get("low", F.lit(j)) - F.get("rhigh", F.lit(j)),
                   F.get("rlow", F.lit(j)) - F.get("high", F.lit(j)))
        for j in axes
    ]
    apart = sum((g if p == 1 else g * g for g in gaps), F.lit(0.0))
    near = ~(apart > (F.col("reach") if p == 1 else F.col("reach") * F.col("reach")))
    pairs = chunks.join(sides(blocks).hint("shuffle_replicate_nl"), near).select("chunk", "q", "x", "bound", "r", "rx", "rlow", "rhigh", "y", "bw")
    schema = _result_schema(query, ref)
    found = pairs.mapInArrow(_nearest(make, q_type, r_type), T.StructType(schema.fields[:-1]))
    order = Window.partitionBy("q", "bag").orderBy("dist", "r")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lay_out(ref: DataFrame, block_rows: int):
    n = ref.count()
    if n == 0:
        return ref, None
    # Small blocks do not make more cells than the square root: the join would
    # compare more boxes than the pruning saves.
    n_cells = min(n, max(MIN_CELLS, min(math.ceil(n / (FILLED * block_rows)), max(256, math.isqrt(n)))))
    cuts = _Cuts.fit(_sample(ref, n, SAMPLE * n_cells), n_cells)
    n_cells = len(cuts.centers)
    celled = _assign_cells(ref, "rx", cuts)  # cheaper again than written
    sizes = _sizes(celled)
    counts = np.array([sizes.get(c, 0) for c in range(n_cells)])
    blocks = np.ceil(counts / block_rows).astype(int)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(int)
    numbered = _numbered(celled, "r", "block", first, blocks, max(1, MERGED_ROWS // block_rows))
    return numbered.drop("cell", "sub"), _Layout(cuts, counts, first, blocks)


def _sample(ref: DataFrame, n: int, wanted: int) -> np.ndarray:
    """About ``wanted`` vectors, chosen by key hash: only the layout depends on them."""
    wanted = min(wanted, SAMPLE_ROWS)
    share = F.pmod(F.xxhash64("r"), F.lit(SAMPLE_PARTS)) < math.ceil(SAMPLE_PARTS * wanted / n)
    for rows in (ref.where(share), ref):  # repeated keys may leave none
        found = rows.select("rx").limit(2 * wanted).collect()
        if found:
            return np.array([row["rx"] for row in found], dtype=float)


def _sizes(celled: DataFrame) -> dict[int, int]:
    return {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def _numbered(celled: DataFrame, key: str, name: str, first, parts, together: int) -> DataFrame:
    """Add ``sub``, the part of its cell that a row's key falls in, ``name``, its number,
    and ``team``, the number of the ``together`` parts of a cell that are searched at once."""
    cells = len(parts)
    rows = [(c, int(a), int(max(n, 1))) for c, (a, n) in enumerate(zip(first, parts))]
    table = small_table(celled.sparkSession, rows, "cell int, first int, parts int")
    return (
        celled.join(F.broadcast(table), "cell")  # one row per cell
        .withColumn("sub", F.pmod(F.xxhash64(key), "parts").cast("int"))
        .withColumn(name, F.col("first") + F.col("sub"))
        .withColumn("team", (F.floor(F.col("sub") / together) * cells + F.col("cell")).cast("int"))
        .drop("first", "parts")
    )


def _chunked(query: DataFrame, layout: _Layout, least: int, chunk_rows: int) -> tuple[DataFrame, int]:
    """Add ``chunk`` (a bounded group of query rows) and its ``home`` block; and the rows."""
    celled = _assign_cells(query, "x", layout.cuts)
    sizes = _sizes(celled)
    chunks = np.array([max(1, math.ceil(sizes.get(c, 0) / chunk_rows)) for c in range(len(layout.counts))])
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    home = _homes(layout, least)
    rows = [(c, int(layout.first_block[h]), int(max(layout.blocks[h], 1))) for c, h in enumerate(home)]
    table = small_table(query.sparkSession, rows, "cell int, first_block int, blocks int")
    numbered = _numbered(celled, "q", "chunk", first, chunks, max(1, CHUNK_ROWS // chunk_rows))
    return (
        numbered.join(F.broadcast(table), "cell")
        .withColumn("home", F.col("first_block") + F.pmod("sub", "blocks"))
        .drop("cell", "sub", "first_block", "blocks")
    ), sum(sizes.values())


def _homes(layout: _Layout, least: int) -> np.ndarray:
    """Each cell's nearest cell with ``least`` rows or, if none has, with any."""
    allowed = np.flatnonzero(layout.counts >= least)
    if not len(allowed):
        allowed = np.flatnonzero(layout.counts)
    home = np.arange(len(layout.counts))
    for c in np.setdiff1d(home, allowed):
        gap = layout.cuts.centers[allowed] - layout.cuts.centers[c]
        home[c] = allowed[(gap * gap).sum(axis=1).argmin()]
    return home


def _matrix(column) -> np.ndarray:
    """A list<double> column as a dense matrix, without boxing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _keys(column) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def _labels(y: np.ndarray) -> pa.Array:
    """Labels of rows, some of which may be missing."""
    return pa.array(y, pa.int32(), from_pandas=True)


def _projected(df: DataFrame, vector: str, loadings: np.ndarray) -> DataFrame:
    """The rows with ``vector`` in the space of ``loadings``."""
    def project(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.ascontiguousarray(_matrix(batch.column(vector)) @ loadings)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                at = batch.schema.get_field_index(vector)
                yield batch.set_column(at, vector, pa.ListArray.from_arrays(ends, pa.array(x.ravel())))

    return df.mapInArrow(project, df.schema)


def _assign_cells(df: DataFrame, vector: str, cuts: _Cuts) -> DataFrame:
    """Add ``cell``, the leaf of the cuts that a row falls in."""
    def assign(batches):
        for batch in batches:
            cell = cuts.cells_of(_matrix(batch.column(vector))) if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))


def _in_runs(x: np.ndarray, rows: int) -> np.ndarray:
    """An order of the vectors in which runs of ``rows`` of them lie close together."""
    order = np.arange(len(x))
    stack = [(0, len(x))]
    while stack:
        a, b = stack.pop()
        if b - a <= rows:
            continue
        part = x[order[a:b]]
        axis = int((part.max(axis=0) - part.min(axis=0)).argmax())
        half = rows * math.ceil((b - a) / rows / 2)
        order[a:b] = order[a:b][np.argpartition(part[:, axis], half - 1)]
        stack += [(a, a + half), (a + half, b)]
    return order


def _pieces(df: DataFrame, rows: int = 0, width: int = 0) -> int:
    """Partitions of a packed table: enough for all cores, none too large to hold."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows * width / PACKED_BYTES))


def _packed(df: DataFrame, group: str, key: str, vector: str, carry: list[str], pieces: int) -> DataFrame:
    """One row per block or chunk: keys, vectors as bytes, the box around them.
    Of ``carry``, lists become bytes, ``home`` and ``team`` are one number, others are lists."""
    single = ("home", "team")
    fields = [
        T.StructField(group, T.IntegerType()), T.StructField(key, T.ArrayType(df.schema[key].dataType)),
        T.StructField("x", T.BinaryType()),
        T.StructField("low", T.ArrayType(T.DoubleType())), T.StructField("high", T.ArrayType(T.DoubleType())),
    ]
    for name in carry:
        kind = df.schema[name].dataType
        packed = T.BinaryType() if isinstance(kind, T.ArrayType) else kind if name in single else T.ArrayType(kind)
        fields.append(T.StructField(name, packed))

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(_in_runs(_matrix(table.column(vector)), run)))
        x = np.ascontiguousarray(_matrix(table.column(vector)))
        one = {
            group: table.column(group)[:1], key: _as_list(table.column(key)), "x": pa.array([x.tobytes()], pa.binary()),
            "low": pa.array([x.min(axis=0).tolist()]), "high": pa.array([x.max(axis=0).tolist()]),
        }
        for name in carry:
            column = table.column(name)
            if pa.types.is_list(column.type):
                one[name] = pa.array([_matrix(column).astype(np.int32).tobytes()], pa.binary())
            else:
                one[name] = column[:1] if name in single else _as_list(column)
        return pa.table(one)

    run = GROUP_ROWS if group == "chunk" else RUN_ROWS
    return materialize(df.repartition(pieces, group).groupBy(group).applyInArrow(pack, T.StructType(fields)))


def _teams(packed: DataFrame, n_bags: int, pieces: int) -> DataFrame:
    """Packed rows of one team as one: small blocks and chunks would send each
    other's vectors to the tasks many times."""
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by(table.column_names[0])
        one = {}
        for name in table.column_names:
            column = table.column(name)
            if name in ("low", "high"):
                one[name] = pa.array([(np.min if name == "low" else np.max)(_matrix(column), axis=0).tolist()])
            elif name == "bound":
                sizes = pc.list_value_length(table.column("q")).to_pylist()
                parts = [np.full((n_bags, n), np.inf) if b is None else np.frombuffer(b).reshape(n_bags, n)
                         for b, n in zip(column.to_pylist(), sizes)]
                one[name] = pa.array([np.ascontiguousarray(np.hstack(parts)).tobytes()], pa.binary())
            elif name == "reach":
                one[name] = pa.array([pc.max(column).as_py()])
            elif pa.types.is_list(column.type):
                one[name] = _as_list(pc.list_flatten(column))
            else:
                one[name] = pa.array([b"".join(column.to_pylist())], pa.binary()) if pa.types.is_binary(column.type) else column[:1]
        return pa.table(one)

    return materialize(packed.repartition(pieces, "team").groupBy("team").applyInArrow(merge, packed.schema))


def _as_list(column: pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)


class _Chunk:
    """A chunk in search: its rows' k nearest so far, per bag."""

    def __init__(self, chunk, pair, at, k, p, n_bags, exclude_self, axes):
        self.chunk, self.k, self.p, self.n_bags, self.exclude_self = chunk, k, p, n_bags, exclude_self
        self.axes = axes
        self.keys = _keys(pair.column("q").slice(at, 1).flatten())
        n = len(self.keys)
        self.x = np.frombuffer(pair.column("x")[at].as_py()).reshape(n, -1)
        bound = pair.column("bound")[at].as_py()
        self.bound = np.full((n_bags, n), np.inf) if bound is None else np.frombuffer(bound).reshape(n_bags, n).copy()
        self.best = [None] * n_bags  # row, distance, key, label, copies
        starts = np.arange(0, n, GROUP_ROWS)
        self.groups = list(zip(starts.tolist(), [*starts[1:].tolist(), n]))
        self.low, self.high = np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts)

    def search(self, pairs: pa.RecordBatch) -> None:
        sizes = pc.list_value_length(pairs.column("r")).to_numpy()
        group = (np.cumsum(sizes) - sizes) // MERGED_ROWS
        ends = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(sizes)]])
        for a, b in zip(ends[:-1], ends[1:]):
            self._blocks(pairs.slice(a, b - a))

    def _apart(self, low: np.ndarray, high: np.ndarray, axes) -> np.ndarray:
        """Least distances of the groups' boxes from others."""
        apart = np.zeros((len(self.low), len(low)))
        for j in axes:
            gap = np.maximum(low[None, :, j] - self.high[:, j, None], self.low[:, j, None] - high[None, :, j])
            np.maximum(gap, 0.0, out=gap)
            apart += gap if self.p == 1 else gap * gap
        return np.sqrt(apart) if self.p == 2 else apart

    def _reach(self, bag: int) -> np.ndarray:
        """How far the rows of each group look."""
        return np.array([self.bound[bag][a:b].max() for a, b in self.groups]) * (1.0 + SLACK)

    def _blocks(self, pairs: pa.RecordBatch) -> None:
        low, high = _matrix(pairs.column("rlow")), _matrix(pairs.column("rhigh"))
        reach = np.max([self._reach(bag) for bag in range(self.n_bags)], axis=0)
        # Of many small boxes the coordinates that tell most.
        apart = self._apart(low, high, self.axes if len(low) > 1 else range(self.x.shape[1]))
        used = np.flatnonzero(~(apart > reach[:, None]).all(axis=0))
        if not len(used):
            return
        if len(used) < len(low):
            pairs = pairs.take(pa.array(used))
        sizes = pc.list_value_length(pairs.column("r")).to_numpy()
        rk, y = _keys(pairs.column("r").flatten()), pairs.column("y").flatten().to_numpy(zero_copy_only=False)
        rx = np.frombuffer(b"".join(pairs.column("rx").to_pylist())).reshape(len(rk), -1)
        copies = np.frombuffer(b"".join(pairs.column("bw").to_pylist()), dtype=np.int32).reshape(len(rk), -1)
        starts = np.concatenate([np.arange(end - n, end, RUN_ROWS) for n, end in zip(sizes, np.cumsum(sizes))])
        low, high = np.minimum.reduceat(rx, starts), np.maximum.reduceat(rx, starts)
        apart = self._apart(low, high, range(self.x.shape[1]))
        runs = [np.arange(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(rk)])]
        for bag in range(self.n_bags):
            members = copies[:, bag] > 0
            if not members.any():
                continue
            inside = runs if members.all() else [run[members[run]] for run in runs]
            for rows, cols, dist in self._compare(bag, apart, inside, rk, rx):
                if len(rows):
                    self._keep(bag, (rows, dist, rk[cols], y[cols], copies[cols, bag]))

    def _compare(self, bag: int, apart: np.ndarray, runs: list, rk, rx):
        """(rows, reference rows, distances) of the rows that may be among the k nearest."""
        for g in np.flatnonzero(np.isinf(self._reach(bag))).tolist():
            a, b = self.groups[g]
            few = min(FIRST_RUNS, len(runs))
            nearest = np.argpartition(apart[g], few - 1)[:few]
            cols = np.concatenate([runs[i] for i in nearest])
            rows, _, dist = self._near(bag, a, b, cols, rk, rx)
            last = np.flatnonzero(np.bincount(rows, minlength=b - a) == self.k)
            farthest = np.zeros(b - a)
            np.maximum.at(farthest, rows, dist)
            self.bound[bag][a + last] = np.minimum(self.bound[bag][a + last], farthest[last])
        within = ~(apart > self._reach(bag)[:, None])
        n_runs = within.sum(axis=1)
        groups = np.flatnonzero(n_runs)
        if n_runs.sum() >= DENSE * within.size:
            rows, cols, dist = self._near(bag, 0, len(self.keys), np.concatenate(runs), rk, rx)
            yield rows, cols, dist
            return
        parts = []
        for g in groups.tolist():
            a, b = self.groups[g]
            cols = np.concatenate([runs[i] for i in np.flatnonzero(within[g])])
            rows, cols, dist = self._near(bag, a, b, cols, rk, rx)
            parts.append((rows + a, cols, dist))
        if parts:
            yield tuple(np.concatenate(part) for part in zip(*parts))

    def _near(self, bag: int, a: int, b: int, cols: np.ndarray, rk, rx):
        some = slice(None) if len(cols) == len(rk) and len(cols) and cols[0] == 0 and cols[-1] == len(rk) - 1 else cols
        rows, found, dist = nearest_rows(
            self.x[a:b], self.keys[a:b], rx[some], rk[some], self.k, self.p, self.exclude_self, self.bound[bag][a:b])
        return rows, cols[found], dist

    def _keep(self, bag: int, found: tuple) -> None:
        kept = None
        if self.best[bag] is not None:
            touched = np.zeros(len(self.keys), dtype=bool)
            touched[found[0]] = True
            again = touched[self.best[bag][0]]
            kept = tuple(part[~again] for part in self.best[bag])
            found = tuple(np.concatenate([part[again], new]) for part, new in zip(self.best[bag], found))
        order = np.lexsort((found[2], found[1], found[0]))
        rows = found[0][order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        last = rank == self.k - 1
        kth = found[1][order][last]
        order = order[rank < self.k]
        best = tuple(part[order] for part in found)
        self.best[bag] = best if kept is None else tuple(np.concatenate(pair) for pair in zip(kept, best))
        self.bound[bag][rows[last]] = np.minimum(self.bound[bag][rows[last]], kth)

    def result(self, q_type, r_type) -> pa.RecordBatch:
        bags = [(bag, best) for bag, best in enumerate(self.best) if best is not None]
        part = lambda i: np.concatenate([best[i] for _, best in bags])
        return pa.RecordBatch.from_arrays([
            pa.array(self.keys[part(0)], q_type),
            pa.array(np.concatenate([np.full(len(best[0]), bag, np.int32) for bag, best in bags])),
            pa.array(part(2), r_type), pa.array(part(1)), _labels(part(3)), pa.array(part(4), pa.int32()),
        ], names=["q", "bag", "r", "dist", "y", "w"])


def _searched(batches, make):
    """Chunks after all blocks that came with them; a chunk's pairs follow each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk").to_numpy()
        ends = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if held is None or held.chunk != chunk[a]:
                if held is not None:
                    yield held
                held = make(chunk[a], batch, a)
                held.home = batch.slice(a, 1)
            held.search(batch.slice(a, b - a))
    if held is not None:
        yield held


def _arrow_type(kind: T.DataType) -> pa.DataType:
    known = {"long": pa.int64(), "bigint": pa.int64(), "integer": pa.int32(), "int": pa.int32()}
    return known.get(kind.typeName(), pa.string())


def _bounds(make, q_type):
    """Each chunk with how far its rows look, from the pairs of chunk and home block."""
    def run(batches):
        for held in _searched(batches, make):
            row = held.home
            reach = float(held.bound.max()) * (1.0 + SLACK)
            yield pa.RecordBatch.from_arrays(
                [row.column("chunk"), row.column("team"), row.column("q"), row.column("x"), row.column("low"), row.column("high"),
                 pa.array([held.bound.tobytes()], pa.binary()), pa.array([reach])],
                names=["chunk", "team", "q", "x", "low", "high", "bound", "reach"])

    return run


def _nearest(make, q_type, r_type):
    """The candidates of each chunk, from its pairs with the blocks of one partition."""
    q_type, r_type = _arrow_type(q_type), _arrow_type(r_type)

    def run(batches):
        for held in _searched(batches, make):
            if any(best is not None for best in held.best):
                yield held.result(q_type, r_type)

    return run


def _result_schema(query: DataFrame, ref: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("q", query.schema["q"].dataType), T.StructField("bag", T.IntegerType()),
        T.StructField("r", ref.schema["r"].dataType), T.StructField("dist", T.DoubleType()),
        T.StructField("y", T.IntegerType()), T.StructField("w", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
    ])


def nearest_rows(qx, qk, rx, rk, k, p, exclude_self, limit):
    """Exact nearest rows as flat (query position, ref position, distance).

    ``limit`` is a distance per query row beyond which nothing is wanted; for rows
    that have one, comparing replaces the search for the k-th smallest.

    Euclidean candidates come from a matrix product, Manhattan ones may come from
    the first columns' sum, both with a rounding margin and in 32 bits where the
    range allows; all are then measured term by term in 64 bits, so distances do not
    depend on tiling, and none is lost to cancellation.
    """
    out_rows, out_cols, out_dist = [], [], []
    n_ref = len(rk)
    if n_ref == 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    tile = max(1, (SUM_CELLS if p == 1 else TILE_CELLS) // n_ref)
    columns = np.ascontiguousarray(rx.T)
    top = max(np.abs(rx).max(initial=0.0), np.abs(qx).max(initial=0.0))
    narrow = NARROW[0] < top < NARROW[1]
    kind = np.float32 if narrow else np.float64
    rounding = (len(columns) + 8) * 2.0**-22 if narrow else 0.0
    if p == 2:
        center = rx.mean(axis=0)  # smaller numbers, smaller rounding margin
        rc = rx - center
        r_sq = (rc * rc).sum(axis=1)
        rc = np.hstack([-2.0 * rc, r_sq[:, None]]).T.astype(kind)
    else:
        widest = np.argsort(-columns.std(axis=1), kind="stable")  # what tells rows apart first
        spread = columns[widest].astype(kind)
        r_top = np.abs(columns).sum(axis=0).max()
    if exclude_self:
        by_key = np.argsort(rk, kind="stable")
        own_first = np.searchsorted(rk[by_key], qk, side="left")
        own_last = np.searchsorted(rk[by_key], qk, side="right")
    for start in range(0, len(qk), tile):
        q = qx[start:start + tile]
        own = []
        if exclude_self:
            ends = zip(own_first[start:start + tile].tolist(), own_last[start:start + tile].tolist())
            own = [(i, by_key[a:b]) for i, (a, b) in enumerate(ends) if b > a]
        bound = limit[start:start + tile]
        open_rows = np.flatnonzero(np.isinf(bound))
        if p == 2:
            qc = q - center
            q_sq = (qc * qc).sum(axis=1)
            d = np.hstack([qc, np.ones((len(q), 1))]).astype(kind) @ rc  # less the row's own square
            margin = 1e-12 * (q_sq + r_sq.max() + 1.0) + rounding * (q_sq + r_sq.max())
            bound = bound * bound * (1.0 + SLACK) - q_sq
        else:
            margin = (1e-12 + rounding) * (np.abs(q).sum(axis=1) + r_top)
            bound = bound * (1.0 + SLACK)
            wide = q[:, widest].astype(kind)
            d, summed = _manhattan(wide, spread, None if len(open_rows) else (bound + 2.0 * margin).astype(kind))
        for i, same in own:
            d[i, same] = np.inf
        if len(open_rows):
            kk = min(k, n_ref)
            bound[open_rows] = np.partition(d[open_rows], kk - 1, axis=1)[:, kk - 1]
        reach = (bound + 2.0 * margin).astype(kind)
        near = d <= reach[:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > MANY * k)
        if len(many) and (p == 2 or summed == len(spread)):  # limits that tell little
            kth = np.partition(d[many], k - 1, axis=1)[:, k - 1]
            near[many] &= d[many] <= (kth + 2.0 * margin[many]).astype(kind)[:, None]
        if own or len(open_rows):
            near &= ~np.isinf(d)
        rows, cols = np.divmod(np.flatnonzero(near), n_ref)
        if p == 1 and summed < len(spread):
            rows, cols = _still_near(wide, spread, d[rows, cols], rows, cols, summed, reach)
        exact = np.zeros(len(rows))
        for j in range(q.shape[1]):
            gap = q[rows, j] - columns[j][cols]
            exact += np.abs(gap) if p == 1 else gap * gap
        if p == 2:
            exact = np.sqrt(exact)
        order = np.lexsort((rk[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = rank < k
        out_rows.append(rows[kept] + start)
        out_cols.append(cols[kept])
        out_dist.append(exact[kept])
    if not out_rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(out_rows), np.concatenate(out_cols), np.concatenate(out_dist)


def _manhattan(q: np.ndarray, columns: np.ndarray, bound: np.ndarray | None) -> tuple[np.ndarray, int]:
    """Distances, or with ``bound`` lower estimates where few are within it, and the
    number of columns summed."""
    d, gap = np.zeros((len(q), columns.shape[1]), q.dtype), np.empty((len(q), columns.shape[1]), q.dtype)
    for j in range(len(columns)):
        np.subtract(q[:, j, None], columns[j][None, :], out=gap)
        np.abs(gap, out=gap)
        d += gap
        if bound is not None and j % STAGE == STAGE - 1 and j + 1 < len(columns):
            if np.count_nonzero(d <= bound[:, None]) <= d.size // FEW:
                return d, j + 1  # few are left to measure
    return d, len(columns)


def _still_near(q, columns, d, rows, cols, summed: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs whose sum stays within the bound over the other columns."""
    for j in range(summed, len(columns)):
        d = d + np.abs(q[rows, j] - columns[j][cols])
        if j % STAGE == STAGE - 1 or j + 1 == len(columns):
            kept = d <= bound[rows]
            d, rows, cols = d[kept], rows[kept], cols[kept]
    return rows, cols


def vote_shares(neighbors: DataFrame, ks: list[int], weightings: list[str]) -> DataFrame:
    """(q, k, weighting, p): class-1 share for every k and weighting at once.

    ``neighbors`` holds at least max(ks) ranks per (q, bag). A row drawn c
    times into a bag counts as c neighbours. ``uniform`` is the plain share;
    ``distance`` weighs by 1/d, where rows at distance 0 take the whole vote.
    Bags are averaged, not voted.
    """
    before = F.sum("w").over(
        Window.partitionBy("q", "bag").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = neighbors.withColumn("before", F.coalesce(before, F.lit(0)))
    aggregates = [F.min("dist").alias("closest")]
    for k in ks:
        take = F.greatest(F.lit(0), F.least(F.col("w"), F.lit(k) - F.col("before"))).cast("double")
        inverse = F.try_divide(take, F.col("dist"))
        at_zero = F.when(F.col("dist") == 0.0, take)
        aggregates += [
            F.sum(take * F.col("y")).alias(f"u1_{k}"), F.sum(take).alias(f"u_{k}"),
            F.sum(inverse * F.col("y")).alias(f"d1_{k}"), F.sum(inverse).alias(f"d_{k}"),
            F.sum(at_zero * F.col("y")).alias(f"z1_{k}"), F.sum(at_zero).alias(f"z_{k}"),
        ]
    per_bag = counted.groupBy("q", "bag").agg(*aggregates)
    shares = []
    for k in ks:
        for weighting in weightings:
            uniform = F.col(f"u1_{k}") / F.col(f"u_{k}")
            by_distance = F.when(
                F.col("closest") == 0.0, F.col(f"z1_{k}") / F.col(f"z_{k}")
            ).otherwise(F.col(f"d1_{k}") / F.col(f"d_{k}"))
            shares.append(F.avg(uniform if weighting == "uniform" else by_distance).alias(f"p_{k}_{weighting}"))
    averaged = per_bag.groupBy("q").agg(*shares)
    cells = F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(wt).alias("weighting"), F.col(f"p_{k}_{wt}").alias("p"))
        for k in ks for wt in weightings
    ]))
    return averaged.select("q", cells.alias("s")).select("q", "s.*")
