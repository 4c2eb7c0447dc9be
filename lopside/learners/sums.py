"""Sums of fixed-size blocks over all rows of a table.

Each partition adds up its own block; blocks are then added in groups of at
most FAN_IN, level by level, in one order, so no task holds many of them and the
driver gets the last one only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64  # blocks merged in one group


def merged(parts: DataFrame, partitions: int, last: Callable, schema: str) -> DataFrame:
    """Blocks (chunk, part, h) added up by chunk, at most FAN_IN in one group;
    ``last(chunk, sum)`` makes the rows of ``schema``."""
    def add(table: pa.Table) -> np.ndarray:
        table, summed = table.sort_by("part"), None  # one order of adding
        for h in table.column("h"):
            block = np.frombuffer(h.as_py(), dtype=np.float64)
            summed = block.copy() if summed is None else summed + block
        return summed

    def some(key, table):
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                         "h": pa.array([add(table).tobytes()], pa.binary())})

    while partitions > FAN_IN:
        parts = parts.groupBy("chunk", F.floor(F.col("part") / FAN_IN).cast("int").alias("group")).applyInArrow(
            some, "chunk int, part int, h binary")
        partitions = -(-partitions // FAN_IN)
    return parts.groupBy("chunk").applyInArrow(lambda key, table: last(key[0].as_py(), add(table)), schema)


def partitions_of(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def sum_blocks(table: DataFrame, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of ``of(x, y, w)`` over the batches of (x, y, w), added in groups of
    bounded size; x has a leading column of ones."""
    def blocks(batches):
        from pyspark import TaskContext

        total = np.zeros(shape)
        for batch in batches:
            n = batch.num_rows
            if n:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                if np.isnan(x).any():
                    raise ValueError("a training row lacks a feature")
                w = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                total += of(np.hstack([np.ones((n, 1)), x]), batch.column(1).to_numpy(), w.astype(float))
        yield pa.RecordBatch.from_arrays(
            [pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()),
             pa.array([total.tobytes()], pa.binary())], names=["chunk", "part", "h"])

    parts = table.mapInArrow(blocks, "chunk int, part int, h binary")
    rows = merged(parts, partitions_of(table), lambda _, h: pa.table({"s": pa.array([h])}), "s array<double>").collect()
    return np.array(rows[0]["s"]).reshape(shape) if rows else np.zeros(shape)
