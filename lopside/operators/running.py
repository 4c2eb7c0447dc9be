"""Exact running sums over groups of any size.

A window's running sum puts a whole group into one task. Here rows are cut by
range over group and order, so that a large group is many parts, each part is
summed on its own, and a part's start, the sum of the group's earlier parts,
is added back. Parts grow in number with the rows, not in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.session import materialize

PART_ROWS = 500_000
BROADCAST_ROWS = 200_000  # of starts, a few numbers each


def running_sums(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``<value>_upto`` for each of ``values`` (whole numbers): its sum
    over the rows of the same group up to and with this one. Nulls count 0 and
    are a group of their own in ``by``; rows that tie in ``order`` follow each
    other in any order."""
    taken = {"_g", "_part"} & set(df.columns)
    if taken:
        raise ValueError(f"columns called {sorted(taken)}")
    whole = materialize(df.withColumn("_g", F.xxhash64(*by) if by else F.lit(0).cast("bigint")))
    n_rows, n_groups = whole.agg(F.count(F.lit(1)), F.approx_count_distinct("_g")).first()
    parts = max(1, math.ceil(n_rows / PART_ROWS))
    sort = [*by, "_g", *order]
    lined = whole.repartitionByRange(parts, *sort).sortWithinPartitions(*sort)
    schema = T.StructType([*lined.schema.fields, T.StructField("_part", T.IntegerType()),
                           *[T.StructField(f"{v}_upto", T.LongType()) for v in values]])
    lined = materialize(lined.mapInArrow(_line_up(values), schema))
    totals = lined.groupBy("_g", "_part").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_g", "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}_start") for v in values])
    if 2 * n_groups + parts <= BROADCAST_ROWS:  # at most a row for each group and cut
        starts = F.broadcast(starts)
    joined = lined.join(starts, ["_g", "_part"])
    return joined.select(*df.columns, *[
        (F.col(f"{v}_upto") + F.col(f"_{v}_start")).alias(f"{v}_upto") for v in values])


def _line_up(values: list[str]):
    """Task that sums along its sorted rows, anew for each group."""
    def sums(batches):
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, [0] * len(values)
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("_g").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            runs = np.diff(np.append(first, len(group)))
            columns = []
            for i, name in enumerate(values):
                value = batch.column(name).cast(pa.int64()).fill_null(0).to_numpy()
                total = np.cumsum(value)
                base = total[first] - value[first]
                if last == group[0]:
                    base[0] -= carried[i]
                upto = total - np.repeat(base, runs)
                carried[i] = upto[-1]
                columns.append(pa.array(upto))
            last = group[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(group), part, dtype=np.int32)), *columns],
                names=[*batch.schema.names, "_part", *[f"{v}_upto" for v in values]])

    return sums
