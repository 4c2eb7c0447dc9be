"""Exact order statistics of many columns by radix selection.

``percentile`` keeps every distinct value of a column in one aggregation
buffer, which fails on continuous columns at scale. Here a double becomes an
unsigned number of the same order, and each pass counts the next DIGIT bits of
the values that share the leading bits found so far for a wanted rank. Five
passes fix all 64 bits. Partitions send counts, no value is ranked or gathered,
and a pass's running sum is over at most 2**DIGIT counts for each rank.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lopside.session import materialize, small_table

DIGIT = 13
BITS = 64
HELD = 1 << 20  # counts a task holds before it passes them on


def exact_quantiles(
    df: DataFrame, cols: list[str], fractions: list[float], only_with_nulls: bool = False
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles (nulls ignored) per column.

    ``only_with_nulls`` leaves out columns that are complete.
    """
    if not cols:
        return {}
    values = _narrow(df, cols)
    sizes = _sizes(values, len(cols))
    wanted = [i for i, (known, rows) in enumerate(sizes) if not only_with_nulls or rows > known]
    places = {(i, f): (sizes[i][0] - 1) * f for i in wanted if sizes[i][0] for f in fractions}
    ranks = {(i, end(at)) for (i, _), at in places.items() for end in (math.floor, math.ceil)}
    found = _select(values, ranks)

    def value(i: int, f: float) -> float | None:
        if (i, f) not in places:
            return None
        at = places[i, f]
        low, high = found[i, math.floor(at)], found[i, math.ceil(at)]
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {cols[i]: [value(i, f) for f in fractions] for i in wanted}


def order_statistics(df: DataFrame, cols: list[str], parts: int) -> dict[str, list[float]]:
    """The distinct values of rank floor(i * n / parts), i from 1 to parts - 1,
    in rising order; nulls are ignored, a column without values has none."""
    values = _narrow(df, cols)
    sizes = _sizes(values, len(cols))
    ranks = {(i, j * known // parts) for i, (known, _) in enumerate(sizes) if known for j in range(1, parts)}
    found = _select(values, ranks)
    return {c: sorted({v for (j, _), v in found.items() if j == i}) for i, c in enumerate(cols)}


def _narrow(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles, written once: every pass reads them."""
    return materialize(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]))


def _sizes(values: DataFrame, n: int) -> list[tuple[int, int]]:
    """(values, rows) of each column."""
    row = values.agg(F.count(F.lit(1)), *[F.count(f"c{i}") for i in range(n)]).first()
    return [(row[i + 1], row[0]) for i in range(n)]


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one, NaN is last."""
    raw = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    negative = (raw >> np.uint64(63)).astype(bool)
    return np.where(negative, ~raw, raw | np.uint64(1 << 63))


def from_ordered_bits(key: int) -> float:
    raw = key ^ (1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.array([raw], dtype=np.uint64).view(np.float64)[0])


def _select(values: DataFrame, ranks: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
    """The value of each (column, rank), ranks from 0."""
    # (column, leading bits) -> [(rank asked for, rank among those values)]
    open_ranks: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, rank in ranks:
        open_ranks.setdefault((i, 0), []).append((rank, rank))
    done = 0
    while done < BITS and open_ranks:
        width = min(DIGIT, BITS - done)
        slots = sorted(open_ranks)
        asked = [(s, asked, rank) for s, key in enumerate(slots) for asked, rank in open_ranks[key]]
        counts = values.mapInArrow(_digits(slots, done, width), "slot int, digit int, n bigint").groupBy(
            "slot", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(
            Window.partitionBy("slot").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        # As many rows as ranks were asked for.
        table = small_table(values.sparkSession, asked, "slot int, asked long, rank long")
        hits = (
            counts.withColumn("last", upto).withColumn("first", F.col("last") - F.col("n"))
            .join(F.broadcast(table), "slot")
            .where((F.col("first") <= F.col("rank")) & (F.col("rank") < F.col("last"))).collect()
        )
        open_ranks = {}
        for h in hits:
            i, prefix = slots[h["slot"]]
            open_ranks.setdefault((i, prefix << width | h["digit"]), []).append((h["asked"], h["rank"] - h["first"]))
        done += width
    return {(i, asked): from_ordered_bits(key) for (i, key), held in open_ranks.items() for asked, _ in held}


def _digits(slots: list[tuple[int, int]], done: int, width: int):
    """Task that counts the next ``width`` bits of values in each slot."""
    by_column: dict[int, list[tuple[int, int]]] = {}
    for s, (i, prefix) in enumerate(slots):
        by_column.setdefault(i, []).append((prefix, s))

    def count(batches):
        codes, times, pending = [], [], 0

        def summed():
            found, where = np.unique(np.concatenate(codes), return_inverse=True)
            return found, np.bincount(where.ravel(), np.concatenate(times), len(found)).astype(np.int64)

        def out(found, n):
            return pa.RecordBatch.from_arrays(
                [pa.array((found >> width).astype(np.int32)), pa.array((found & (2**width - 1)).astype(np.int32)),
                 pa.array(n)], names=["slot", "digit", "n"])

        for batch in batches:
            for i, held in by_column.items():
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                bits = ordered_bits(x)
                prefixes = np.array([p for p, _ in held], dtype=np.uint64)
                numbers = np.array([s for _, s in held], dtype=np.int64)
                lead = bits >> np.uint64(BITS - done) if done else np.zeros(len(bits), np.uint64)
                at = np.minimum(np.searchsorted(prefixes, lead), len(prefixes) - 1)
                inside = prefixes[at] == lead
                digit = (bits[inside] >> np.uint64(BITS - done - width)) & np.uint64(2**width - 1)
                found, n = np.unique(numbers[at[inside]] << width | digit.astype(np.int64), return_counts=True)
                codes.append(found)
                times.append(n)
                pending += len(found)
            if pending > HELD:  # not for every batch: the counts so far are sorted again
                found, n = summed()
                codes, times, pending = [found], [n], len(found)
                if pending > HELD // 2:
                    yield out(found, n)
                    codes, times, pending = [], [], 0
        if codes:
            yield out(*summed())

    return count


def long_form(df: DataFrame, cols: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, i, v): one row per cell, ``i`` the column's number.

    Aggregating cells by number needs one small generated loop; one aggregate
    per column would generate methods too large for the JIT on wide tables.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"))
        for i, c in enumerate(cols)
    ])
    return df.select(*keep, F.explode(cells).alias("_s")).select(*keep, "_s.i", "_s.v")
