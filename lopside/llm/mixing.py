"""Mixing sources to target weights by systematic sampling.

A source's target over its size is how often each of its documents is expected
in the mix. Documents of a source stand in a line (by size, then by a seeded
hash), their expected copies are summed along it, one random offset is added,
and a document is taken once for every whole number its stretch of the line
crosses. Neighbours in the line are of nearly one size, so the words taken are
off the target by about one document.

Expected copies are whole multiples of 2**-24, so that sums are exact, whatever
the order in which Spark adds them. The line is cut by range over source, size
and hash: a hot source, or a hot size, is many parts. Only part totals are
summed in one place, a row for each part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mixture: weights by place of the source, share of all
#: sizes as a ratio, and how often a source may be taken.
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
CAP = 2

UNIT_BITS = 24
PART_ROWS = 200_000
BROADCAST_ROWS = 200_000  # rows of a few numbers each


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(source, number, n_docs, source_size, target): a row for each source of
    ``sizes`` (source, size).

    Sources in order of their code points, null last, weigh ``weights`` in turn
    and share ``share[0] / share[1]`` of all sizes; no target is above ``cap``
    times its source's size, what it loses goes to the others by weight. In order
    of size over weight the capped sources come first, so running sums find them
    at once. One row a source meets in one task.
    """
    whole = "decimal(38,0)"
    own = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    own = own.withColumn("number", number).withColumn("weight", F.get(
        F.array(*[F.lit(w) for w in weights]), F.col("number").cast("int") % len(weights) - 1
        + F.when(F.col("number") % len(weights) == 0, len(weights)).otherwise(0)).cast("bigint"))
    everything = Window.partitionBy()
    line = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    most = F.col("source_size").cast(whole) * cap
    before = F.coalesce(F.sum(most).over(line.rowsBetween(Window.unboundedPreceding, -1)).cast(whole),
                        F.lit(0).cast(whole))
    open_weight = F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing))
    pool = (F.sum("source_size").over(everything) * share[0]).cast(whole)
    full = (most * open_weight * share[1]).cast(whole) <= (
        (pool - before * share[1]).cast(whole) * F.col("weight")).cast(whole)
    marked = own.withColumn("pool", pool).withColumn("full", full)
    taken = F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everything)
    rest = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    left = (F.col("pool") - taken * share[1]).cast("double")
    most_of = (F.col("source_size") * cap).cast("double")
    target = F.when(F.col("full"), most_of).otherwise(
        F.least(most_of, F.col("weight").cast("double") * left / (rest * share[1]).cast("double")))
    return marked.select("source", "number", "n_docs", "source_size", target.alias("target"))


def _line_up(batches):
    """Add ``part`` and ``upto``: copies summed from the part's first row of a source."""
    from pyspark import TaskContext

    part, last, carry = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("number").to_numpy()
        copies = batch.column("expected").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        total = np.cumsum(copies)
        base = total[first] - copies[first]
        if number[0] == last:
            base[0] -= carry
        upto = total - np.repeat(base, np.diff(np.append(first, len(number))))
        last, carry = number[-1], upto[-1]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(number), part, dtype=np.int32)), pa.array(upto)],
            names=[*batch.schema.names, "part", "upto"])


def draw_copies(docs: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP, seed: int = 0,
                carry: bool = True) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of every row of
    ``docs``, and with ``carry`` its columns as the struct ``doc``.

    ``docs`` needs doc_id, source and text. ``size`` counts words
    ``[^\\x20\\x09-\\x0D]+``; null, empty and blank texts have none, are drawn
    like others and add nothing. A null source is a source, the last one. A row
    is taken floor or ceiling of target / source_size times; sources without
    words are taken 0 times. Rows of one id are rows of their own; equal rows are
    interchangeable. The same rows and seed give the same copies, however they
    are dealt. An empty table gives an empty table; clashing names meet nothing.
    A source may hold 2**38 rows.
    """
    rows = docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                          .cast("binary")), 1, 16).alias("place"),
        F.xxhash64("text").alias("tag"),
        *([F.struct(*docs.columns).alias("doc")] if carry else []))
    rows = materialize(rows)
    targets = materialize(source_targets(rows, weights, share, cap))
    n_sources, n_docs = targets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    parts = max(1, math.ceil(n_docs / PART_ROWS))
    unit = float(1 << UNIT_BITS)
    expected = F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size") * unit + 0.5)).otherwise(0).cast("bigint")
    offset = F.conv(F.substring(F.md5(F.concat(
        F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))).cast("binary")), 1, UNIT_BITS // 4), 16, 10).cast("bigint")
    targets = targets.select(
        F.col("source").alias("of"), "number", "source_size", "target", expected.alias("expected"),
        offset.alias("offset"))

    def small(table: DataFrame, n: int) -> DataFrame:
        return F.broadcast(table) if n <= BROADCAST_ROWS else table

    known = rows.join(small(targets, n_sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    order = ["number", "size", "place", "doc_id", "tag"]
    lined = known.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*lined.schema.fields, T.StructField("part", T.IntegerType()),
                           T.StructField("upto", T.LongType())])
    lined = materialize(lined.mapInArrow(_line_up, schema))
    totals = lined.groupBy("number", "part").agg(F.max("upto").alias("total"))
    earlier = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("number", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    end = F.col("start") + F.col("upto") + F.col("offset")
    crossed = F.shiftright(end, UNIT_BITS) - F.shiftright(end - F.col("expected"), UNIT_BITS)
    return lined.join(small(starts, n_sources + parts), ["number", "part"]).select(
        "doc_id", "source", "size", "source_size", "target", crossed.alias("copies"),
        *(["doc"] if carry else []))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    drawn = draw_copies(docs, **how).where(F.col("copies") > 0)
    return drawn.select(F.explode(F.array_repeat("doc", F.col("copies").cast("int"))).alias("doc")).select("doc.*")
