"""Line dedup by overlapping three-line windows.

The lines of a text (cut at ``\\n``) that hold more than white space are
numbered; every three consecutive ones are a window. A window seen before, in a
document of smaller id or further up in the same one, is a repeat, and all
lines of repeats go. Windows overlap, so a repeated passage goes as a whole:
covered lines are merged per document.

Each batch of texts finds its own repeats first and passes on one row per
distinct window, so a window that a third of all documents hold reaches its
task once per batch, not once per document. Windows are compared by two
independent hashes of 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import kernel

WINDOW = 3
BATCH_BYTES = 8 << 20


def _line_windows(column):
    """(two hashes, row, number of the first line) of every window of a column."""
    data, offsets = kernel.text_bytes(column)
    table = np.ones(256, dtype=bool)
    table[0x0A] = False
    starts, ends, _ = kernel.word_spans(data, offsets, table)
    solid = np.concatenate([[0], np.cumsum(kernel.NOT_SPACE[data])])
    some = solid[ends] > solid[starts]
    starts, ends = starts[some], ends[some]
    pointers = np.searchsorted(starts, offsets)
    hashes = kernel.span_hashes(data, starts, ends)
    others = kernel.span_hashes(data, starts, ends, kernel.OTHER_VALUE)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(pointers))
    n = max(0, len(hashes) - WINDOW + 1)
    inside = row[:n] == row[WINDOW - 1 :][:n]
    one = kernel.sequence_hash([hashes[i : i + n] for i in range(WINDOW)])
    two = kernel.sequence_hash([others[i : i + n] for i in range(WINDOW)])
    at = np.arange(n) - pointers[:-1][row[:n]]
    return one[inside], two[inside], row[:n][inside], at[inside]


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, at): windows that stand earlier as well, by document.

    ``tag`` is a hash of the text: rows that share an id but not a text are
    told apart, and rows that share both count as one.
    """
    key = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        T.StructField("doc_id", key), T.StructField("tag", T.LongType()),
        T.StructField("at", T.LongType()), T.StructField("later", T.BooleanType())])

    def emit(batches):
        for whole in batches:
            for batch in kernel.chunks(whole, "text", BATCH_BYTES):
                one, two, row, at = _line_windows(batch.column("text"))
                # Rows in the order in which documents count; equal rows share a place.
                ids = pa.table({"i": batch.column("doc_id"), "t": batch.column("tag")})
                ranks = pc.sort_indices(
                    ids, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start")
                ordered = ids.take(ranks)
                before, after = ordered.slice(0, max(0, len(ids) - 1)), ordered.slice(1)
                same = np.ones(max(0, len(ids) - 1), dtype=bool)
                for name in ("i", "t"):
                    a, b = before.column(name), after.column(name)
                    equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    same &= equal.to_numpy(zero_copy_only=False).astype(bool)
                place = np.empty(len(ids), dtype=np.int64)
                place[ranks.to_numpy()] = np.concatenate([[0], np.cumsum(~same)])[: len(ids)]
                order = np.lexsort((at, place[row], two, one))
                one, two, row, at = one[order], two[order], row[order], at[order]
                twin = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                tie = twin & (place[row][1:] == place[row][:-1]) & (at[1:] == at[:-1])
                later = np.concatenate([[False], twin & ~tie])[: len(one)]
                if len(one) and (tie & twin).any():  # a tie is later if its twin is
                    later = _carry(later, np.concatenate([[False], tie]))
                picked = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     batch.column("doc_id").take(picked), batch.column("tag").take(picked),
                     pa.array(at), pa.array(later)], names=schema.names)

    windows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(emit, schema)
    first = windows.where(~F.col("later"))
    # rank() gives equal rows one place: a repeated row is no repeat of itself.
    place = F.rank().over(Window.partitionBy("h1", "h2").orderBy("doc_id", "tag", "at"))
    again = first.withColumn("place", place).where(F.col("place") > 1)
    return again.select("doc_id", "tag", "at").unionAll(
        windows.where("later").select("doc_id", "tag", "at"))


def _carry(flags: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rows marked ``tie`` take the flag of the row before their run of ties."""
    source = np.where(tie, 0, np.arange(len(flags)))
    return flags[np.maximum.accumulate(source)]


def line_dedup(docs: DataFrame, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """Every column of ``docs`` with repeated lines taken out of ``text``, plus
    two ``counts``: lines, and lines removed.

    What stays is joined by line ends, so blank lines stay. Texts that lose
    nothing (also null, empty, or of fewer than three solid lines) come back as
    they were; a text can become empty but no row goes. An empty table gives an
    empty table. Columns called like ``counts`` are replaced.
    """
    names = [c for c in docs.columns if c not in counts]
    repeats = repeated_windows(docs).groupBy("doc_id", "tag").agg(F.collect_set("at").alias("at"))
    repeats = repeats.select(F.col("doc_id").alias("repeat_id"), F.col("tag").alias("repeat_tag"), "at")
    # Other columns travel in a struct, where their names clash with nothing.
    others = [c for c in names if c not in ("doc_id", "text")]
    carried = F.struct(*others) if others else F.lit(0)
    rows = docs.select("doc_id", "text", carried.alias("carried"), F.xxhash64("text").alias("tag"))
    joined = rows.join(
        repeats, F.col("doc_id").eqNullSafe(F.col("repeat_id")) & (F.col("tag") == F.col("repeat_tag")),
        "left")
    cut = F.col("at").isNotNull()
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    numbers = F.sequence(F.lit(0), F.size("lines") - 1)
    solid = F.filter(numbers, lambda i: F.get("lines", i).rlike(r"[^\x20\x09-\x0D]"))
    steps = F.array(*[F.lit(i) for i in range(WINDOW)])
    gone = F.array_distinct(F.flatten(F.transform(
        "at", lambda a: F.transform(steps, lambda i: F.get("solid", (a + i).cast("int"))))))
    stays = F.array_except(numbers, "gone")
    kept = F.array_join(F.transform(stays, lambda i: F.get("lines", i)), "\n")
    out = joined.withColumn("lines", lines).withColumn("solid", F.when(cut, solid))
    out = out.withColumn("gone", F.when(cut, gone))
    final = {"doc_id": F.col("doc_id"), "text": F.when(cut, kept).otherwise(F.col("text")).alias("text")}
    return out.select(
        *[final[c] if c in final else F.col("carried")[c].alias(c) for c in names],
        F.size("lines").cast("bigint").alias(counts[0]),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias(counts[1]))
