"""Questions from blocks of documents to shards of a corpus-wide key space.

A corpus statistic per key (how many documents hold this shingle, how often
does this word pair occur) has far too many keys to send as rows. Documents are
dealt into blocks of a few megabytes of text; a block sends each shard of the
key space one packed, sorted array of its distinct keys; a shard answers every
block with one packed array in the same order; and the block, whose texts meet
the answers by a cogroup on the block number, goes on. A key that a third of
all documents hold so reaches its shard once per block.

Texts are shuffled once: every step asks for the same repartitioning of the
same rows, which Spark computes once per job.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.llm import kernel

BLOCK_BYTES = 8 << 20
MAX_PARTITIONS = 50_000  # more blocks than that share partitions, a group each
PACKED = 5  # bytes a key takes besides its shard number
ASKED = "block int, shard int, body binary, extra binary"


def text_size(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0


def in_blocks(docs: DataFrame, size: int, block: Column | None = None, blocks: int | None = None,
              **columns: Column) -> DataFrame:
    """(block, doc_id, text, and ``columns``), partitioned by block.

    Rows are dealt by a hash of id and text unless ``block`` says otherwise.
    """
    blocks = blocks or max(1, math.ceil(size / BLOCK_BYTES))
    if block is None:
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks))
    rows = docs.select(block.cast("int").alias("block"), "doc_id", "text",
                       *[c.alias(n) for n, c in columns.items()])
    return rows.repartition(min(blocks, MAX_PARTITIONS), "block")


def shard_bits(keys: int, per_shard: int = 1 << 20) -> int:
    """Bits of the shard number for about ``per_shard`` keys in a shard."""
    return max(4, math.ceil(math.log2(max(1, keys / per_shard))))


def pack(keys: np.ndarray, bits: int, width: int = PACKED) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(shards, first key of each and the end, packed keys) of sorted keys.

    ``bits`` + 8 * ``width`` leading bits of a key are kept. With 40, two keys fall
    together with a probability of about (keys in a shard) / 2**40, which is for
    uses that a needless answer does not harm; 8 bytes keep the whole key.
    """
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    present, first = np.unique(shard, return_index=True)
    ends = np.append(first, len(keys))
    low = (keys << np.uint64(bits)) >> np.uint64(64 - 8 * width)
    return present, ends, [narrow(low[a:b], width) for a, b in zip(ends[:-1], ends[1:])]


def narrow(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(body: bytes, width: int = PACKED) -> np.ndarray:
    raw = np.frombuffer(body, dtype=np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :width] = raw
    return wide.view("<u8").ravel()


def asked(block: int, shards, bodies, extras=None) -> pa.Table:
    n = len(bodies)
    return pa.table({
        "block": pa.array([block] * n, pa.int32()), "shard": pa.array(list(map(int, shards)), pa.int32()),
        "body": pa.array(bodies, pa.binary()),
        "extra": pa.array(extras if extras is not None else [None] * n, pa.binary())})


def answers_in_order(table: pa.Table, dtype) -> np.ndarray:
    """The answers to one block, joined in order of its keys."""
    rows = sorted(zip(table.column("shard").to_pylist(), table.column("body").to_pylist()),
                  key=lambda r: r[0])
    return np.concatenate([np.frombuffer(b, dtype=dtype) for _, b in rows] or [np.zeros(0, dtype)])


def distinct_pairs(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs, sorted by both."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    keep = np.ones(len(key), dtype=bool)
    keep[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[keep], key[keep]


def shingles(column, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, shingle hash) of a column, sorted.

    A shingle is ``width`` consecutive words; a text of fewer words has one,
    its whole sequence; a text without words has none.
    """
    words, pointers = kernel.lowered_words(column, kernel.NOT_SPACE)
    n = np.diff(pointers)
    row = np.repeat(np.arange(len(n)), n)
    m = max(0, len(words) - width + 1)
    inside = row[:m] == row[width - 1 :][:m]
    full = kernel.sequence_hash([words[i : i + m] for i in range(width)])[inside]
    rows, keys = [row[:m][inside]], [full]
    for short in range(1, width):
        those = np.flatnonzero(n == short)
        at = pointers[:-1][those]
        rows.append(those)
        keys.append(kernel.sequence_hash([words[at + i] for i in range(short)]))
    return distinct_pairs(np.concatenate(rows), np.concatenate(keys))


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte significance, so that small ones compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def counts_of(values: np.ndarray) -> bytes:
    """Whole numbers by byte significance, as many bytes as the largest needs;
    how many numbers there are is for the reader to know."""
    values = np.asarray(values).astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def read_counts(body: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """(n numbers written by ``counts_of``, where they end in ``body``)."""
    width, at = body[at], at + 1
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(body, dtype=np.uint8, count=width * n, offset=at).reshape(width, n).T
    return wide.view("<u8").ravel(), at + width * n


def from_planes(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").ravel()
