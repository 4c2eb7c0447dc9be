"""Exact-substring dedup with a logarithmic family of suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts in a document of
smaller id goes. Documents come in batches of ascending ids. A batch gets a
(sparse) suffix array: of every ``LENGTH`` consecutive positions at least one is
sampled by content, the least hash of the ``GRAM`` bytes that start there, so that
equal strings sample alike, and each sampled suffix is taken with the bytes to
its left that a string through it can hold. Samples whose ``GRAM`` bytes stand
in one document only cannot be part of a match and are dropped first.

Suffixes are dealt to shards by those bytes. A shard keeps its index as levels
of geometrically growing size: the next batch's sorted suffixes are
merge-scanned against the levels, matches are reported to the batch, what is
new becomes a level, and levels of about equal size merge. A suffix is so
merged a logarithmic number of times. Levels hold suffixes cut to ``LENGTH``
bytes as 64-bit fingerprints in sorted order, which is all that a scan for
matches of that length needs.

Texts copied many times meet their shard once per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import exchange as X
from lopside.llm import kernel

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # sampled positions a string can be found by
LEFT = SPAN - 1  # bytes before a sampled position that belong to its strings
CONTEXT = LEFT + LENGTH
PAD = 0xFF  # in no UTF-8 text
U64 = np.uint64
_BYTE32 = (kernel.BYTE_VALUE >> U64(32)).astype(np.uint32) | np.uint32(1)
_WEIGHTS = kernel.mix(np.arange(1, CONTEXT + 1, dtype=np.uint64) * kernel.MULTIPLIERS[7]) | U64(1)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of every ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while 2 * have <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = best(out[: len(out) - rest], out[rest:])
    return out


def _grams(data: np.ndarray) -> np.ndarray:
    """32-bit hash, never 0, of the ``GRAM`` bytes at each position."""
    h, have, out, at = _BYTE32[data], 1, None, 0
    size = GRAM
    while True:
        if size & have:
            n = len(data) - GRAM + 1
            part = h[at : at + n]
            out = part if out is None else (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + part
            at += have
        if at == size:
            break
        h = (h[:-have] ^ (h[:-have] >> np.uint32(16))) * np.uint32(0x85EBCA6B) + h[have:] * np.uint32(0xC2B2AE35)
        have *= 2
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x297A2D39)
    return out | np.uint32(1)


def _sampled_piece(data: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Sampled positions; ``valid`` marks where a string of ``LENGTH`` bytes starts."""
    h = _grams(data)
    least = np.where(valid, _sliding(h, SPAN, np.minimum), np.uint32(0))
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint32), least, np.zeros(SPAN - 1, np.uint32)])
    return np.flatnonzero(h == _sliding(padded, SPAN, np.maximum))


def sampled(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """Positions, ascending, such that every string inside a text samples one."""
    out = []
    n = len(data) - LENGTH + 1
    for start in range(0, max(0, n), piece):
        stop = min(n, start + piece)
        valid = np.ones(stop - start, dtype=bool)
        for edge in offsets[np.searchsorted(offsets, start, "right") :]:
            if edge >= stop + LENGTH:
                break
            valid[max(0, edge - LENGTH + 1 - start) : max(0, min(stop, edge) - start)] = False
        out.append(_sampled_piece(data[start : stop + LENGTH - 1], valid) + start)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def _windows_of(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Bytes at ``at`` .. ``at + size`` as rows."""
    return np.lib.stride_tricks.sliding_window_view(data, size)[at]


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows), dtype=U64)
    for j in range(rows.shape[1]):
        total += kernel.BYTE_VALUE[rows[:, j]] * _WEIGHTS[j]
    return kernel.mix(total)


class Levels:
    """A logarithmic family: sorted arrays of suffix fingerprints by size."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def holds(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the (sorted) wanted suffixes a level holds: one merge-scan each."""
        found = np.zeros(len(wanted), dtype=bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, wanted), len(level) - 1)
            found |= level[at] == wanted
        return found

    def add(self, run: np.ndarray) -> None:
        """Makes a sorted run of new suffixes a level, then merges equal sizes."""
        if not len(run):
            return
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            last = self.levels.pop()
            merged = np.concatenate([self.levels[-1], last])
            merged.sort(kind="stable")  # two sorted runs: a merge
            self.levels[-1] = merged


def _windows(contexts: np.ndarray):
    """(fingerprint, inside the text) of the strings of each context, by column."""
    n = len(contexts)
    weights = np.cumprod(np.full(CONTEXT, kernel.BASE, dtype=U64), dtype=U64)
    back = np.cumprod(np.full(CONTEXT, kernel.INVERSE, dtype=U64), dtype=U64)
    sums = np.zeros((n, CONTEXT + 1), dtype=U64)
    np.cumsum(kernel.BYTE_VALUE[contexts] * weights, axis=1, out=sums[:, 1:])
    prints = kernel.mix((sums[:, LENGTH:] - sums[:, :SPAN]) * back[:SPAN])
    outside = np.zeros((n, CONTEXT + 1), dtype=np.int16)
    np.cumsum(contexts == PAD, axis=1, out=outside[:, 1:])
    return prints, outside[:, LENGTH:] == outside[:, :SPAN]


_BITS = np.uint32(1) << np.arange(SPAN, dtype=np.uint32)
ALL = np.uint32(_BITS.sum())


class SuffixFamily:
    """The index of one shard. ``add`` takes batches in ascending order of ids."""

    def __init__(self):
        self.contexts, self.strings = Levels(), Levels()

    def add(self, contexts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Index a batch of distinct contexts, whose first documents have the
        places ``first``; per context a bit for each of its ``SPAN`` strings
        that stands in a document before its first one."""
        out = np.full(len(contexts), ALL, dtype=np.uint32)
        prints = _hash_rows(contexts)
        order = np.argsort(prints)
        known = np.empty(len(prints), dtype=bool)
        known[order] = self.contexts.holds(prints[order])
        new = np.flatnonzero(~known)
        if not len(new):
            return out
        self.contexts.add(np.sort(prints[new]))
        found, inside = _windows(contexts[new])
        row, column = np.nonzero(inside)
        flat, places = found[row, column], first[new][row]
        order = np.lexsort((places, flat))
        s, p = flat[order], places[order]
        head = np.ones(len(s), dtype=bool)
        head[1:] = s[1:] != s[:-1]
        group = np.cumsum(head) - 1
        distinct = s[head]
        indexed = self.strings.holds(distinct)
        repeat = indexed[group] | (p[head][group] < p)
        self.strings.add(distinct[~indexed])
        bits = np.bincount(row[order][repeat], _BITS[column[order][repeat]].astype(float), minlength=len(new))
        out[new] = bits.astype(np.uint32)
        return out


def _batch(docs: pa.Table):
    """(bytes, offsets, sampled positions, key of each, place of its document).

    Places number the batch's documents by ascending id; equal ids share one.
    """
    data, offsets = kernel.text_bytes(docs.column("text"))
    at = sampled(data, offsets)
    keys = _hash_rows(_windows_of(data, at, GRAM)) if len(at) else np.zeros(0, U64)
    _, place = np.unique(docs.column("sort").to_numpy(), return_inverse=True)
    return data, offsets, at, keys, place[np.searchsorted(offsets, at, side="right") - 1]


def _ask_grams(bits: int):
    def ask(key, docs):
        _, _, _, keys, place = _batch(docs)
        order = np.lexsort((place, keys))
        k, p = keys[order], place[order]
        distinct, first = np.unique(k, return_index=True)
        if not len(distinct):
            return X.asked(0, [], [])
        last = np.append(first[1:], len(k)) - 1
        several = p[last] != p[first]
        shards, ends, bodies = X.pack(distinct, bits)
        return X.asked(key[0].as_py(), shards, bodies,
                       [np.packbits(several[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:])])
    return ask


def _share(key, table):
    """One byte per key asked: does more than one document hold it?"""
    keys = [X.unpack(b) for b in table.column("body").to_pylist()]
    several = np.concatenate([
        np.unpackbits(np.frombuffer(e, dtype=np.uint8), count=len(k))
        for k, e in zip(keys, table.column("extra").to_pylist())])
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, 1.0 + several) > 1
    out, at = [], 0
    for k in keys:
        out.append(shared[inverse[at : at + len(k)]].astype(np.uint8).tobytes())
        at += len(k)
    return table.select(["block", "shard"]).append_column("body", pa.array(out, pa.binary()))


def _suffix_array(docs: pa.Table, shared: np.ndarray, bits: int):
    """The batch's sampled, shared suffixes: (bytes, offsets, position and
    context of each occurrence, place of its document, then per distinct
    context, sorted by shard and suffix: shard, bytes, first place)."""
    data, offsets, at, keys, place = _batch(docs)
    distinct = np.unique(keys)
    keep = shared[np.searchsorted(distinct, keys)].astype(bool) if len(keys) else np.zeros(0, bool)
    at, keys, place = at[keep], keys[keep], place[keep]
    # Bytes of other texts are padding: what a context holds is its own text's.
    padded = np.concatenate([np.full(LEFT, PAD, np.uint8), data, np.full(LENGTH, PAD, np.uint8)])
    rows = _windows_of(padded, at, CONTEXT).copy() if len(at) else np.zeros((0, CONTEXT), np.uint8)
    text = np.searchsorted(offsets, at, side="right") - 1
    for edge, ahead in ((offsets[text] - at + LEFT, True), (offsets[text + 1] - at + LEFT, False)):
        cut = np.flatnonzero(edge > 0 if ahead else edge < CONTEXT)
        column = np.arange(CONTEXT)
        outside = column < edge[cut, None] if ahead else column >= edge[cut, None]
        part = rows[cut]
        part[outside] = PAD
        rows[cut] = part
    shard = (keys >> U64(64 - bits)).astype(">u4")
    suffix_first = np.concatenate(
        [shard.view(np.uint8).reshape(-1, 4), rows[:, LEFT:], rows[:, :LEFT]], axis=1)
    as_text = np.ascontiguousarray(suffix_first).view(f"S{4 + CONTEXT}").ravel()
    _, index, context = np.unique(as_text, return_index=True, return_inverse=True)
    first = np.full(len(index), np.iinfo(np.int64).max)
    np.minimum.at(first, context, place)
    return data, offsets, at, context, place, shard[index].astype(np.int64), rows[index], first


def _ask_suffixes(bits: int):
    def ask(key, docs, told):
        if not docs.num_rows:
            return X.asked(0, [], [])
        shared = X.answers_in_order(told, np.uint8)
        *_, shard, rows, first = _suffix_array(docs, shared, bits)
        present, start = np.unique(shard, return_index=True)
        ends = np.append(start, len(shard))
        return X.asked(key[0].as_py(), present,
                       [rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])],
                       [X.planes(first[a:b]) for a, b in zip(ends[:-1], ends[1:])])
    return ask


def _match(key, table):
    """Insert a shard's batches into its family, answering each."""
    family = SuffixFamily()
    blocks = table.column("block").to_pylist()
    bodies, extras = table.column("body"), table.column("extra")
    out: list = [None] * len(blocks)
    for i in sorted(range(len(blocks)), key=blocks.__getitem__):
        contexts = np.frombuffer(bodies[i].as_buffer(), dtype=np.uint8).reshape(-1, CONTEXT)
        out[i] = X.planes(family.add(contexts, X.from_planes(extras[i].as_py())))
    return table.select(["block", "shard"]).append_column("body", pa.array(out, pa.binary()))


def _remove(bits: int, with_spans: bool):
    def remove(docs, told):
        is_gram = pc.equal(told.column("level"), 1)
        shared = X.answers_in_order(told.filter(is_gram), np.uint8)
        data, offsets, at, context, place, shard, _, first = _suffix_array(docs, shared, bits)
        rows = sorted(zip(*(told.filter(pc.invert(is_gram)).column(c).to_pylist() for c in ("shard", "body"))))
        answer = np.concatenate([X.from_planes(b) for _, b in rows] or [np.zeros(0, np.uint32)])
        found = np.where(place > first[context], ALL, answer[context]) if len(at) else answer[:0]
        gone = np.zeros(len(data) + 1, dtype=np.int64)
        text = np.searchsorted(offsets, at, side="right") - 1
        for i in range(SPAN):
            start = at[(found & _BITS[i]) > 0] + i - LEFT
            inside = text[(found & _BITS[i]) > 0]
            start = start[(start >= offsets[inside]) & (start + LENGTH <= offsets[inside + 1])]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + LENGTH, -1)
        gone = np.cumsum(gone)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = before[offsets[1:]] - before[offsets[:-1]]
        n_spans, digests, spans = [], [], []
        for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), n_removed.tolist()):
            kept = data[a:b][~gone[a:b]] if n else data[a:b]
            digests.append(hashlib.sha256(kept.tobytes()).hexdigest())
            runs = []
            if n:
                mine = gone[a:b]
                runs = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]])))
                runs = [{"start": int(x), "stop": int(y)} for x, y in zip(runs[::2], runs[1::2])]
            n_spans.append(len(runs))
            spans.append(runs)
        columns = [docs.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n_removed),
                   pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_spans:
            columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
            names.append("spans")
        return pa.table(columns, names=names)
    return remove


def substring_dedup(docs: DataFrame, spans: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans]) of every row.

    Texts count as UTF-8 bytes, a null text as empty; ``spans`` are the maximal
    removed byte runs [start, stop) and ``kept_sha256`` is the digest of the
    other bytes. Strings are judged on the input. Texts of fewer than 50 bytes
    keep everything. Rows that share an id never remove from each other; a null
    id counts as smaller than all others. An empty table gives an empty table.
    Other columns are not used. Ids are numbers.
    """
    rows = docs.select("doc_id", "text")
    size = X.text_size(rows)
    blocks = max(1, -(-size // X.BLOCK_BYTES))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf")))
    block = F.lit(0)
    if blocks > 1:
        cuts = rows.select(F.percentile_approx(
            F.col("doc_id").cast("double"), [i / blocks for i in range(1, blocks)], 8 * blocks)).first()[0]
        splits = [float("-inf"), *sorted(set(cuts or [])), float("inf")]
        if len(splits) > 2:
            rows = Bucketizer(splits=splits, inputCol="place", outputCol="batch").transform(
                rows.withColumn("place", place))
            block = F.col("batch")
    order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    blocked = X.in_blocks(rows, size, block=block, blocks=blocks, sort=order)
    by_block = blocked.groupBy("block")
    bits = X.shard_bits(size // 16, 1 << 19)
    asked = by_block.applyInArrow(_ask_grams(bits), X.ASKED)
    answer = "block int, shard int, body binary"
    shared = asked.groupBy("shard").applyInArrow(_share, answer)
    asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(_ask_suffixes(bits), X.ASKED)
    matched = asked.groupBy("shard").applyInArrow(_match, answer)
    told = shared.withColumn("level", F.lit(1)).unionAll(matched.withColumn("level", F.lit(2)))
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    fields.append(T.StructField("kept_sha256", T.StringType()))
    if spans:
        run = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
        fields.append(T.StructField("spans", T.ArrayType(run)))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(_remove(bits, spans), T.StructType(fields))
