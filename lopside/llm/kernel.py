"""Vectorised text kernels for tasks: one Arrow batch of texts at a time.

Texts are handled as one UTF-8 byte array with document offsets, so nothing
here loops over words. Hashes are 64 bits: a span is cut into pieces of PIECE
bytes, a piece's polynomial over random byte values modulo 2**64 is mixed with
its place, and the mixed pieces are added up. (One polynomial over a long span
would let two-letter patterns of 2**10 bytes meet, whatever its base.)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
PIECE = 32
SEGMENT = 1 << 20  # bytes hashed at a time; bounds the scratch arrays

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` in lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_random = np.random.Generator(np.random.PCG64(20240501))
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
OTHER_VALUE = np.random.Generator(np.random.PCG64(20240502)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULTIPLIERS = _random.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
_PLACE, _LENGTH = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)
BASE = int(_random.integers(2**62, 2**63)) | 5
INVERSE = pow(BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER = _powers(BASE, SEGMENT + 1)
_INVERSE = _powers(INVERSE, SEGMENT + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, n + 1 offsets); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(low: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """(starts, ends, pointers): words never cross texts; text i has the words
    ``pointers[i]`` to ``pointers[i + 1]``."""
    n = len(low)
    edge = np.zeros(n + 1, dtype=bool)
    inside = table[low]
    edge[0] = edge[n] = True
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    words = inside[at[:-1]] if n else np.zeros(0, bool)
    starts, ends = at[:-1][words], at[1:][words]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each span (spans ascending and disjoint); other ``values``
    give an independent one."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        size = int(ends[j - 1] - base)
        power, inverse = _POWER, _INVERSE
        if size > SEGMENT:
            power, inverse = _powers(BASE, size + 1), _powers(INVERSE, size + 1)
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(values[low[base : base + size]] * power[:size], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        length = (e - s).astype(np.uint64)
        pieces = np.maximum(1, (e - s + PIECE - 1) // PIECE)
        if pieces.max() == 1:
            total = mix((sums[e] - sums[s]) * inverse[s] + _PLACE)
        else:
            first = np.cumsum(pieces) - pieces
            owner = np.repeat(np.arange(len(s)), pieces)
            place = np.arange(len(owner)) - first[owner]
            a = s[owner] + PIECE * place
            z = np.minimum(a + PIECE, e[owner])
            part = mix((sums[z] - sums[a]) * inverse[a] + _PLACE * (place + 1).astype(np.uint64))
            total = np.add.reduceat(part, first)
        out[i:j] = mix(total + length * _LENGTH)
        i = j
    return out


def lowered_words(column, table: np.ndarray):
    """(word hashes, pointers) of a column of texts with A-Z lower-cased."""
    data, offsets = text_bytes(column)
    low = LOWER[data]
    starts, ends, pointers = word_spans(low, offsets, table)
    return span_hashes(low, starts, ends), pointers


def sequence_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned hash columns."""
    total = np.full(len(parts[0]), len(parts), dtype=np.uint64) * MULTIPLIERS[-1]
    for part, multiplier in zip(parts, MULTIPLIERS):
        total = total + part * multiplier
    return mix(total)


def chunks(batch, column: str, limit: int = 4 << 20):
    """Slices of an Arrow batch of at most about ``limit`` text bytes each."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j
