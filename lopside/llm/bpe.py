"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is cut by the tokenizer's pattern. For a piece of n bytes the leaves of
a segment tree hold, per byte position, the rank of the pair that starts
there (or infinity); every inner node holds the leftmost minimum of its
children. The root names the next merge; a merge kills one live position and
changes the pair ranks at the merged position and its left neighbour, which
are point updates of logarithmic cost. A piece of n bytes so costs
O(n log n), also where a text is one run of letters.

Pieces of up to ``BATCHED`` bytes that a task has not seen lately are encoded
many at a time: their trees are the rows of one matrix. Longer ones take the
scalar tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lopside.llm.kernel import chunks

INFINITE = np.int32(2**31 - 1)
BATCHED = 64
CACHED_PIECES = 250_000  # encodings a task keeps; more are computed again


class Ranks:
    """A rank file: token bytes by id, ids by bytes, and which id pairs merge."""

    def __init__(self, lines: bytes):
        self.ids = {}
        for line in lines.splitlines():
            if line:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.token = {i: t for t, i in self.ids.items()}
        self.single = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.single < 0).any():
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.width = max(self.token) + 1
        pairs = {
            self.ids[t[:i]] * self.width + self.ids[t[i:]]: rank
            for t, rank in self.ids.items() for i in range(1, len(t))
            if t[:i] in self.ids and t[i:] in self.ids
        }
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int32)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, infinite where they do not merge."""
        key = left * np.int64(self.width) + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.pair_ranks[at], INFINITE)


@functools.lru_cache(maxsize=2)
def _ranks(lines: bytes) -> Ranks:
    return Ranks(lines)


def encode_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One piece by one segment tree."""
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    infinite = int(INFINITE)
    ids = [int(ranks.single[b]) for b in piece]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    width, pairs = ranks.width, ranks.pairs
    tree = [infinite] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = pairs.get(ids[i] * width + ids[i + 1], infinite)
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left <= right else right

    def put(leaf: int, value: int) -> None:
        at = leaf + size
        tree[at] = value
        while at > 1:
            at >>= 1
            left, right = tree[2 * at], tree[2 * at + 1]
            best = left if left <= right else right
            if tree[at] == best:
                return
            tree[at] = best

    while tree[1] < infinite:
        at = 1
        while at < size:
            at *= 2
            if tree[at] > tree[at + 1]:
                at += 1
        i = at - size
        ids[i] = tree[1]
        gone = after[i]
        after[i] = after[gone] if gone < n else n
        put(gone, infinite)
        ids[gone] = -1
        if after[i] < n:
            before[after[i]] = i
            put(i, pairs.get(ids[i] * width + ids[after[i]], infinite))
        else:
            put(i, infinite)
        if before[i] >= 0:
            j = before[i]
            put(j, pairs.get(ids[j] * width + ids[i], infinite))
    return [x for x in ids if x >= 0]


def encode_batch(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """Many short pieces by one matrix of segment trees each of one width."""
    out: list = [None] * len(pieces)
    by_size: dict[int, list[int]] = {}
    for at, piece in enumerate(pieces):
        by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(at)
    for size, members in by_size.items():
        for start in range(0, len(members), 4096):
            some = members[start : start + 4096]
            for at, ids in zip(some, _encode_rows([pieces[i] for i in some], size, ranks)):
                out[at] = ids
    return out


def _encode_rows(pieces: list[bytes], size: int, ranks: Ranks) -> list[list[int]]:
    rows = len(pieces)
    lengths = np.array([len(p) for p in pieces])
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8)
    position = np.arange(size, dtype=np.int32)
    ids = np.where(position < lengths[:, None], ranks.single[raw.reshape(rows, size)], np.int32(-1))
    after = np.tile(position + 1, (rows, 1))
    before = np.tile(position - 1, (rows, 1))
    tree = np.full((rows, 2 * size), INFINITE)
    tree[:, size : 2 * size - 1] = ranks.rank_of(ids[:, :-1], ids[:, 1:])
    level = size
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half

    def put(r: np.ndarray, leaf: np.ndarray, value) -> None:
        at = leaf + size
        tree[r, at] = value
        while at[0] > 1:
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def pair(r: np.ndarray, i: np.ndarray) -> np.ndarray:
        nxt = after[r, i]
        right = np.where(nxt < lengths[r], ids[r, np.minimum(nxt, size - 1)], -1)
        return ranks.rank_of(ids[r, i], right)

    live = np.flatnonzero(tree[:, 1] < INFINITE)
    while len(live):
        at = np.ones(len(live), dtype=np.int64)
        while at[0] < size:
            at = 2 * at
            at += tree[live, at] > tree[live, at + 1]
        i = at - size
        ids[live, i] = tree[live, 1]
        gone = after[live, i]
        nxt = after[live, gone]
        after[live, i] = nxt
        ids[live, gone] = -1
        put(live, gone, INFINITE)
        linked = nxt < size
        before[live[linked], nxt[linked]] = i[linked]
        put(live, i, pair(live, i))
        prior = before[live, i]
        some = prior >= 0
        if some.any():
            put(live[some], prior[some], pair(live[some], prior[some]))
        live = live[tree[live, 1] < INFINITE]
    keep = ids >= 0
    ends = np.cumsum(keep.sum(axis=1)).tolist()
    flat = ids[keep].tolist()
    return [flat[i:j] for i, j in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts, keeping the encodings of recent pieces."""

    def __init__(self, lines: bytes, pattern: str):
        self.ranks = _ranks(lines)
        self.pattern = regex.compile(pattern)
        self.text_of = [str(i) for i in range(self.ranks.width)]
        self.seen: dict[str, str] = {}

    def texts(self, texts: list[str]):
        """(number of ids, ids as decimal text) of each text."""
        cut = [self.pattern.findall(t) for t in texts]
        wanted = set()
        for pieces in cut:
            wanted.update(pieces)
        if len(self.seen) + len(wanted) > CACHED_PIECES:
            self.seen = {}
        seen = self.seen
        self.learn([p for p in wanted if p not in seen])
        for pieces in cut:
            joined = " ".join([seen[p] for p in pieces])
            yield joined.count(" ") + 1 if joined else 0, joined

    def learn(self, pieces: list[str]) -> None:
        short, names = [], []
        ids_of, text_of, seen = self.ranks.ids, self.text_of, self.seen
        for piece in pieces:
            raw = piece.encode("utf-8")
            whole = ids_of.get(raw)
            if whole is not None:
                seen[piece] = text_of[whole]
            elif len(raw) > BATCHED:
                seen[piece] = " ".join([text_of[i] for i in encode_long(raw, self.ranks)])
            else:
                short.append(raw)
                names.append(piece)
        for name, ids in zip(names, encode_batch(short, self.ranks)):
            seen[name] = " ".join([text_of[i] for i in ids])


def decode(ids: str, ranks: Ranks) -> bytes:
    """Bytes of ids written as decimal text."""
    token = ranks.token
    return b"".join([token[int(i)] for i in ids.split()])


def bpe_encode(
    docs: DataFrame, rank_file: bytes, pattern: str, text: str = "text", ids: bool = True
) -> DataFrame:
    """Every column of ``docs`` but the text, plus the encoding of each text.

    ``rank_file`` is the content of a tiktoken rank file (a fixed vocabulary of
    a few hundred kilobytes, sent to the tasks). New columns: ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by a space), ``decoded_sha256``
    (of the bytes the ids decode to) and, unless ``ids`` is false, ``ids``, the
    decimal ids joined by a space. Columns of those names in the input are
    replaced. A null or empty text has no ids; repeated rows are encoded each;
    an empty table gives an empty table. Special tokens are ordinary text.
    """
    from pyspark.sql import types as T

    new = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    new += [("ids", T.StringType())] * ids
    taken = {name for name, _ in new}
    carried = [f for f in docs.schema.fields if f.name != text and f.name not in taken]
    schema = T.StructType(carried + [T.StructField(n, t) for n, t in new])
    shared = docs.sparkSession.sparkContext.broadcast(rank_file)
    names = [f.name for f in carried]

    def encode(batches):
        encoder = Encoder(shared.value, pattern)
        for whole in batches:
            for batch in chunks(whole, text, 1 << 20):
                columns = [[], [], [], []]
                texts = [t or "" for t in batch.column(text).to_pylist()]
                for n, joined in encoder.texts(texts):
                    columns[0].append(n)
                    columns[1].append(hashlib.sha256(joined.encode()).hexdigest())
                    columns[2].append(hashlib.sha256(decode(joined, encoder.ranks)).hexdigest())
                    if ids:
                        columns[3].append(joined)
                arrays = [batch.column(n) for n in names]
                arrays += [pa.array(c, pa.int64() if i == 0 else pa.string())
                           for i, c in enumerate(columns[: len(new)])]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in new])

    return docs.select(*names, text).mapInArrow(encode, schema)
