"""Katz backoff bigram model: counting, smoothing and scoring of whole texts.

Tokens are the words of a text (runs without white space, A-Z lower-cased) and
one end; the history of the first is a start. With Good-Turing discounts d_r
for counts r up to 5 (from the numbers of n-grams that occur r times):

* ``P(w) = d c(w) / N`` for words seen in training; what the discounts free goes
  to the one unknown word;
* ``P(w | h) = d c(h w) / c(h)`` for pairs seen, else ``alpha(h) P(w)``, and
  ``alpha(h) = (1 - sum of P(w | h)) / (1 - sum of P(w))`` over the words seen
  after h, so that the probabilities after every h add up to 1.

Where the discounts free nothing, one count is added to the total instead, so no
token is impossible. A history never seen passes its word to ``P(w)``.

The count tables are partitioned by a hash of the history: a shard holds all
words seen after its histories, as packed arrays, which is what alpha needs.
Blocks of documents send their distinct words and pairs with training counts,
shards merge them and answer with corpus counts, and blocks evaluate
the recursion for every token of their texts. Words meet by 64-bit hashes; the
answer numbers each word within its shard, and pairs are pairs of these numbers,
so no two of them fall together. Counts have 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import exchange as X
from lopside.llm import kernel

U64 = np.uint64
K = 5  # counts up to K are discounted
END, START = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
PLACE_BITS = 24  # of a word's number within its shard; the last number is the start
WORD_BYTES, PLACE_BYTES = 5, 3
_ANSWER = "block int, shard int, level int, body binary, counts array<double>"


def discounts(of_count: np.ndarray) -> np.ndarray:
    """d_0 .. d_K from ``of_count[r]``, the number of n-grams of count r (r <= K + 1).

    The largest cut-off up to K is used at which all discounts lie in (0, 1].
    """
    d = np.ones(K + 1)
    for k in range(K, 0, -1):
        n = of_count[1 : k + 2].astype(float)
        if (n <= 0).any():
            continue
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k] / n[0]
        if common >= 1:
            continue
        found = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
        if (found > 0).all() and (found <= 1).all():
            d[1 : k + 1] = found
            break
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= K, d[np.minimum(counts, K).astype(np.int64)], 1.0)


class Unigrams:
    """P(w) from counts, given ``stats``: [tokens, types, n_1 .. n_6]."""

    def __init__(self, stats: np.ndarray):
        self.tokens, self.types = float(stats[0]), float(stats[1])
        of_count = np.concatenate([[0.0], stats[2 : K + 3]])
        self.d = discounts(of_count)
        freed = float((np.arange(1, K + 1) * of_count[1 : K + 1] * (1 - self.d[1:])).sum())
        self.total = self.tokens if freed > 1e-9 else self.tokens + 1
        self.unknown = (freed if freed > 1e-9 else 1.0) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.d) / self.total, self.unknown)


def tokens_of(column):
    """(tokens, histories, pointers) of a column of texts."""
    words, pointers = kernel.lowered_words(column, kernel.NOT_SPACE)
    n = len(pointers) - 1
    ends = pointers[1:] + np.arange(n)
    total = len(words) + n
    token = np.full(total, END, dtype=U64)
    place = np.ones(total, dtype=bool)
    place[ends] = False
    token[place] = words
    history = np.empty(total, dtype=U64)
    history[1:] = token[:-1]
    starts = np.concatenate([[0], ends[:-1] + 1]) if n else np.zeros(0, int)
    history[starts] = START
    return token, history, np.concatenate([starts, [total]]).astype(np.int64)


def _distinct_pairs(history, token, learn):
    """Distinct (history, token) sorted, the pair of each token, training counts."""
    order = np.lexsort((token, history))
    h, w = history[order], token[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    number = np.cumsum(new) - 1
    of_token = np.empty(len(h), dtype=np.int64)
    of_token[order] = number
    h, w = h[new], w[new]
    return h, w, of_token, np.bincount(of_token, learn, minlength=len(h)).astype(np.int64)


def _block(docs: pa.Table):
    token, history, pointers = tokens_of(docs.column("text"))
    trains = docs.column("learn").to_numpy(zero_copy_only=False).astype(bool)
    return token, history, pointers, np.repeat(trains, np.diff(pointers))


def _stats(counts: np.ndarray, types: bool) -> list[float]:
    small = np.bincount(counts[(counts > 0) & (counts <= K + 1)].astype(np.int64), minlength=K + 2)[1:]
    return [float(counts.sum()), float((counts > 0).sum()), *small.astype(float).tolist()]


def _answers(blocks, shard: int, level: int, bodies, stats) -> pa.Table:
    n = len(bodies)
    return pa.table({
        "block": pa.array([*blocks, -1], pa.int32()), "shard": pa.array([shard] * (n + 1), pa.int32()),
        "level": pa.array([level] * (n + 1), pa.int32()), "body": pa.array([*bodies, b""], pa.binary()),
        "counts": pa.array([None] * n + [stats], pa.list_(pa.float64()))})


def _ask_words(bits: int):
    def ask(key, docs):
        token, _, _, learn = _block(docs)
        words, inverse = np.unique(token, return_inverse=True)
        counts = np.bincount(inverse, learn, minlength=len(words))
        shards, ends, bodies = X.pack(words, bits, 8)
        extras = [X.counts_of(counts[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return X.asked(key[0].as_py(), shards, bodies, extras)
    return ask


def _count_words(key, table):
    """Per block: corpus counts of its words, and their numbers in the shard."""
    keys = [X.unpack(b, 8) for b in table.column("body").to_pylist()]
    counts = [X.read_counts(b, 0, len(k))[0] for b, k in zip(table.column("extra").to_pylist(), keys)]
    known, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    if len(known) >= (1 << PLACE_BITS) - 1:
        raise OverflowError("more words in a shard than its numbers")
    total = np.bincount(inverse, np.concatenate(counts).astype(float))
    out, at = [], 0
    for k in keys:
        mine = inverse[at : at + len(k)]
        out.append(X.narrow(mine, PLACE_BYTES) + X.counts_of(total[mine]))
        at += len(k)
    return _answers(table.column("block").to_pylist(), key[0].as_py(), 1, out, _stats(total, True))


def _told(told: pa.Table, level: int):
    """((shard, body) in shard order, statistics) of one level."""
    mine = told.filter(pc.equal(told.column("level"), level))
    stats = mine.filter(pc.is_valid(mine.column("counts"))).column("counts")
    rows = mine.filter(pc.is_null(mine.column("counts")))
    rows = sorted(zip(rows.column("shard").to_pylist(), rows.column("body").to_pylist()), key=lambda r: r[0])
    return rows, np.array(stats[0].as_py() if len(stats) else [0.0] * (K + 3))


def _word_counts(words: np.ndarray, bits: int, told: pa.Table):
    """(counts, numbers) of the block's words, in their order, and statistics."""
    rows, stats = _told(told, 1)
    sizes = np.bincount((words >> U64(64 - bits)).astype(np.int64), minlength=1 << bits)
    counts, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shard, body in rows:
        n = int(sizes[shard])
        places = X.unpack(body[: PLACE_BYTES * n], PLACE_BYTES).astype(np.int64)
        numbers.append(shard << PLACE_BITS | places)
        counts.append(X.read_counts(body, PLACE_BYTES * n, n)[0].astype(np.int64))
    return np.concatenate(counts), np.concatenate(numbers), Unigrams(stats), stats


def _numbered(token, history, words, numbers, bits: int):
    """Tokens and histories as word numbers."""
    start = int(START >> U64(64 - bits)) << PLACE_BITS | (1 << PLACE_BITS) - 1
    of = lambda w: numbers[np.minimum(np.searchsorted(words, w), len(words) - 1)]
    return of(token), np.where(history == START, start, of(history))


def _ask_pairs(bits: int):
    def ask(key, docs, told):
        if not docs.num_rows:
            return X.asked(0, [], [])
        token, history, _, learn = _block(docs)
        words = np.unique(token)
        counts, numbers, _, stats = _word_counts(words, bits, told)
        token, history = _numbered(token, history, words, numbers, bits)
        h, w, _, seen = _distinct_pairs(history, token, learn)
        hs, first = np.unique(h, return_index=True)
        edge = np.append(first, len(h))
        shards, ends = np.unique(hs >> PLACE_BITS, return_index=True)
        ends = np.append(ends, len(hs))
        cw = counts[np.searchsorted(numbers, w)]
        bodies = []
        for a, b in zip(ends[:-1], ends[1:]):
            i, j = edge[a], edge[b]
            bodies.append(
                stats.astype("<f8").tobytes() + np.array([b - a, j - i], dtype="<i8").tobytes()
                + X.narrow(hs[a:b] & ((1 << PLACE_BITS) - 1), PLACE_BYTES) + X.narrow(w[i:j], WORD_BYTES)
                + X.counts_of(np.diff(edge[a : b + 1])) + X.counts_of(seen[i:j]) + X.counts_of(cw[i:j]))
        return X.asked(key[0].as_py(), shards, bodies)
    return ask


def _count_pairs(key, table):
    """Per block: counts of its pairs, then per history its total, numbers of
    words seen 1 .. K times after it, and the sum of their P(w)."""
    hs, ws, counts, cws, sizes = [], [], [], [], []
    head = 8 * (K + 3)
    for body in table.column("body").to_pylist():
        n, m = (int(v) for v in np.frombuffer(body, dtype="<i8", count=2, offset=head))
        at = head + 16
        h = X.unpack(body[at : at + PLACE_BYTES * n], PLACE_BYTES)
        at += PLACE_BYTES * n
        ws.append(X.unpack(body[at : at + WORD_BYTES * m], WORD_BYTES))
        degree, at = X.read_counts(body, at + WORD_BYTES * m, n)
        seen, at = X.read_counts(body, at, m)
        hs.append(np.repeat(h, degree.astype(np.int64)))
        counts.append(seen)
        cws.append(X.read_counts(body, at, m)[0])
        sizes.append((h, m))
    unigrams = Unigrams(np.frombuffer(body[:head], dtype="<f8"))
    h, w = np.concatenate(hs), np.concatenate(ws)
    order = np.lexsort((w, h))
    sh, sw = h[order], w[order]
    new = np.ones(len(sh), dtype=bool)
    new[1:] = (sh[1:] != sh[:-1]) | (sw[1:] != sw[:-1])
    number = np.cumsum(new) - 1
    of_pair = np.empty(len(h), dtype=np.int64)
    of_pair[order] = number
    total = np.bincount(of_pair, np.concatenate(counts).astype(float))
    cw = np.concatenate(cws)[order][new].astype(float)
    known, group = np.unique(sh[new], return_inverse=True)
    seen = total > 0
    of_history = np.bincount(group, total, minlength=len(known))
    mass = np.bincount(group[seen], unigrams.p(cw[seen]), minlength=len(known))
    few = [np.bincount(group[total == r], minlength=len(known)) for r in range(1, K + 1)]
    out, at = [], 0
    for mine, m in sizes:
        g = np.searchsorted(known, mine)
        out.append(np.array([m, len(mine)], dtype="<i8").tobytes() + X.counts_of(total[of_pair[at : at + m]])
                   + X.counts_of(of_history[g]) + b"".join(X.counts_of(f[g]) for f in few)
                   + mass[g].astype("<f8").tobytes())
        at += m
    return _answers(table.column("block").to_pylist(), key[0].as_py(), 2, out, _stats(total, False))


def _pair_answers(rows):
    parts = [[] for _ in range(K + 3)]
    for _, body in rows:
        m, n = (int(v) for v in np.frombuffer(body, dtype="<i8", count=2))
        at = 16
        for i, size in enumerate([m] + [n] * (K + 1)):
            found, at = X.read_counts(body, at, size)
            parts[i].append(found.astype(float))
        parts[-1].append(np.frombuffer(body, dtype="<f8", offset=at))
    return [np.concatenate(p or [np.zeros(0)]) for p in parts]


def _score(docs, told, bits: int):
    token, history, pointers, learn = _block(docs)
    words, inverse = np.unique(token, return_inverse=True)
    counts, numbers, unigrams, _ = _word_counts(words, bits, told)
    h, _, of_token, _ = _distinct_pairs(*_numbered(token, history, words, numbers, bits)[::-1], learn)
    rows, stats = _told(told, 2)
    pair_count, of_history, *few, mass = _pair_answers(rows)
    d = discounts(np.concatenate([[0.0], stats[2 : K + 3]]))
    freed = sum((r * few[r - 1] * (1 - d[r]) for r in range(1, K + 1)), np.zeros(len(mass)))
    total = np.where(freed > 1e-9, of_history, of_history + 1)
    alpha = np.where(of_history > 0, np.where(freed > 1e-9, freed, 1.0) / total / (1 - mass), 1.0)
    _, group = np.unique(h, return_inverse=True)
    p = np.where(pair_count[of_token] > 0,
                 discounted(pair_count, d)[of_token] / total[group[of_token]],
                 alpha[group[of_token]] * unigrams.p(counts)[inverse])
    c = counts[inverse]
    base = np.log10((c + 0.1) / (unigrams.tokens + 0.1 * (unigrams.types + 1)))

    def per_text(x):
        return np.add.reduceat(x, pointers[:-1]) if len(pointers) > 1 else x[:0]

    n = docs.num_rows
    return pa.table([
        docs.column("doc_id"), pc.invert(docs.column("learn")), pa.array(np.diff(pointers)),
        pa.array(per_text((c > 0).astype(np.int64))), pa.array(np.full(n, int(unigrams.tokens))),
        pa.array(per_text(base)), pa.array(per_text(np.log10(p)))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _with_totals(answered: DataFrame, blocks: int) -> DataFrame:
    """Answers to blocks, and for every block one row of corpus statistics."""
    stats = answered.where("block < 0").agg(
        F.first("level").alias("level"),
        F.array(*[F.sum(F.col("counts")[i]) for i in range(K + 3)]).alias("counts"))
    every = stats.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(-1).alias("shard"),
        "level", F.lit(b"").alias("body"), "counts")
    return answered.where("block >= 0").unionAll(every)


def katz_scores(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row of ``docs``; the model learns from the rows where ``learn`` holds.

    ``base_score`` is the sum of ``log10((c + 0.1) / (N + 0.1 (V + 1)))`` over the
    tokens, ``score`` the model's log10 probability of the text. A null or empty
    text is one end. Repeated rows count as often as they occur and score alike;
    without training rows every token is the unknown word; an empty table gives
    an empty table. A null ``learn`` counts as false. Other columns are not used.
    """
    rows = docs.select("doc_id", "text")
    size = X.text_size(rows)
    # Half as large again as other operators' blocks: a pair is sent once per block.
    blocks = max(1, -(-2 * size // (3 * X.BLOCK_BYTES)))
    blocked = X.in_blocks(rows, size, blocks=blocks, learn=F.coalesce(learn, F.lit(False)))
    by_block = blocked.groupBy("block")
    bits = min(X.shard_bits(size // 6), 8 * WORD_BYTES - PLACE_BITS)
    asked = by_block.applyInArrow(_ask_words(bits), X.ASKED)
    words = _with_totals(asked.groupBy("shard").applyInArrow(_count_words, _ANSWER), blocks)
    asked = by_block.cogroup(words.groupBy("block")).applyInArrow(_ask_pairs(bits), X.ASKED)
    pairs = _with_totals(asked.groupBy("shard").applyInArrow(_count_pairs, _ANSWER), blocks)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()),
        T.StructField("score", T.DoubleType())])
    return by_block.cogroup(words.unionAll(pairs).groupBy("block")).applyInArrow(
        lambda docs, told: _score(docs, told, bits), schema)
