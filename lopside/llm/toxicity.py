"""Toxic documents and the sentences that make them so, by noisy-or.

A document is a bag of sentences. Sentence s has the score
``p_s = sigmoid(bias + sum of the weights of its distinct features)``, where a
feature is a word or the first 4, 5 or 6 bytes of a longer one (insults are
inflected), and a document is toxic with ``1 - (1 - leak) * prod(1 - p_s)``. Only documents carry
labels; the weights are fitted to them through the product, so blame falls on
the sentences whose words set toxic documents apart. ``leak`` takes up labels
that no word explains; it is no part of a score.

The fit uses a bounded sample of labelled rows (``sample_rows`` per class, of
at most ``sample_bytes`` bytes each, first in hash order): numbers the model
needs stay the same size whatever the table. Scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import kernel

SAMPLE_ROWS = 2_000
SAMPLE_BYTES = 20_000
MIN_DOCS = 4  # sampled documents that must hold a feature before it gets a weight
MIN_LIFT = 2.0  # standard errors by which its toxic share must pass the sample's
MIN_WEIGHT = 0.5  # smaller weights are dropped half way through the fit
PREFIXES = (4, 5, 6)

_END = np.zeros(256, dtype=bool)
_END[[0x0A, 0x0D, 0x21, 0x2E, 0x3F]] = True  # newline, ! . ?


@dataclass(frozen=True)
class ToxicityModel:
    """Word hashes (ascending), their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def sentence_words(column):
    """(feature hashes, sentence of each feature, sentence pointers of each
    text, word starts, word ends, first word of each sentence).

    A sentence ends at ``. ! ?`` or a line end; its words are runs of letters
    and digits with A-Z lower-cased.
    """
    data, offsets = kernel.text_bytes(column)
    low = kernel.LOWER[data]
    starts, ends, pointers = kernel.word_spans(low, offsets, kernel.ALNUM)
    hashes = kernel.span_hashes(low, starts, ends)
    breaks = np.flatnonzero(_END[low])
    before = np.searchsorted(breaks, starts)
    new = np.zeros(len(starts), dtype=bool)
    new[1:] = before[1:] != before[:-1]
    new[pointers[:-1][pointers[:-1] < len(starts)]] = True
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    features, where = [hashes], [sentence]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        head = kernel.span_hashes(low, starts[longer], starts[longer] + size)
        features.append(kernel.mix(head + kernel.MULTIPLIERS[size]))
        where.append(sentence[longer])
    return (np.concatenate(features), np.concatenate(where),
            np.searchsorted(first, pointers), starts, ends, first)


def _distinct_in_sentence(hashes, sentence):
    """Sorted distinct (sentence, word) pairs."""
    order = np.lexsort((hashes, sentence))
    h, s = hashes[order], sentence[order]
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    return h[keep], s[keep]


def fit_noisy_or(
    texts, labels: np.ndarray, weights: np.ndarray | None = None, steps: int = 150,
    rate: float = 0.15, penalty: float = 3e-4,
) -> ToxicityModel:
    """Fit by full-batch Adam on the bag likelihood; no randomness.

    ``weights`` says how many rows each sampled row stands for.
    """
    # A few texts at a time: only distinct (sentence, feature) pairs are kept.
    hashes, sentence, pointers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [0]
    for start in range(0, len(labels), 250):
        h, s, p, *_ = sentence_words(texts.slice(start, 250))
        h, s = _distinct_in_sentence(h, s)
        hashes.append(h)
        sentence.append((s + pointers[-1]).astype(np.int32))
        pointers += (p[1:] + pointers[-1]).tolist()
    hashes, sentence, pointers = np.concatenate(hashes), np.concatenate(sentence), np.array(pointers)
    n_docs, n_sentences = len(labels), int(pointers[-1])
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -8.0, 0.05)
    if n_docs == 0 or n_sentences == 0 or labels.min() == labels.max():
        return empty
    doc = np.repeat(np.arange(n_docs), np.diff(pointers))
    vocabulary, word = np.unique(hashes, return_inverse=True)
    word = word.astype(np.int32)
    del hashes
    pair = np.unique(word.astype(np.int64) * n_docs + doc[sentence])
    holds = np.bincount(pair // n_docs, minlength=len(vocabulary))
    toxic = np.bincount(pair // n_docs, labels[pair % n_docs], minlength=len(vocabulary))
    share = labels.mean()
    lift = (toxic - holds * share) / np.sqrt(holds * share * (1 - share))
    useful = (holds >= MIN_DOCS) & (lift >= MIN_LIFT)
    number = np.cumsum(useful) - 1
    keep = useful[word]
    word, sentence, vocabulary = number[word[keep]], sentence[keep], vocabulary[useful]
    size = len(vocabulary)
    theta = np.zeros(size + 2)  # weights, bias, logit of the leak
    theta[size], theta[size + 1] = -5.0, -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    y = labels.astype(np.float64)
    share_of = np.full(n_docs, 1.0 / n_docs) if weights is None else weights / weights.sum()
    for step in range(1, steps + 1):
        z = theta[size] + np.bincount(sentence, theta[word], minlength=n_sentences)
        z = np.clip(z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        leak = 1 / (1 + np.exp(-theta[size + 1]))
        clean = np.log1p(-leak) + np.bincount(doc, -np.logaddexp(0, z), minlength=n_docs)
        clean = np.minimum(clean, -1e-9)
        odds = np.exp(clean) / -np.expm1(clean)
        # d(loss)/d(log probability of being clean)
        g = np.where(y > 0, odds, -1.0) * share_of
        slope = -(g[doc] * p)
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(word, slope[sentence], minlength=size)
        grad[:size] += penalty * np.sign(theta[:size])
        if step == steps // 2:
            active = theta[:size] >= MIN_WEIGHT
        if step >= steps // 2:
            grad[:size] *= active
            theta[:size] *= active
        grad[size] = slope.sum()
        grad[size + 1] = -(g * leak).sum()
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    used = theta[:size] != 0
    return ToxicityModel(vocabulary[used], theta[:size][used], float(theta[size]),
                         float(1 / (1 + np.exp(-theta[size + 1]))))


def sentence_scores(column, model: ToxicityModel):
    """(log(1 - p) of each sentence, sentence pointers, starts, ends, first words)."""
    hashes, sentence, pointers, starts, ends, first = sentence_words(column)
    n = int(pointers[-1])
    z = np.full(n, model.bias)
    if len(model.words) and len(hashes):
        at = np.minimum(np.searchsorted(model.words, hashes), len(model.words) - 1)
        known = model.words[at] == hashes
        h, s = _distinct_in_sentence(hashes[known], sentence[known])
        z += np.bincount(s, model.weights[np.searchsorted(model.words, h)], minlength=n)
    return -np.logaddexp(0, np.clip(z, -30, 30)), pointers, starts, ends, first


def train_toxicity(
    docs: DataFrame, labels: DataFrame, learn=None, sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows.

    ``learn`` is a condition on ``doc_id`` that training rows meet. Rows with a
    null label, and labels without a document, are left out; a document
    labelled several times counts once per distinct label. Rows that repeat id
    and text stand in the sample once, several texts of one id are sampled each.
    With one class or no rows the model scores every text near 0.
    """
    known = labels.where(F.col("toxic").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col("tag")]
    sized = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).where(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes
    )
    # Labels first: the hash order needs no text, so the sort carries ids only.
    short = sized.join(known, "doc_id").select("doc_id", "tag", "toxic")
    each = short.distinct()
    picked = [each.where(F.col("toxic") == c).orderBy(*order).limit(sample_rows) for c in (0, 1)]
    rows = sized.join(picked[0].unionAll(picked[1]), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag", "toxic"])
    table = rows.select("text", "toxic").toArrow()
    y = table.column("toxic").to_numpy().astype(np.int64)
    n = {r["toxic"]: r["count"] for r in short.groupBy("toxic").count().collect()}
    stands_for = np.array([n.get(c, 0) / max(1, int((y == c).sum())) for c in (0, 1)])
    return fit_noisy_or(table.column("text"), y, stands_for[y] if len(y) else None)


def _as_column(model: ToxicityModel, spark):
    return spark.sparkContext.broadcast(model)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text",
                   output: str = "score") -> DataFrame:
    """Every column of ``docs`` plus ``output``, the noisy-or of its sentences.

    A null or empty text, or one without words, scores 0. Rows are scored one
    by one, so repeated rows score alike. A column called ``output`` is
    replaced.
    """
    shared = _as_column(model, docs.sparkSession)
    carried = docs.drop(output)
    names = carried.columns
    schema = T.StructType(carried.schema.fields + [T.StructField(output, T.DoubleType())])

    def score(batches):
        for whole in batches:
            for batch in kernel.chunks(whole, text):
                clean, pointers, *_ = sentence_scores(batch.column(text), shared.value)
                total = np.concatenate([[0.0], np.cumsum(clean)])
                p = -np.expm1(total[pointers[1:]] - total[pointers[:-1]])
                p = np.where(np.diff(pointers) > 0, np.clip(p, 0.0, 1.0), 0.0)
                arrays = [batch.column(n) for n in names] + [pa.array(p)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, output])

    return carried.mapInArrow(score, schema)


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """(doc_id, sentence number, sentence, p) of every sentence at or above
    ``threshold``; a text without words has none."""
    shared = _as_column(model, docs.sparkSession)

    def locate(batches):
        for whole in batches:
            for batch in kernel.chunks(whole, "text"):
                clean, pointers, starts, ends, first = sentence_scores(batch.column("text"), shared.value)
                p = -np.expm1(clean)
                hit = np.flatnonzero(p >= threshold)
                data, _ = kernel.text_bytes(batch.column("text"))
                doc = np.searchsorted(pointers, hit, side="right") - 1
                last = np.append(first, len(starts))[hit + 1] - 1
                texts = [data[starts[a]:ends[b]].tobytes().decode("utf-8", "replace")
                         for a, b in zip(first[hit], last)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(doc)), pa.array(hit - pointers[doc]),
                    pa.array(texts, pa.string()), pa.array(p[hit])],
                    names=["doc_id", "sentence", "text", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        locate, f"doc_id {kind}, sentence bigint, text string, p double")
