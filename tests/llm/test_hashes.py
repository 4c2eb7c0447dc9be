"""Hashes and counts on inputs made to break weak ones."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lopside.llm import exchange, jaccard, katz, kernel, lines


def parity_words(letters="ab", n=1024):
    """Two different words on which one polynomial modulo 2**64 agrees, whatever its base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join(letters[b ^ flip] for b in bits) for flip in (0, 1)]


def hashes(texts, values=kernel.BYTE_VALUE):
    data, offsets = kernel.text_bytes(pa.array(texts))
    return kernel.span_hashes(data, offsets[:-1], offsets[1:], values).tolist()


def test_long_parity_words_differ():
    for letters in ("ab", "xy", "é中"):
        for n in (32, 64, 1024, 4096):
            one, two = parity_words(letters, n)
            assert len(set(hashes([one, two]))) == 2
            assert len(set(hashes([one, two], kernel.OTHER_VALUE))) == 2


def test_hash_depends_on_the_span_alone():
    word = "q" * 31 + "w" * 40 + "e"
    texts = ["x" * n + word for n in (0, 1, 31, 32, 33)]
    data, offsets = kernel.text_bytes(pa.array(texts))
    got = kernel.span_hashes(data, offsets[1:] - len(word), offsets[1:])
    assert len(set(got.tolist())) == 1
    pieces = ["a" * 32 + "b" * 32, "b" * 32 + "a" * 32, "a" * 32, "a" * 33, "a" * 64, "b" * 64, "a"]
    assert len(set(hashes(pieces))) == len(pieces)
    assert not set(hashes(pieces)) & set(hashes(pieces, kernel.OTHER_VALUE))


def test_different_long_lines_stay(spark):
    one, two = parity_words()
    rows = [(1, "\n".join([one, "same", "lines"])), (2, "\n".join([two, "same", "lines"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.n_removed for r in lines.line_dedup(docs).collect()} == {1: 0, 2: 0}


def test_different_long_words_are_not_linked(spark):
    one, two = parity_words()
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_long_word_never_seen_is_unknown(spark):
    one, two = parity_words()
    docs = spark.createDataFrame([(1, one + " and"), (2, two + " and")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_known for r in katz.katz_scores(docs, F.col("doc_id") == 1).collect()}
    assert got == {1: 3, 2: 2}


def test_counts_beyond_32_bits():
    for values in ([], [0], [1, 255, 256], [5_000_000_000, 3], [2**63 - 1, 0, 2**40]):
        body = b"ab" + exchange.counts_of(np.array(values, dtype=np.int64)) + b"rest"
        found, end = exchange.read_counts(body, 2, len(values))
        assert found.tolist() == values and body[end:] == b"rest"
    words = pa.array(["w"])
    data, offsets = kernel.text_bytes(words)
    key = np.sort(kernel.span_hashes(data, offsets[:-1], offsets[1:]))
    _, _, bodies = exchange.pack(key, 4, 8)
    asked = exchange.asked(0, [int(key[0] >> np.uint64(60))], bodies, [exchange.counts_of([5_000_000_000])])
    told = katz._count_words((pa.scalar(int(key[0] >> np.uint64(60))),), asked)
    counts, numbers, unigrams, _ = katz._word_counts(key, 4, told)
    assert counts.tolist() == [5_000_000_000] and unigrams.tokens == 5_000_000_000
