"""Mixing, whitening and token alignment against brute force, on odd inputs."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lopside.llm import align, mixing, queries, whiten

A_JSON, B_MODEL = queries.rank_file(queries.A_FILE), queries.rank_file(queries.B_FILE)


def fair(sizes, weights=(5, 2, 1), share=Fraction(3, 2), cap=2):
    """Targets by rounds of resharing, exactly."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = {}, set(order)
    while free:
        left = share * sum(sizes.values()) - sum(target.values())
        given = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if given[s] > cap * sizes[s]]
        if not over:
            return target | given
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            free.remove(s)
    return target


def mixture():
    rnd = random.Random(3)
    names = ["b", "a", None, "é", "z", "", "empty"]
    rows = []
    for i in range(3000):
        source = "b" if rnd.random() < 0.4 else rnd.choice(names)
        text = "" if source == "empty" else " ".join(["w\tx"] * rnd.randrange(0, 40))
        rows.append((i, source, rnd.choice([None, text, text, text]), i % 3))
    rows += [(5, "a", "same row here", 1)] * 3 + [(None, "a", "no id", 1)] * 2
    rows += [(9001, "z", "long " * 30_000, 1)]
    return rows


MIX = "doc_id bigint, source string, text string, target int"


def test_mix_meets_targets(spark):
    rows = mixture()
    drawn = mixing.draw_copies(spark.createDataFrame(rows, MIX).repartition(7)).collect()
    sizes = defaultdict(int)
    for _, source, text, _ in rows:
        sizes[source] += len((text or "").split())
    want, taken, largest = fair(sizes), defaultdict(int), defaultdict(int)
    assert len(drawn) == len(rows)
    assert sum(want.values()) == Fraction(3, 2) * sum(sizes.values())
    for r in drawn:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.source_size == sizes[r.source] and abs(r.target - float(want[r.source])) < 1e-6
        assert r.size == len((r.doc.text or "").split())
        assert int(rate) <= r.copies <= -int(-rate // 1)
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for source in want:
        assert abs(taken[source] - want[source]) <= 2 * largest[source]


def test_mix_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(mixture(), MIX)
    runs = [
        Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.draw_copies(docs.repartition(n)).collect())
        for n in (1, 5)]
    assert runs[0] == runs[1]
    other = Counter((r.doc_id, r.source, r.size, r.copies) for r in mixing.draw_copies(docs, seed=1).collect())
    assert other != runs[0]


def test_mix_over_many_parts(spark, monkeypatch):
    docs = spark.createDataFrame(mixture(), MIX)
    whole = Counter((r.doc_id, r.size, r.copies) for r in mixing.draw_copies(docs).collect())
    monkeypatch.setattr(mixing, "PART_ROWS", 50)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert Counter((r.doc_id, r.size, r.copies) for r in mixing.draw_copies(docs).collect()) == whole


def test_mix_emits_copies_with_all_columns(spark):
    docs = spark.createDataFrame(mixture(), MIX)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = mixing.draw_copies(docs).agg(F.sum("copies")).first()[0]
    assert mixed.count() == copies
    assert mixing.mix(docs.limit(0)).count() == 0


def spectrum(n, values, seed=0):
    """Rows whose covariance has about these eigenvalues."""
    rnd = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rnd.standard_normal((len(values), len(values))))
    return (rnd.standard_normal((n, len(values))) * np.sqrt(values)) @ turn.T


def as_table(spark, x, partitions=5):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(partitions)


def fit(spark, x, k=8):
    data = np.floor(1024 * x).astype(np.int64) + 100_000
    rows = spark.createDataFrame(
        [(i, [int(v) for v in row]) for i, row in enumerate(data)], "vec_id bigint, x array<bigint>").repartition(3)
    return data, rows, whiten.fit_whitening(rows, k)


@pytest.mark.parametrize("values", [
    [40, 30, 20, 10, 5, 4, 3, 2] + [1.0] * 40,
    list(1 + 0.05 * np.arange(48)[::-1]),
    [100.0] * 2 + [1e-3] * 30,
])
def test_components_equal_a_full_decomposition(spark, values):
    data, rows, fitted = fit(spark, spectrum(900, np.array(values)))
    centred = data - data.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(data))
    e, v = e[::-1], v[:, ::-1]
    assert fitted.residual <= whiten.ACCEPTED and fitted.passes > 2
    assert fitted.sums == [int(s) for s in data.sum(axis=0)]
    np.testing.assert_allclose(fitted.values, e[:8], rtol=1e-10)
    np.testing.assert_allclose(np.abs(np.sum(fitted.vectors * v[:, :8], axis=0)), 1, atol=1e-9)
    np.testing.assert_allclose(fitted.trace, e.sum(), rtol=1e-12)
    white = whiten.whiten(rows, fitted)
    assert whiten.identity_error(white, fitted.n) < 1e-9


def test_whitening_with_few_dimensions_rows_or_none(spark):
    data, _, fitted = fit(spark, spectrum(200, np.array([5.0, 2.0, 1.0])))
    assert fitted.vectors.shape == (3, 3)
    _, rows, fitted = fit(spark, np.ones((20, 6)))  # equal rows: no component
    assert fitted.vectors.shape == (6, 0)
    assert whiten.whiten(rows, fitted).where(F.size("whitened") > 0).count() == 0
    flat = np.zeros((30, 5))
    flat[:, 2] = np.arange(30)
    assert fit(spark, flat)[2].vectors.shape == (5, 1)
    assert whiten.fit_whitening(rows.limit(0), 8) is None
    mixed = spark.createDataFrame([(1, [1, 2]), (2, [1])], "vec_id bigint, x array<bigint>")
    with pytest.raises(Exception, match="different lengths"):
        whiten.fit_whitening(mixed, 8)


def test_whitening_query_on_odd_vectors(spark, tmp_path):
    x = spectrum(300, np.array([9.0, 7, 5, 4, 3, 2.5, 2, 1.7, 1.4, 1.2, 1, 0.8]))
    rows = [(i, [float(v) for v in row], "n") for i, row in enumerate(x)]
    rows += [rows[0], (None, rows[1][1], None), (900, None, "n"), (901, [None] * 12, "n"),
             (902, [float("nan")] * 12, "n"), (903, [float("inf")] + [0.0] * 11, "n")]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, whitened string")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_whiten(spark, str(tmp_path)).collect()
    kept = np.array([r[1] for r in rows[:302]], dtype=np.float32).astype(float)
    data = [[int(v) for v in row] for row in np.floor(1024 * kept).astype(np.int64) + 100_000]
    n, sums = len(data), [sum(c) for c in zip(*data)]
    assert len(got) == n * 8 and {r.n for r in got} == {n}
    exact = Counter(sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in data)
    assert Counter(r.deviation for r in got if r.component == 1) == exact
    centred = np.array(data) - np.array(sums) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    want = centred @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    by_id = {(r.vec_id, r.component): r for r in got}
    for c in range(1, 9):
        ours = np.array([by_id[i, c].whitened for i in range(300)])
        sign = np.sign(ours @ want[:300, c - 1])
        np.testing.assert_allclose(ours, sign * want[:300, c - 1], atol=1e-9)
        assert abs(by_id[5, c].explained - e[::-1][c - 1] / e.sum()) < 1e-12
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


TEXTS = [
    None, "", " ", "a", "Plain words, twice. Plain words, twice.", "naïve Épée 中文字 🙂🙂", "line\n\nline\t\ttab  two",
    "<|endoftext|> and <s> </s> <unk> <0x0A>", "a ▁ b", "nul \x00 byte", "Ÿ" * 400, "x" * 3000, "12345 678 9.50",
    "the cat sat on the mat " * 400, "a", "​ zero", " leading and trailing ",
]
ALIGN = "doc_id bigint, text string, n_a string, block int"


@pytest.fixture(scope="module")
def brute():
    """Tokens with byte ranges of every text, each side on its own."""
    a = Tokenizer.from_str(A_JSON.decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=B_MODEL)
    held = align.Tokenizers(A_JSON, B_MODEL)

    def ranges(ids, spelled):
        end, out = 0, []
        for i in ids:
            out.append((i, end, end + len(spelled[i])))
            end += len(spelled[i])
        return out

    found = []
    for text in TEXTS:
        if not text:
            found.append(([], []))
            continue
        whole = (" " + text).encode()
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        fits = all(b"".join(t[i] for i in ids) == whole for t, ids in ((held.a_bytes, x), (held.b_bytes, y)))
        found.append((ranges(x, held.a_bytes), ranges(y, held.b_bytes)) if fits else ([], []))
    return found


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(
        [(i if i != 3 else None, t, "clash", 7) for i, t in enumerate(TEXTS)], ALIGN).repartition(3)


def test_alignment_equals_brute_force(spark, texts, brute, monkeypatch):
    counts, links = Counter(), []
    for x, y in brute:
        ends = {e: i for i, _, e in y}
        own = Counter((i, ends[e]) for i, _, e in x if e in ends)
        links.append(own)
        counts += own
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    got = {r.doc_id: r for r in align.aligned_documents(texts, A_JSON, B_MODEL).collect()}
    assert len(got) == len(TEXTS)
    for i, ((x, y), own) in enumerate(zip(brute, links)):
        r = got[i if i != 3 else None]
        cuts = sorted({e for *_, e in x} & {e for *_, e in y})
        groups = []
        for low, high in zip([0, *cuts], cuts):
            sides = [",".join(str(t) for t, _, e in side if low < e <= high) for side in (x, y)]
            groups.append("|".join(sides))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.groups) == (len(x), len(y), len(cuts), digest)
        assert r.n_links == sum(own.values())
        assert r.n_best == sum(n for p, n in own.items() if counts[p] == highest[p[1]])
        assert r.count_sum == sum(n * counts[p] for p, n in own.items())
    assert got[8].n_a == 0 and got[7].n_a > 0  # the piece sign spells a space; marks are plain text
    # Blocks and batches of a few bytes change nothing.
    monkeypatch.setattr(align, "BLOCK_BYTES", 100)
    monkeypatch.setattr(align, "BATCH_BYTES", 50)
    assert {r.doc_id: r for r in align.aligned_documents(texts, A_JSON, B_MODEL).collect()} == got


def test_pieces_spell_whole_texts(monkeypatch):
    """Piece by piece gives the ids of the whole text, also around odd white space."""
    rnd = random.Random(11)
    letters = ["a", "Bc", "é", "中", "1", "23", "'s", "'", ".", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0",
               "\u2009", "\u3000", "\u200b", "\ufeff", "🙂", "ﬁ", "<|endoftext|>", "<s>", "_", "e\u0301", "\u0600"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40))) for _ in range(4000)]
    held = align.Tokenizers(A_JSON, B_MODEL)
    assert held.split
    monkeypatch.setattr(align, "CACHED_PIECES", 500)
    got = [held.encode(texts[i : i + 100]) for i in range(0, len(texts), 100)]
    whole = align.Tokenizers(A_JSON, B_MODEL)
    whole.split = False
    want = [whole.encode(texts[i : i + 100]) for i in range(0, len(texts), 100)]
    assert got == want
    assert sum(bool(x) for a, _ in got for x in a) > 3000


def test_overlaps_equal_brute_force(spark, texts, brute):
    got = Counter(tuple(r) for r in align.overlaps(texts, A_JSON, B_MODEL).collect())
    want = Counter()
    for i, (x, y) in enumerate(brute):
        if len(x) * len(y) > 10_000_000:
            continue
        for p, (s, a, b) in enumerate(x):
            for q, (t, c, d) in enumerate(y):
                if a < d and c < b:
                    want[(i if i != 3 else None, p, s, q, t, max(a, c), min(b, d), b == d)] += 1
    assert got == want


def test_alignment_of_an_empty_table(spark, texts):
    assert align.aligned_documents(texts.limit(0), A_JSON, B_MODEL).count() == 0


def test_pieces_inside_a_text_are_not_looked_at_again(monkeypatch):
    class Counted:
        calls = 0

        def match(self, *args):
            Counted.calls += 1
            return solid.match(*args)

    solid = align._SOLID
    tokenizers = align.Tokenizers(A_JSON, B_MODEL)
    texts = [" ".join(f"word{i}é" for i in range(500)), "　odd  ends of 中文 \n", "", None, "x", " ", "x y\t"]
    whole = [(tokenizers.a.encode(" " + t, add_special_tokens=False).ids, tokenizers.b.encode(t)) if t else ([], [])
             for t in texts]
    monkeypatch.setattr(align, "_SOLID", Counted())
    for _ in range(2):  # known pieces give the same
        got = tokenizers.encode(texts)
        for side in (0, 1):
            for text, ids, packed in zip(texts, whole, got[side]):
                fits = text and all(b"".join(spell[i] for i in x) == (" " + text).encode() for spell, x in zip(
                    (tokenizers.a_bytes, tokenizers.b_bytes), ids))
                assert np.frombuffer(packed, np.uint32).tolist() == (list(ids[side]) if fits else [])
    assert Counted.calls <= 4 * len(texts) * 2
