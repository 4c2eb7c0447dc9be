"""The training-data operators against brute force, on odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lopside.llm import (
    bpe, chat, covertree, decontaminate, exchange, jaccard, katz, license, lines, suffix, toxicity,
)
from lopside.llm.components import connected_components
from lopside.llm.queries import rank_file

SCHEMA = "doc_id bigint, text string, score string, block int"  # the last two clash with own names
WORDS = "alpha beta gamma delta Épée naïve 中文 x1 the of and to in it is was on at".split()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def some_texts():
    """Copies, near copies, ties, null, empty, blank, very long and odd texts."""
    rnd = random.Random(7)

    def prose(n):
        return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ly", "."]) for _ in range(n))

    long = prose(6000)
    base = [prose(60) for _ in range(6)]
    texts = [None, "", "   \n\t ", "one two", "one two", "a", "Ÿ" * 80, "z" * 300, "z" * 120, long, long + " end"]
    texts += base + [base[0], base[1].upper()]
    for b in base[:3]:
        for _ in range(4):
            parts = b.split(" ")
            parts[rnd.randrange(len(parts))] = "changed"
            texts.append(" ".join(parts))
    texts += [base[4] + "\n" + base[5] + "\n" + base[3] + "\n\nlast line", "\n".join([*base[3:6], "own"])]
    texts += ["x\ny\nz\nx\ny\nz", "x\ny\nz", "a b c d e f", "a b c d e f"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "kept", 7) for i, t in enumerate(some_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 20_000)


def brute_substrings(texts):
    first = {}
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            first.setdefault(raw[i][p : p + 50], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p + 1 : p + 51] = True
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), sha(kept))
    return out


def test_suffix_dedup(docs, texts, none):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans)
           for r in suffix.substring_dedup(docs).collect()}
    assert {i: r[:4] for i, r in got.items()} == brute_substrings(texts)
    assert all(sum(s.stop - s.start for s in r[4]) == r[1] for r in got.values())
    assert suffix.substring_dedup(none).count() == 0


def test_suffix_dedup_in_one_block_and_repeated_rows(docs, texts, spark, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 1 << 30)
    twice = docs.unionAll(docs)
    got = [tuple(r) for r in suffix.substring_dedup(twice, spans=False).collect()]
    want = [(i, *r) for i, r in brute_substrings(texts).items()] * 2
    assert sorted(got) == sorted(want)


def test_levels_grow_geometrically():
    family = suffix.Levels()
    rnd = np.random.default_rng(1)
    for _ in range(64):
        family.add(np.sort(rnd.integers(0, 2**60, 100, dtype=np.uint64)))
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 6400 and len(sizes) <= 7 and sizes == sorted(sizes, reverse=True)
    assert family.holds(np.sort(np.concatenate(family.levels))).all()


def brute_lines(texts):
    windows, gone = defaultdict(list), defaultdict(set)
    solid = {}
    for i in sorted(texts):
        split = (texts[i] or "").split("\n")
        solid[i] = [n for n, line in enumerate(split) if re.search(r"[^\x20\x09-\x0D]", line)]
        for a in range(len(solid[i]) - 2):
            windows[tuple(split[n] for n in solid[i][a : a + 3])].append((i, a))
    for places in windows.values():
        for i, a in places[1:]:
            gone[i].update(solid[i][a : a + 3])
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i]) if t is not None else None
            for i, t in texts.items()}


def test_line_dedup(docs, texts, none):
    got = lines.line_dedup(docs).collect()
    assert {r.doc_id: r.text for r in got} == brute_lines(texts)
    assert all(r.score == "kept" and r.block == 7 for r in got)
    assert lines.line_dedup(none).count() == 0
    # A row given twice is no repeat of itself.
    twice = Counter((r.doc_id, r.text) for r in lines.line_dedup(docs.unionAll(docs)).collect())
    assert twice == Counter({k: 2 for k in brute_lines(texts).items()})


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in texts:
            common = len(sets[i] & sets[j])
            if i < j and common and 100 * common >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_jaccard_components(docs, texts, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(texts)
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("size", [1, 40, 1 << 30])
def test_jaccard_any_boundary(docs, texts, size, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda found: size)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()}


@pytest.mark.parametrize("cell", [512, 2])
def test_jaccard_links_that_no_first_member_sees(spark, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda found: 1)  # inverted lists only
    monkeypatch.setattr(jaccard, "CELL_CLASSES", cell)
    long = [f"w{i}" for i in range(204)]
    # Each list of documents 0 and 1 begins with a part of the long text, which is like neither.
    texts = {0: " ".join([*long, "one"]), 1: " ".join([*long, "two"]), 2: " ".join(long[:144]),
             3: " ".join(long[30:174]), 4: " ".join(long[60:])}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_join(table).collect()}
    assert {i: r[:2] for i, r in got.items()} == brute_components(texts)
    assert [got[i][1:] for i in range(5)] == [(0, 1), (0, 1), (2, 0), (3, 0), (4, 0)]


def test_jaccard_enumerates_open_shingles_only(spark, monkeypatch):
    seen, cost = [], jaccard.boundary
    monkeypatch.setattr(jaccard, "boundary", lambda found: seen.append(found.collect()) or cost(found))
    base, other = ([f"{x}{i}" for i in range(104)] for x in "ab")
    texts = {i: " ".join([*base[: 104 - i], f"end{i}"]) for i in range(10)}  # all like the longest
    texts |= {20: " ".join(other[:60]), 21: " ".join(other[40:])}  # share shingles, are not alike
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts).items()}
    assert not seen[0]  # copies of one component enumerate nothing
    texts |= {30: " ".join([*base[:30], *other[:3]])}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(table).collect()} == {
        i: c for i, (_, c) in brute_components(texts).items()}


@pytest.mark.parametrize("cell", [512, 3])
def test_jaccard_counts_every_link(spark, docs, texts, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL_CLASSES", cell)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(500)}" for _ in range(200)]
    near = [" ".join([*base[:-k], *[f"end{k}"] * (k % 3)]) for k in range(1, 41)]  # all near, through many thirds
    texts = texts | {1000 + i: t for i, t in enumerate([*near, near[3], near[3].upper()])}
    sets = {i: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := words(t)) else set()
            for i, t in texts.items()}
    links = {(i, j) for i in sets for j in sets if i < j and sets[i]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in jaccard.jaccard_join(table).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in x for x in links) for i in texts}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    size = Counter(frozenset(x) for x in sets.values())
    want = {(i, j, size[frozenset(sets[i])], size[frozenset(sets[j])]) for i, j in links
            if sets[i] != sets[j] and first[frozenset(sets[i])] == i and first[frozenset(sets[j])] == j}
    pairs = [tuple(r) for r in jaccard.jaccard_links(table).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 400
    assert jaccard.jaccard_join(table.limit(0)).count() == 0


def test_keep_one_of_repeated_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a, "x"), (2, a + " end", "x"), (2, b, "clean"),  # id 2: a near copy, and a text of its own
            (5, b + " end", "x"), (None, a, "x"), (None, "c d e f g h i", "own"), (None, "c d e f g h i", "own"),
            (7, "k l m n o p", "p"), (7, "k l m n o p", "q"), (8, "k l m n o p", "x"), (9, None, "x"), (9, None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    once = jaccard.keep_one(table)
    assert once.columns == table.columns
    got = Counter(tuple(r) for r in once.collect())
    seven = [r for r in got if r[0] == 7]
    assert len(seven) == 1 and seven[0] in rows
    assert got == Counter([rows[0], rows[2], rows[5], seven[0], rows[10], rows[11]])
    again = jaccard.keep_one(table.repartition(5, "score"))
    assert Counter(tuple(r) for r in again.collect()) == got
    assert jaccard.keep_one(table.limit(0)).count() == 0


def test_connected_components_of_a_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    links = links.unionAll(spark.sql("SELECT 100L, 101L UNION ALL SELECT 101L, 101L UNION ALL SELECT NULL, 5L"))
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


def test_chat_round_trip(spark):
    said = "<|im_end|>\\<|im_start|>assistant\n\\n <\\| ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 2, None, None),
            (2, 0, "ass\nistant", "x" * 2000), (2, None, "assistant", ""), (None, 0, "assistant", "é中🙂")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chat(chat.fold(chat.log_of(table, 3)))).collect()}
    for conv in (1, 2, None):
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        lost = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(lost), sha(lost))
    assert chat.read_back(chat.format_chat(chat.fold(chat.log_of(table.limit(0))))).count() == 0


def test_chat_folds_edits_and_regenerations(spark):
    log = [(1, 0, 1, 0, "delta", "user", "he"), (1, 0, 1, 1, None, None, "llo"),
           (1, 1, 1, 0, "delta", "assistant", "bad"), (1, 1, 1, 1, "regenerate", None, None),
           (1, 1, 1, 2, "delta", None, "go"), (1, 1, 1, 3, "delta", None, "od"),
           (1, 2, 1, 0, "delta", "user", "old"), (1, 2, 1, 1, "edit", None, "new"), (1, 2, 1, 2, "delta", None, "er")]
    table = spark.createDataFrame(
        log, "conv_id long, turn long, copy long, seq long, kind string, role string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.fold(table).orderBy("turn").collect()]
    assert got == [(0, "user", "hello"), (1, "assistant", "good"), (2, "user", "newer")]


def test_chat_log_holds_all_kinds_of_events(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", "ab" * (c * t)) for c in range(12) for t in range(6)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.log_of(table, 8).persist()
    kinds = defaultdict(set)
    for r in log.collect():
        kinds[r.conv_id, r.turn].add((r.kind, r.kind == "regenerate" and r.text is None))
    assert {x for k in kinds.values() for x in k} == {
        ("delta", False), ("edit", False), ("regenerate", False), ("regenerate", True)}
    assert 0.3 < sum(len(k) > 1 for k in kinds.values()) / len(kinds) < 0.9
    assert sorted(tuple(r) for r in chat.fold(log).drop("copy").collect()) == sorted(rows)


def test_license_scan(spark, none):
    rows = [(1, "Released under the MIT License. apache license, version 2 -- CC-BY-NC!"), (2, None), (3, ""),
            (4, "under the mit licenses"), (5, "under the mit license " * 50), (6, "cc by nc" + " word" * 40000),
            (7, "This work is licensed under the GNU General Public License, version 3."), (8, "gnu général")]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
        base = [(label, a) for label, p in license.BASE_PHRASES for a in range(len(w))
                if w[a : a + len(p.split())] == p.split()]
        starts = [a for _, a in base]
        assert got[i].n_words == len(w) and got[i].n_base == len(base)
        assert (got[i].first_word, got[i].last_word) == (min(starts, default=None), max(starts, default=None))
        assert got[i].base_labels == ",".join(sorted({x for x, _ in base}))
        assert set(filter(None, got[i].base_labels.split(","))) <= set(got[i].labels.split(","))
        assert 0 <= got[i].score <= 1
    assert got[7].labels == "gpl-3" and got[8].labels == ""
    assert license.scan_licenses(none).count() == 0


def brute_contamination(texts, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, low(t))
        n = min(13, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[a : a + n])].add(i)
    out = {}
    for d, t in texts.items():
        w = re.findall(pattern, low(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), sha(ids), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("short", [True, False])
def test_decontamination(spark, texts, docs, none, short):
    long = (texts[9] or "").split(" ")
    items = [(10, " ".join(long[100:130])), (11, " ".join(long[110:123]).upper()), (11, " ".join(long[300:320])),
             (12, texts[12]), (13, None), (14, ""), (12, texts[12])]
    items += [(15, "one two"), (16, "a")] * short
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, benchmark).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == (
        brute_contamination(texts, items))
    clean = decontaminate.decontaminate(docs.unionAll(docs), benchmark)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter({r.doc_id: 2 for r in got if not r.contaminated})
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == docs.count()


def test_decontamination_without_broadcast(spark, texts, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    items = [(12, texts[12]), (15, "one two")]
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: r.n_hit for r in got} == {i: v[1] for i, v in brute_contamination(texts, items).items()}


def test_toxicity(spark, sf, docs, none):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    model = toxicity.train_toxicity(rows, labels, learn)
    scored = toxicity.score_toxicity(rows, model).join(labels, "doc_id").where(~learn)
    pairs = [(r.score, r.toxic) for r in scored.collect()]
    pos, neg = [s for s, t in pairs if t == 1], [s for s, t in pairs if t == 0]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.85 and sum(s >= 0.7 for s in neg) <= 0.02 * len(neg)
    odd = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, output="score").collect()}
    assert all(0 <= r.score <= 1 for r in odd.values()) and odd[0].score == odd[1].score == 0.0
    assert toxicity.score_toxicity(none, model).count() == 0
    found = toxicity.offending_sentences(rows.join(labels.where("toxic = 1"), "doc_id"), model)
    assert found.count() > 0 and found.where("p < 0.5 OR length(text) = 0").count() == 0


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (3, 0), (99, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    assert toxicity.score_toxicity(docs, model).where("score >= 0.7").count() == 0


def test_toxicity_sample_is_bounded_with_repeated_ids(spark, monkeypatch):
    sampled = []
    monkeypatch.setattr(toxicity, "fit_noisy_or", lambda texts, y, weights: sampled.append(
        sorted(zip(texts.to_pylist(), y.tolist(), weights.tolist()))))
    rows = [(1, "same")] * 30 + [(1, f"text {i}") for i in range(30)] + [(2, "good"), (3, "fine")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    toxicity.train_toxicity(table, labels, sample_rows=5)
    toxicity.train_toxicity(table, labels)
    few, every = sampled
    assert len(few) == 7 and len({t for t, _, _ in few}) == 7
    assert {w for _, y, w in few if y} == {60 / 5} and {w for _, y, w in few if not y} == {1.0}
    assert [t for t, *_ in every] == sorted({t for _, t in rows})


def test_noisy_or_blames_the_sentence():
    rnd = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        sentences = [" ".join(rnd.choice(WORDS) for _ in range(6)) + "." for _ in range(5)]
        if i % 4 == 0:
            sentences[rnd.randrange(5)] += " villain here."
        texts.append(" ".join(sentences))
        labels.append(int(i % 4 == 0))
    import pyarrow as pa

    model = toxicity.fit_noisy_or(pa.array(texts), np.array(labels))
    clean, pointers, *_ = toxicity.sentence_scores(pa.array(["the of. villain here. and to."]), model)
    p = -np.expm1(clean)
    assert p[1] > 0.7 and max(p[0], p[2]) < 0.2


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=8).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # a mass of equal vectors
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = covertree.top_k(table, table.where("vec_id % 50 = 0")).collect()
    live = {r.vec_id: [math.floor(256 * float(x)) for x in r.embedding] for r in table.collect()
            if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)}
    want = []
    for q in live:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(live[q], live[x])), x) for x in live if x != q)[:5]
            want += [(q, n, x, -s) for n, (s, x) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert covertree.top_k(table.limit(0), table.limit(0)).count() == 0


def test_cover_tree_invariants():
    points = np.random.default_rng(2).normal(size=(700, 5))
    tree = covertree.CoverTree(points)
    for center, radius, members, children in tree.nodes:
        assert np.linalg.norm(points[members] - points[center], axis=1).max() <= radius + 1e-9
        if children:
            assert sorted(np.concatenate([tree.nodes[c][2] for c in children])) == sorted(members)


def test_top_k_leaves_merge_all_queries_at_once(monkeypatch):
    """One sort for a pair of leaves, not one for each of its queries; copies keep their ids."""
    rng = np.random.default_rng(4)
    x = rng.integers(-256, 256, (300, 16))
    x[200:] = x[:100]
    unique, ids = x[:200], np.empty(200, dtype=object)
    for i in range(200):
        ids[i] = np.array([i, i + 200] if i < 100 else [i])
    sorts, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: (sorts.append(1), real(keys))[1])
    search = covertree._Search(x[:150], np.arange(150), unique, ids, 5)
    search.run()
    assert len(sorts) < 150
    monkeypatch.undo()
    for q in range(150):
        order = [i for i in np.lexsort((np.arange(300), -(x @ x[q]))) if i != q][:5]
        assert search.found[q].tolist() == order and search.score[q].tolist() == (x[order] @ x[q]).tolist()


def test_top_k_over_shards(spark, monkeypatch):
    monkeypatch.setattr(covertree, "DATA_SHARD", 100)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 100)
    rnd = np.random.default_rng(6)
    rows = [(i, rnd.integers(-3, 4, size=4).astype(float).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = {i: np.array([256 * x for x in e]) for i, e in rows}
    for q, n in Counter(r.query_id for r in covertree.top_k(table, table, k=3).collect()).items():
        assert n == 3
    got = {(r.query_id, r["rank"]): r.vec_id for r in covertree.top_k(table, table, k=3).collect()}
    for q in v:
        best = sorted((-v[q] @ v[x], x) for x in v if x != q)[:3]
        assert [got[q, n] for n in (1, 2, 3)] == [x for _, x in best]


@pytest.fixture(scope="module")
def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, texts, none, own_encoding):
    got = {r.doc_id: r for r in bpe.bpe_encode(docs, rank_file(), public_tokenizers.PATTERN).collect()}
    for i, t in texts.items():
        ids = own_encoding.encode_ordinary(t or "")
        joined = " ".join(map(str, ids))
        assert (got[i].n_tokens, got[i].ids, got[i].ids_sha256) == (len(ids), joined, sha(joined))
        assert got[i].decoded_sha256 == sha(t or "") and got[i].score == "kept"
    assert bpe.bpe_encode(none, rank_file(), public_tokenizers.PATTERN).count() == 0


def test_bpe_pieces_by_both_trees(own_encoding):
    rnd = random.Random(4)
    ranks = bpe.Ranks(rank_file())
    pieces = [bytes(rnd.choice(b"abcdetnios \xc3\xa9\xff") for _ in range(rnd.randrange(1, 64))) for _ in range(500)]
    batch = bpe.encode_batch(pieces, ranks)
    for piece, ids in zip(pieces, batch):
        assert ids == bpe.encode_long(piece, ranks)
        assert bpe.decode(" ".join(map(str, ids)), ranks) == piece
    run = "ab" * 4000
    assert bpe.encode_long(run.encode(), ranks) == own_encoding.encode_ordinary(run)


def test_katz(docs, texts, none):
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 0
    got = {r.doc_id: r for r in katz.katz_scores(docs, learn).collect()}
    tokens = {i: [*words(t), "\0"] for i, t in texts.items()}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 3 != 0]
    one, two = Counter(), defaultdict(Counter)
    for i in train:
        for h, w in zip(["\1", *tokens[i]], tokens[i]):
            one[w] += 1
            two[h][w] += 1
    n, v = sum(one.values()), len(one)

    def cut(counts):
        of = Counter(counts)
        return katz.discounts(np.array([0] + [of[r] for r in range(1, 7)], dtype=float))

    d1, d2 = cut(one.values()), cut(c for h in two.values() for c in h.values())

    def less(c, d):
        return c * (d[c] if c <= 5 else 1)

    freed = n - sum(less(c, d1) for c in one.values())
    total, unknown = (n, freed / n) if freed > 1e-9 else (n + 1, 1 / (n + 1))

    def p1(w):
        return less(one[w], d1) / total if one[w] else unknown

    def p(w, h):
        seen = two.get(h)
        if not seen:
            return p1(w)
        c = sum(seen.values())
        free = c - sum(less(x, d2) for x in seen.values())
        t, left = (c, free / c) if free > 1e-9 else (c + 1, 1 / (c + 1))
        return less(seen[w], d2) / t if seen[w] else left / (1 - sum(map(p1, seen))) * p1(w)

    for h in ["\1", *list(two)[:20]]:  # exactly normalised over all words and the unknown one
        assert sum(p(w, h) for w in one) + p("\2", h) == pytest.approx(1, abs=1e-9)
    for i, t in tokens.items():
        assert got[i].score == pytest.approx(sum(math.log10(p(w, h)) for h, w in zip(["\1", *t], t)), abs=1e-6)
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert got[i].base_score == pytest.approx(base, abs=1e-6)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (
            len(t), sum(one[w] > 0 for w in t), n, i not in train)
    assert katz.katz_scores(none, learn).count() == 0
    assert katz.katz_scores(docs, F.lit(False)).where("n_known > 0 OR isnan(score)").count() == 0


def test_pipeline_stages(spark, tmp_path, docs, texts):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, texts[9][:2000])], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == rows.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, rows = rows.count(), spark.read.parquet(f"{tmp_path}/{name}")
        after = rows.count()
        assert after == before if name in ("line dedup", "toxicity", "byte-level BPE") else after <= before
    kept = brute_lines(texts)
    assert {r.doc_id for r in rows.collect()} <= {i for i, (_, c) in brute_components(kept).items() if i == c}
