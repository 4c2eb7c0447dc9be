"""License scans by a positional index over rare license words.

The index holds one posting per template, (template, position) of its anchor:
the rarest word of its mandatory key phrase, by IDF over the whole corpus. Each
place p of an anchor of template position q proposes that the template starts at
p - q. A proposal is verified by the key phrase at its place, then graded by the
share of the template's words that stand at their relative positions. Other
words have no postings, and nothing is intersected: a file that holds the phrase
holds the anchor, so every place is found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lopside.llm import kernel

#: Fixed values: (label, key phrase) of the places that are counted.
BASE_PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Fixed values: (label, template, key phrase). The key phrase is part of the template.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3",
     "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2",
     "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]
MIN_COVERAGE = 0.6

_TO_SPACE = bytes(b if kernel.ALNUM[kernel.LOWER[b]] else 0x20 for b in range(256))


def license_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and all non-ASCII bytes, A-Z lower-cased."""
    return (text or "").encode("utf-8").translate(_TO_SPACE).lower().split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple
    key_at: int
    key: tuple
    base: bool


def templates() -> list[Template]:
    out = []
    for label, phrase in BASE_PHRASES:
        words = tuple(phrase.encode().split())
        out.append(Template(label, words, 0, words, True))
    for label, text, key in TEMPLATES:
        words, phrase = tuple(text.encode().split()), tuple(key.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        out.append(Template(label, words, at, phrase, False))
    return out


class PositionalIndex:
    """Postings of the templates, looked up by each key phrase's rarest word."""

    def __init__(self, known: list[Template], idf: dict[bytes, float]):
        self.templates = known
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, t in enumerate(known):
            rarest = max(range(len(t.key)), key=lambda i: (idf.get(t.key[i], 0.0), -i))
            self.postings[t.key[rarest]].append((number, t.key_at + rarest))
        self.order = sorted(self.postings, key=lambda w: (-idf.get(w, 0.0), w))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its key phrase, share of its words in place)."""
        places: dict[bytes, list[int]] = defaultdict(list)
        if not self.postings.keys().isdisjoint(words):
            for i, w in enumerate(words):
                if w in self.postings:
                    places[w].append(i)
        found = []
        for w in self.order:  # rarest first
            for p in places.get(w, ()):
                for number, q in self.postings[w]:
                    t, start = self.templates[number], p - q
                    first = start + t.key_at
                    if first < 0 or tuple(words[first : first + len(t.key)]) != t.key:
                        continue
                    same = sum(
                        1 for i, x in enumerate(t.words)
                        if 0 <= start + i < len(words) and words[start + i] == x
                    )
                    found.append((number, first, same / len(t.words)))
        return found


def license_idf(docs: DataFrame, known: list[Template], text: str = "text") -> dict[bytes, float]:
    """IDF of the templates' words over all texts (a fixed, small vocabulary)."""
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches):
        total, n = Counter(), 0
        for batch in batches:
            for x in batch.column(0):
                total.update(vocabulary.intersection(license_words(x.as_py())))
                n += 1
        total[b""] = n
        words = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w.decode() for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())],
            names=["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r["word"].encode(): r["n"] for r in rows.collect()}
    n = df.get(b"", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, places) of every row of ``docs``.

    ``places`` lists (label, word position of the key phrase, coverage) of all
    verified templates, ``score`` is the best coverage (1 for a base phrase, 0
    without any). A null or empty text has no words and no labels; a word is
    whole, so ``mits`` is no ``mit``; repeated rows are scanned each; other
    columns are not carried.
    """
    known = templates()
    shared = docs.sparkSession.sparkContext.broadcast(PositionalIndex(known, license_idf(docs, known, text)))
    place = T.StructType([
        T.StructField("label", T.StringType()), T.StructField("word", T.LongType()),
        T.StructField("coverage", T.DoubleType())])
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("places", T.ArrayType(place))])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
        [("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64())]))]

    def scan(batches):
        index = shared.value
        for whole in batches:
            for batch in kernel.chunks(whole, text):
                rows = []
                for x in batch.column(text):
                    words = license_words(x.as_py())
                    found = index.scan(words)
                    base = [(index.templates[n].label, at) for n, at, _ in found if index.templates[n].base]
                    graded = [(index.templates[n].label, at, c) for n, at, c in found
                              if c >= MIN_COVERAGE]
                    starts = [at for _, at in base]
                    rows.append((
                        len(words), len(base), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted({x for x, _ in base})), ",".join(sorted({x for x, *_ in graded})),
                        max((c for *_, c in graded), default=0.0),
                        [{"label": a, "word": b, "coverage": c} for a, b, c in sorted(graded)]))
                columns = list(zip(*rows)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                    names=schema.names)

    return docs.select("doc_id", text).mapInArrow(scan, schema)
