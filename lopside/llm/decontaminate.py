"""Benchmark decontamination by winnowing, in DataFrame operations only.

The words of a text are hashed, every five consecutive hashes make a k-gram
hash, and of every nine consecutive k-gram hashes the smallest is kept. Nine
k-grams of five words span thirteen words, so two texts that share thirteen
consecutive words keep a common fingerprint. Documents that share a
fingerprint with a benchmark item are extended: all their thirteen-word
windows are compared with the items' windows (by 128 bits), and the words
inside equal windows are marked.

An item of fewer words is one window as a whole. Winnowing promises nothing
about so short a span, so such an item is looked up by its first word.

The item side of a join is broadcast if it has at most ``BROADCAST_ROWS`` rows
(counted first); else both sides are shuffled, where AQE splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.session import materialize

SPAN = 13  # words of a window
GRAM = 5  # words of a k-gram
KEPT = SPAN - GRAM + 1  # k-grams of a winnowing window
BROADCAST_ROWS = 200_000  # of at most 40 bytes each

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _with_hashes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``h``, the hashes of the words, with A-Z lower-cased."""
    # lower() changes letters beyond A-Z, which an ASCII text does not have.
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    words = F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _BETWEEN), "")
    return df.withColumn("h", F.transform(words, lambda w: F.xxhash64(w)))


# In the expressions below an array is named at least twice on purpose: an array
# named once, inside a lambda, would be computed again for every element.
_GRAMS = (
    f"CASE WHEN size(h) >= {GRAM} THEN transform(sequence(0, size(h) - {GRAM}), i -> xxhash64("
    + ", ".join(f"h[i + {j}]" for j in range(GRAM)) + ")) ELSE array() END"
)
_WINNOWED = (
    f"CASE WHEN size(g) >= {KEPT} THEN array_distinct(transform(sequence(1, size(g) - {KEPT - 1}), "
    f"i -> array_min(slice(g, i, {KEPT})))) ELSE array() END"
)


def fingerprints(df: DataFrame) -> DataFrame:
    """Adds ``h`` and ``kept``, the winnowed k-gram hashes of ``text``."""
    return _with_hashes(df).withColumn("g", F.expr(_GRAMS)).withColumn("kept", F.expr(_WINNOWED))


def _windows(length: int) -> str:
    """Structs (at, len, w1, w2) of all windows of ``length`` words of ``h``."""
    parts = ", ".join(f"h[i + {j}]" for j in range(length))
    return (
        f"CASE WHEN size(h) >= {length} THEN transform(sequence(0, size(h) - {length}), i -> "
        f"named_struct('at', i, 'len', {length}, 'w1', xxhash64({parts}), 'w2', xxhash64(7, {parts}))) "
        "ELSE array() END"
    )


def _bounded(items: DataFrame) -> DataFrame:
    return F.broadcast(items) if items.count() <= BROADCAST_ROWS else items


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, n_words, n_hit, n_items, items_sha256, contaminated, hits)
    of every row of ``docs`` (``tag`` is a hash of the text).

    ``hits`` lists (first word, words) of the matching windows. A null or empty
    text, and an item without words, matches nothing. Repeated rows get equal
    results, items that share an id count once, an item with a null id marks words
    but is neither counted nor named. Other columns are not used.
    """
    items = _with_hashes(benchmark.select("item_id", "text")).select("item_id", "text", "h")
    items = materialize(items.where(F.size("h") > 0).dropDuplicates())
    short = [r[0] for r in items.where(F.size("h") < SPAN).select(F.size("h")).distinct().collect()]
    lengths = sorted([SPAN, *short])  # at most thirteen values

    own = fingerprints(items)
    of_items = own.where(F.size("h") >= SPAN).select(F.explode("kept").alias("f"))
    if short:
        of_items = of_items.unionAll(own.where(F.size("h") < SPAN).select(F.col("h")[0].alias("f")))
    of_items = _bounded(of_items.distinct())

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    looked_up = "array_union(kept, h)" if short else "kept"
    # Two steps: in one, every exploded row would carry the word hashes.
    probes = fingerprints(rows).select(
        "doc_id", "tag", F.size("h").cast("bigint").alias("n_words"), F.expr(looked_up).alias("probes"))
    probes = probes.select("doc_id", "tag", "n_words", F.explode_outer("probes").alias("probe"))
    matched = probes.join(of_items, F.col("probe") == F.col("f"), "left")
    # All probes of a row meet in one task, so this shuffles one row a document.
    # Written, as it is read twice: for the candidates and for the result.
    found = materialize(matched.groupBy("doc_id", "tag", "n_words").agg(
        F.max(F.col("f").isNotNull()).alias("candidate")))

    candidates = found.where("candidate").select(
        F.col("doc_id").alias("c_id"), F.col("tag").alias("c_tag"))
    texts = rows.dropDuplicates(["doc_id", "tag"]).join(
        candidates, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tag") == F.col("c_tag")), "left_semi")
    all_windows = F.concat(*[F.expr(_windows(n)) for n in lengths])
    of_docs = _with_hashes(texts).select("doc_id", "tag", F.inline(all_windows))

    # An item of at least thirteen words has all its windows, a shorter one itself.
    own_windows = F.lit(None)
    for n in lengths:
        fits = F.size("h") >= n if n == SPAN else F.size("h") == n
        own_windows = F.when(fits, F.expr(_windows(n))).otherwise(own_windows)
    windows = _bounded(items.select("item_id", F.inline(own_windows)).select(
        "item_id", F.col("len").alias("i_len"), F.col("w1").alias("i_w1"), F.col("w2").alias("i_w2")).distinct())
    same = (F.col("len") == F.col("i_len")) & (F.col("w1") == F.col("i_w1")) & (F.col("w2") == F.col("i_w2"))
    hits = of_docs.join(windows, same).groupBy("doc_id", "tag").agg(
        F.sort_array(F.collect_set(F.struct("at", "len"))).alias("hits"),
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"),
        F.count_distinct("item_id").alias("n_items"))

    # Words inside windows: ascending starts, each adds what lies beyond the reach so far.
    covered = F.expr(
        "aggregate(hits, named_struct('n', 0L, 'reach', 0), (a, x) -> named_struct("
        "'n', a.n + greatest(0, x.at + x.len - greatest(a.reach, x.at)), "
        "'reach', greatest(a.reach, x.at + x.len)), a -> a.n)")
    hits = hits.select(
        F.col("doc_id").alias("h_id"), F.col("tag").alias("h_tag"), "hits", "n_items",
        covered.alias("n_hit"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    both = rows.select("doc_id", "tag").join(
        found.select(F.col("doc_id").alias("f_id"), F.col("tag").alias("f_tag"), "n_words"),
        F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("tag") == F.col("f_tag")))
    both = both.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tag") == F.col("h_tag")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return both.select(
        "doc_id", "tag", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated."""
    bad = contamination(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    row = docs.select(F.struct(*docs.columns).alias("row"))
    clean = row.join(
        bad, F.col("row")["doc_id"].eqNullSafe(F.col("bad_id"))
        & (F.xxhash64(F.col("row")["text"]) == F.col("bad_tag")), "left_anti")
    return clean.select("row.*")
