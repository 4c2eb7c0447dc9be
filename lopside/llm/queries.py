"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lopside.llm import (
    align, bpe, chat, covertree, decontaminate, jaccard, katz, license, lines, mixing, suffix, toxicity, whiten,
)
from lopside.session import materialize

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")
TOXIC_AT = 0.7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file(path: str = RANK_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(_table(spark, sf_dir, "documents"), spans=False)


OP1_SQL = """
WITH h AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM h WHERE length(h) >= 100),
s AS (SELECT doc_id, i, md5_number(h[2 * i + 1 : 2 * i + 100]) AS s FROM w),
f AS (SELECT s, min(doc_id) AS first FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM s JOIN f USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, i, max(i + 50) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
n AS (SELECT doc_id, i, count(*) FILTER (reach IS NULL OR reach < i) OVER (
        PARTITION BY doc_id ORDER BY i) AS run FROM g),
u AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM n GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM u),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(h[2 * p + 1 : 2 * a], '' ORDER BY a) AS kept
      FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || h[2 * last + 1 :], h))) AS kept_sha256
FROM h LEFT JOIN t USING (doc_id)
"""


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.line_dedup(_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
           FROM documents),
s AS (SELECT doc_id, n, line, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c
      FROM s WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS place
      FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + i AS pos FROM r, range(3) t(i) WHERE place > 1),
marked AS (SELECT l.doc_id, l.n, l.line, gone.pos IS NOT NULL AS gone
           FROM l LEFT JOIN s USING (doc_id, n) LEFT JOIN gone ON gone.doc_id = s.doc_id AND gone.pos = s.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
      WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
reach AS (SELECT u AS doc_id, v AS other FROM e
          UNION SELECT r.doc_id, e.v FROM reach r JOIN e ON r.other = e.u),
m AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op3_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


OP3_LINKS_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b USING (s)
      WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v
      WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
k AS (SELECT u AS doc_id, count(*) AS n_links FROM e GROUP BY u),
reach AS (SELECT u AS doc_id, v AS other FROM e
          UNION SELECT r.doc_id, e.v FROM reach r JOIN e ON r.other = e.u),
m AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    own = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(own)
    return chat.read_back(chat.format_chat(chat.fold(chat.log_of(rows))))


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + escaped + 10 + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan_licenses(_table(spark, sf_dir, "documents")).drop("places")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("tag", "hits")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item_id, ws, least(len(ws), 13) AS l FROM b WHERE len(ws) > 0),
bj AS (SELECT item_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM bi),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i + 1 : i + l], ' ') AS w FROM bj),
di AS (SELECT doc_id, ws, l FROM d, (SELECT DISTINCT l FROM bw) WHERE len(ws) >= l),
dj AS (SELECT doc_id, ws, l, unnest(range(0, len(ws) - l + 1)) AS i FROM di),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i + 1 : i + l], ' ') AS w FROM dj),
hit AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, w)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    return toxicity.train_toxicity(docs, _table(spark, sf_dir, "labels"), learn=remainder(3) != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir, docs))
    return scored.select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_encode(docs, rank_file(), public_tokenizers.PATTERN, ids=False)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(_table(spark, sf_dir, "documents"), remainder(10) != 0)


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align.aligned_documents(docs, rank_file(A_FILE), rank_file(B_FILE))
    return found.withColumnRenamed("groups", "groups_sha256")


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    drawn = mixing.draw_copies(docs, carry=False)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
o AS (SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE n % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END::HUGEINT AS w, 3 * sum(s) OVER () AS pool FROM o),
c AS (
  SELECT *, 2 * s * 2 * sum(w) OVER (l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (pool - 2 * coalesce(sum(2 * s) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full
  FROM w WINDOW l AS (ORDER BY s::DOUBLE / w::DOUBLE, n)),
t AS (
  SELECT source, s, CASE WHEN is_full THEN (2 * s)::DOUBLE ELSE least((2 * s)::DOUBLE, w::DOUBLE
      * (pool - 2 * coalesce(sum(2 * s) FILTER (is_full) OVER (), 0))::DOUBLE
      / (2 * sum(w) FILTER (NOT is_full) OVER ())::DOUBLE) END AS target
  FROM c),
e AS (
  SELECT source, s, target,
    CASE WHEN s > 0 THEN floor(target / s::DOUBLE * 16777216 + 0.5) ELSE 0 END::BIGINT AS e,
    ('0x' || substr(md5('0:' || coalesce(source, '')), 1, 6))::BIGINT AS u FROM t),
p AS (
  SELECT doc_id, size, s, target, e, u + sum(e) OVER (PARTITION BY d.source
      ORDER BY size, substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 16), doc_id
      ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (size * ((upto // 16777216) - ((upto - e) // 16777216)))::BIGINT AS taken
FROM p
"""


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where it passes 64 bits; a table whose vectors are all
    equal, or none, has no components and no rows."""
    vectors = _table(spark, sf_dir, "embeddings").where(whiten.usable())
    x = F.transform("embedding", lambda c: F.floor(1024.0 * c.cast("double")) + 100000)
    rows = materialize(vectors.select("vec_id", x.alias("x")))
    fitted = whiten.fit_whitening(rows, 8)
    if fitted is None:
        fitted = whiten.Whitener(1, [], whiten.np.zeros((0, 0)), whiten.np.zeros(0), 1.0, 0.0, 0)
    white = materialize(whiten.whiten(rows, fitted))
    error = whiten.identity_error(white, fitted.n)
    apart = F.zip_with("x", F.array(*[F.lit(s) for s in fitted.sums]).cast("array<bigint>"),
                       lambda a, s: (a * F.lit(fitted.n) - s).cast("decimal(19,0)"))
    squares = F.aggregate(apart, F.lit(0).cast("decimal(38,0)"), lambda t, a: (t + a * a).cast("decimal(38,0)"))
    shares = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values]).cast("array<double>")
    return white.select(
        "vec_id", squares.try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened")
    ).select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation",
             "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op3_jaccard_links": op3_jaccard_links,
    "op4_chat_format": op4_chat_format,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_top_k": op8_top_k,
    "op9_bpe": op9_bpe,
    "op10_katz": op10_katz,
    "op11_align": op11_align,
    "op12_mix": op12_mix,
    "op13_whiten": op13_whiten,
}
ORACLES = {"op1_suffix_dedup": OP1_SQL, "op2_line_dedup": OP2_SQL, "op3_jaccard_join": OP3_SQL,
           "op3_jaccard_links": OP3_LINKS_SQL, "op4_chat_format": OP4_SQL, "op6_decontamination": OP6_SQL,
           "op8_top_k": OP8_SQL, "op12_mix": OP12_SQL}
