"""A corpus pipeline: drop toxic documents, repeated lines, near copies and
contaminated documents, then encode what is left.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of their docs. Other tables are read from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lopside.llm import bpe, decontaminate, jaccard, lines, toxicity
from lopside.llm.queries import TOXIC_AT, rank_file, toxicity_model
from lopside.session import materialize


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score is below the threshold stay."""
    score = _free(docs, "toxicity_score")
    scored = toxicity.score_toxicity(docs, toxicity_model(spark, sf_dir, docs), output=score)
    return scored.where(F.col(score) < TOXIC_AT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, without its repeated lines; ``n_chars`` follows."""
    counts = _free(docs, "lines_before"), _free(docs, "lines_removed")
    out = lines.line_dedup(docs, counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(
            F.col(counts[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, stays of each group."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the digest of what they decode to."""
    return bpe.bpe_encode(docs, rank_file(), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: The model of the first stage is fitted here, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
