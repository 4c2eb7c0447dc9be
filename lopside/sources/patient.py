"""The clinical table derived from the ``orders`` table.

One order becomes one patient row by integer arithmetic, with nulls planted by
rule and a rare label (about 15% positive) that depends on age, blood pressure
and sex. A narrow projection of three columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lopside.functions.hashing import hash_to_int, seeded_hash
from lopside.schema import KEY, LABEL, RAW_FEATURES
from lopside.sources.tables import spread


def patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return patient_rows(spread(orders.select("o_orderkey", "o_custkey", "o_totalprice")))


def patient_rows(orders: DataFrame) -> DataFrame:
    """Patient rows of a table, or a stream, of orders."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    tp = F.floor("o_totalprice").cast("bigint")
    unless = lambda divisor, value: F.when(ok % divisor != 0, value)
    one_if = lambda condition: F.when(condition, 1).otherwise(0)
    smoker = one_if(ck % 7 < 3)
    systolic = F.lit(95) + tp % 100
    noise = hash_to_int(seeded_hash(1, ok)) % 400
    signal = (ck % 39) * 10 + (tp % 100) * 4 + (ck % 2) * 80
    values = {
        "male": ck % 2,
        "age": ck % 39 + 32,
        "education": unless(41, ok % 4 + 1),
        "currentSmoker": smoker,
        "cigsPerDay": unless(149, F.when(smoker == 1, ok % 40 + 1).otherwise(0)),
        "BPMeds": unless(79, one_if(ok % 33 == 0)),
        "prevalentStroke": one_if(ok % 167 == 0),
        "prevalentHyp": one_if(systolic >= 150),
        "diabetes": one_if(ok % 39 == 0),
        "totChol": unless(83, tp % 203 + 150),
        "sysBP": systolic,
        "diaBP": tp % 53 + 60,
        "BMI": unless(223, (tp % 179 + 180).cast("double") / F.lit(10.0)),
        "heartRate": tp % 61 + 50,
        "glucose": unless(11, tp % 127 + 60),
    }
    return orders.select(
        ok.cast("bigint").alias(KEY),
        *[values[name].cast("double").alias(name) for name in RAW_FEATURES],
        one_if(signal + noise >= 840).cast("int").alias(LABEL),
    )


def scored_patients(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    """(pid, y, p, and order columns to ``keep``): a model-free score, for the
    metric operators."""
    orders = spread(
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )
    ck, tp = F.col("o_custkey"), F.floor("o_totalprice").cast("bigint")
    signal = (ck % 39) * 10 + (tp % 100) * 4 + (ck % 2) * 80
    noise = hash_to_int(seeded_hash(1, F.col("o_orderkey"))) % 400
    return orders.select(
        F.col("o_orderkey").cast("bigint").alias(KEY),
        F.when(signal + noise >= 840, 1).otherwise(0).cast("int").alias("y"),
        F.round(signal.cast("double") / F.lit(860.0), 4).alias("p"),
        *(keep or []),
    )
