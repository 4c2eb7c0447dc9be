"""Synthetic over-sampling and neighbour-based cleaning.

Rows carry a key and a vector ``x``. Synthetic rows need keys of their own, so
resampled tables are keyed by a string ``sid``: the original key as text, or
``key#copy`` for a synthetic row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.hashing import hash_to_int, hash_to_uniform, seeded_hash
from lopside.operators.neighbors import knn_join
from lopside.operators.prepare import class_counts
from lopside.operators.sampling import hash_cuts, minority_class, within_cut
from lopside.session import materialize

SMOTE_K = 5
ENN_K = 3


def smote_rows(
    df: DataFrame, label: str, seed: int, key: str = "pid", vector: str = "x",
    k: int = SMOTE_K, **knn,
) -> DataFrame:
    """Only the new minority rows: (base, copy, neighbor, u, label, x).

    Every minority row gets the same number of copies, and the first few in
    seeded order one more, so that the classes become equal. A copy lies
    between its base row and one of the base's k nearest minority rows, at the
    same fraction in every column.
    """
    counts = class_counts(df, label)
    minority, majority = minority_class(counts)
    n_min, n_new = counts[minority], counts[majority] - counts[minority]
    if n_min <= k:
        raise ValueError(f"over-sampling needs more than {k} minority rows, got {n_min}")
    base = df.where(F.col(label) == minority).select(key, vector)
    each, extra = divmod(n_new, n_min)
    hashed = base.withColumn("_d", seeded_hash(seed, key)).withColumn("_g", F.lit(0))
    cut = hash_cuts(hashed, "_g", "_d", key, {0: n_min}, {0: extra})[0]
    near = knn_join(base, base, k, 2, key, vector, exclude_self=True, **knn)
    ends = near.groupBy(F.col("q").alias("base")).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "r"))).alias("_ends"))  # k of them
    # Copies and their ends are told from keys; vectors come to each pair of ends once.
    copies = F.lit(each) + within_cut(seeded_hash(seed, "base"), F.col("base"), cut).cast("int")
    rank = (hash_to_int(seeded_hash(seed, "base", "copy")) % k + 1).cast("int")
    pairs = (
        ends.withColumn("_n", copies).where("_n > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        .withColumn("neighbor", F.try_element_at("_ends", rank))
        .withColumn("u", hash_to_uniform(seeded_hash(seed + 1, "base", "copy")))
        .groupBy("base", "neighbor").agg(F.collect_list(F.struct("copy", "u")).alias("_copies"))
    )
    between = F.zip_with("bx", "nx", lambda b, n: b + F.col("_c.u") * (n - b))
    return (
        pairs.join(base.select(F.col(key).alias("neighbor"), F.col(vector).alias("nx")), "neighbor")
        .join(base.select(F.col(key).alias("base"), F.col(vector).alias("bx")), "base")
        .withColumn("_c", F.explode("_copies"))
        .select(
            "base", "_c.copy", "neighbor", "_c.u",
            F.lit(minority).cast("int").alias(label), between.alias(vector),
        )
    )


def smote(
    df: DataFrame, label: str, seed: int = 42, key: str = "pid", vector: str = "x",
    k: int = SMOTE_K, **knn,
) -> DataFrame:
    """(sid, label, x): all rows plus synthetic minority rows up to balance."""
    new = smote_rows(df, label, seed, key, vector, k, **knn)
    old = df.select(
        F.col(key).cast("string").alias("sid"), F.col(label).cast("int").alias(label), vector
    )
    return old.unionByName(new.select(
        F.concat_ws("#", F.col("base").cast("string"), "copy").alias("sid"), label, vector
    ))


def enn(
    df: DataFrame, label: str, k: int = ENN_K, key: str = "sid", vector: str = "x", **knn
) -> DataFrame:
    """Keep a row only if all its k nearest rows (itself left out) share its label."""
    near = knn_join(df, df, k, 2, key, vector, label=label, exclude_self=True, **knn)
    votes = near.groupBy("q").agg(F.min("y").alias("_low"), F.max("y").alias("_high"))
    agreed = df.join(votes, df[key] == votes["q"], "left_outer").where(
        F.col("q").isNull() | ((F.col("_low") == F.col(label)) & (F.col("_high") == F.col(label)))
    )
    return agreed.select(*[df[c] for c in df.columns])


def tomek_pairs(
    df: DataFrame, label: str, key: str = "sid", vector: str = "x", **knn
) -> DataFrame:
    """(a, b) with a < b: mutually nearest rows of opposite class."""
    near = knn_join(df, df, 1, 2, key, vector, label=label, exclude_self=True, **knn)
    own = near.select(F.col("q").alias("a"), F.col("r").alias("b"), F.col("y").alias("yb"))
    back = near.select(F.col("r").alias("a"), F.col("q").alias("b"), F.col("y").alias("ya"))
    return (
        own.join(back, ["a", "b"]).where((F.col("ya") != F.col("yb")) & (F.col("a") < F.col("b")))
        .select("a", "b")
    )


def tomek_links(
    df: DataFrame, label: str, key: str = "sid", vector: str = "x", **knn
) -> DataFrame:
    """Drop both ends of every Tomek link."""
    pairs = tomek_pairs(df, label, key, vector, **knn)
    linked = pairs.select(F.explode(F.array("a", "b")).alias("_linked"))
    return df.join(linked, df[key] == F.col("_linked"), "left_anti")


def smoteenn(
    df: DataFrame, label: str, seed: int = 42, key: str = "pid", vector: str = "x", **knn
) -> DataFrame:
    """Over-sample, then clean all classes by edited nearest neighbours."""
    whole = materialize(smote(df, label, seed, key, vector, **knn))
    return enn(whole, label, key="sid", vector=vector, **knn)


def smotetomek(
    df: DataFrame, label: str, seed: int = 42, key: str = "pid", vector: str = "x", **knn
) -> DataFrame:
    """Over-sample, then drop Tomek links."""
    whole = materialize(smote(df, label, seed, key, vector, **knn))
    return tomek_links(whole, label, key="sid", vector=vector, **knn)
