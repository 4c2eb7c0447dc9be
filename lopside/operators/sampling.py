"""Seeded splits, under-sampling and balanced bags with exact counts.

All of them keep "the first m rows of a group in seeded hash order". Ranking a
whole class in one window would put it in one task, so the rank is turned into
a cut point: a histogram over leading hash digits finds the bucket that holds
rank m, deeper digits of that bucket narrow it down, and only a bucket of at most
``BUCKET_ROWS`` rows is ranked. With the cut point known, choosing rows is a narrow
comparison with no shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.functions.digests import Keys
from lopside.functions.hashing import hash_to_uniform, seeded_hash
from lopside.operators.prepare import class_counts
from lopside.session import materialize

BUCKET_ROWS = 50_000
FEW = 8  # groups that are told apart by conditions
DIGITS = 3  # hash digits per histogram: at most 4096 buckets of a group
EVERYTHING = "~"  # sorts after every hex digest


@dataclass(frozen=True)
class Cut:
    """Rows up to and including (digest, key) in seeded order are kept."""

    digest: str
    key: object


NOTHING = Cut("", None)
ALL = Cut(EVERYTHING, None)


def hash_cuts(
    df: DataFrame, group: str, digest: str, key: str, sizes: dict, targets: dict
) -> dict[object, Cut]:
    """Cut point per group value such that exactly ``targets[g]`` rows pass.

    ``df`` has one row per candidate; ``key`` breaks digest ties. Groups are
    few (classes or bags), so the cut points are driver-side parameters.
    """
    cuts: dict[object, Cut] = {}
    open_groups = {}
    for g, size in sizes.items():
        target = targets.get(g, 0)
        if target <= 0:
            cuts[g] = NOTHING
        elif target >= size:
            cuts[g] = ALL
        else:
            open_groups[g] = target
    if not open_groups:
        return cuts

    wanted = df.where(F.col(group).isin(list(open_groups))).select(
        F.col(group).alias("g"), F.col(digest).alias("d"), F.col(key).alias("k")
    )
    before = {g: 0 for g in open_groups}
    prefix = {g: "" for g in open_groups}
    held = dict.fromkeys(open_groups, BUCKET_ROWS + 1)
    inside = wanted
    # Every cut goes through a histogram; buckets still too full are split again.
    for depth in range(DIGITS, 33, DIGITS):
        if max(held.values()) <= BUCKET_ROWS:
            break
        split = {g for g in open_groups if held[g] > BUCKET_ROWS}
        inside = wanted.where(_starts(prefix))
        histogram = (
            inside.where(F.col("g").isin(list(split))).withColumn("bucket", F.substring("d", 1, depth))
            .groupBy("g", "bucket").agg(F.count(F.lit(1)).alias("n"))
        )
        upto = F.sum("n").over(
            Window.partitionBy("g").orderBy("bucket")
            .rowsBetween(Window.unboundedPreceding, 0)
        )
        target = _case("g", {g: open_groups[g] - before[g] for g in split})
        holding = (
            histogram.withColumn("upto", upto)
            .where((F.col("upto") >= target) & (F.col("upto") - F.col("n") < target))
            .collect()
        )
        for r in holding:
            g = r["g"]
            before[g] += r["upto"] - r["n"]
            prefix[g], held[g] = r["bucket"], r["n"]
    wanted = wanted.where(_starts(prefix))
    rank = F.row_number().over(Window.partitionBy("g").orderBy("d", "k"))
    at = _case("g", {g: t - before[g] for g, t in open_groups.items()})
    for r in wanted.withColumn("rank", rank).where(F.col("rank") == at).collect():
        cuts[r["g"]] = Cut(r["d"], r["k"])
    return cuts


def _starts(prefix: dict) -> Column:
    """Rows whose digest starts with their group's prefix."""
    if len(prefix) > FEW:
        return F.col("d").startswith(_lookup("g", prefix))
    found = F.lit(False)
    for g, p in prefix.items():
        found = found | ((F.col("g") == F.lit(g)) & F.col("d").startswith(p))
    return found


def _lookup(column: str, values: dict) -> Column:
    """The entry of a literal map: a long chain of conditions is too large a method for the JIT."""
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col(column))


def _case(column: str, values: dict) -> Column:
    if len(values) > FEW:
        return _lookup(column, values)
    items = list(values.items())
    chain = F.when(F.col(column) == F.lit(items[0][0]), F.lit(items[0][1]))
    for g, v in items[1:]:
        chain = chain.when(F.col(column) == F.lit(g), F.lit(v))
    return chain


def within_cut(digest: Column, key: Column, cut: Cut) -> Column:
    if cut.digest == "":
        return F.lit(False)
    if cut.digest == EVERYTHING:
        return F.lit(True)
    same = digest == F.lit(cut.digest)
    return (digest < F.lit(cut.digest)) | (same & (key <= F.lit(cut.key)))


def largest_remainder(counts: dict[int, int], total: int) -> dict[int, int]:
    """Share ``total`` over the classes in proportion; lower class first on ties."""
    n = sum(counts.values())
    shares = {c: divmod(total * size, n) for c, size in counts.items()}
    given = {c: whole for c, (whole, _) in shares.items()}
    left = total - sum(given.values())
    for c in sorted(shares, key=lambda c: (-shares[c][1], c))[:left]:
        given[c] += 1
    return given


def split_sizes(counts: dict[int, int], frac: float) -> dict[int, int]:
    """Rows per class on the second side: ``ceil(frac * n)`` shared out."""
    if frac <= 0:
        return {c: 0 for c in counts}
    # Rounded first: 0.2 * n in doubles can land just above a whole number.
    total = math.ceil(round(frac * sum(counts.values()), 9))
    return largest_remainder(counts, total)


def _in_cuts(group: Column, digest: Column, key: Column, cuts: dict) -> Column:
    chosen = F.lit(False)
    for g, cut in cuts.items():
        chosen = chosen | ((group == F.lit(g)) & within_cut(digest, key, cut))
    return chosen


def stratified_split(
    df: DataFrame, label: str | None, frac: float, seed: int, key: str,
    names: tuple[str, str] = ("train", "test"), column: str = "split",
) -> DataFrame:
    """Tag every row with one of two names; the second gets ``ceil(frac * n)``.

    Class shares are exact. Without the label column the split is unstratified;
    ``frac=0`` puts everything on the first side.
    """
    first, second = names
    if frac <= 0:
        return df.withColumn(column, F.lit(first))
    stratified = label is not None and label in df.columns
    strata = df.withColumn("_g", F.col(label) if stratified else F.lit(0))
    strata = strata.withColumn("_d", seeded_hash(seed, key))
    counts = class_counts(strata, "_g")
    cuts = hash_cuts(strata, "_g", "_d", key, counts, split_sizes(counts, frac))
    chosen = _in_cuts(F.col("_g"), F.col("_d"), F.col(key), cuts)
    return strata.withColumn(
        column, F.when(chosen, F.lit(second)).otherwise(F.lit(first))
    ).drop("_g", "_d")


def three_way_split(
    df: DataFrame, label: str, test_frac: float, val_frac: float, seed: int, key: str
) -> DataFrame:
    """``split`` is train, val or test; val is a share of what is not test.

    The sizes of what is left after the test cut are known, so the classes are
    counted once.
    """
    hashed = df.withColumns({"_d": seeded_hash(seed, key), "_e": seeded_hash(seed + 1, key)})
    counts = class_counts(df, label)  # fails on a null label
    tested = split_sizes(counts, test_frac)
    cuts = hash_cuts(hashed, label, "_d", key, counts, tested)
    in_test = _in_cuts(F.col(label), F.col("_d"), F.col(key), cuts)
    left = {c: n - tested[c] for c, n in counts.items()}
    val_cuts = hash_cuts(
        hashed.where(~in_test), label, "_e", key, left, split_sizes(left, val_frac)
    )
    in_val = _in_cuts(F.col(label), F.col("_e"), F.col(key), val_cuts)
    tag = F.when(in_test, F.lit("test")).when(in_val, F.lit("val")).otherwise(F.lit("train"))
    return hashed.withColumn("split", tag).drop("_d", "_e")


def minority_class(counts: dict[int, int]) -> tuple[int, int]:
    """(minority, majority) label; class 1 is the minority on a tie."""
    if len(counts) != 2:
        raise ValueError(f"need exactly two classes, got {sorted(counts)}")
    low, high = sorted(counts)
    return (low, high) if counts[low] < counts[high] else (high, low)


def undersample(df: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """Cut the majority to the minority's size, without replacement."""
    counts = class_counts(df, label)
    minority, majority = minority_class(counts)
    hashed = df.withColumn("_d", seeded_hash(seed, key))
    cut = hash_cuts(
        hashed.where(F.col(label) == majority), label, "_d", key,
        {majority: counts[majority]}, {majority: counts[minority]},
    )[majority]
    keep = (F.col(label) == minority) | within_cut(F.col("_d"), F.col(key), cut)
    return hashed.where(keep).drop("_d")


def balanced_draws(
    df: DataFrame, label: str, seeds: list[int], key: str, output: str = "draw"
) -> DataFrame:
    """``output`` says for each of ``seeds`` whether ``undersample`` keeps the row."""
    counts = class_counts(df, label)
    minority, majority = minority_class(counts)
    numbers = F.array(*[F.lit(s) for s in seeds])
    digest = lambda s: F.md5(F.concat_ws(":", s.cast("string"), F.col(key).cast("string")))
    places = df.where(F.col(label) == majority).select(
        key, F.posexplode(numbers).alias("place", "s")).select(key, "place", digest(F.col("s")).alias("d"))
    n = len(seeds)
    cuts = hash_cuts(places, "place", "d", key, dict.fromkeys(range(n), counts[majority]),
                     dict.fromkeys(range(n), counts[minority]))
    limits = F.array(*[F.lit(cuts[b].digest) for b in range(n)])
    # One digest names one key, so comparing digests is enough.
    kept = F.transform(F.arrays_zip(numbers.alias("s"), limits.alias("limit")), lambda z: (
        (F.col(label) == minority) | (digest(z["s"]) <= z["limit"])))
    return df.withColumn(output, kept)


def _poisson_cdf() -> list[float]:
    """Cumulative Poisson(1) probabilities up to the resolution of the uniform
    numbers (32 bits): no draw they can make is cut off."""
    bounds, term = [], math.exp(-1.0)
    while not bounds or 1.0 - bounds[-1] >= 2.0**-32:
        bounds.append(sum(bounds[-1:]) + term)
        term /= len(bounds)
    return bounds


POISSON_CDF = _poisson_cdf()


def poisson_count(u: Column) -> Column:
    """Draws of one row by inverse CDF of Poisson(1)."""
    chain = F.when(u < F.lit(POISSON_CDF[0]), F.lit(0))
    for count, bound in enumerate(POISSON_CDF[1:], start=1):
        chain = chain.when(u < F.lit(bound), F.lit(count))
    return chain.otherwise(F.lit(len(POISSON_CDF)))


def bag_uniform(key: str, seed: int, bag: Column) -> Column:
    return hash_to_uniform(seeded_hash(seed, bag, F.col(key)))


def bootstrap(df: DataFrame, n_bags: int, seed: int, key: str, output: str = "draws") -> DataFrame:
    """``output`` holds the row's number of draws in each bag.

    Poisson(1) draws need no row count and no coordination; a bag has about n
    rows, not exactly n.
    """
    return df.withColumn(output, _draws(n_bags, seed)(F.col(key).cast("string")))


def _draws(n_bags: int, seed: int):
    """Poisson draws of a key in each bag: ``poisson_count`` of ``seeded_hash(seed, bag, key)``,
    whose text leaves out a null key. Expressions would be interpreted for each (row, bag)."""
    @F.arrow_udf("array<int>")
    def draws(keys: pa.Array) -> pa.Array:
        n = len(keys)
        high, _ = Keys(keys).digests(seed, np.tile(np.arange(n_bags), n), np.repeat(np.arange(n), n_bags))
        u = (high >> np.uint64(32)) / 4294967296.0
        drawn = np.searchsorted(POISSON_CDF, u, side="right").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bags), pa.array(drawn))

    return draws


def balanced_bags(
    df: DataFrame, label: str, n_bags: int, seed: int, key: str, output: str = "bag_w"
) -> DataFrame:
    """``output`` is an array: copies of the row kept in each balanced bag.

    Bootstrap, then cut the majority's copies to the minority's draws in that
    bag. Bags are seeded by number: the first 30 of 50 are the 30.
    """
    minority, _ = minority_class(class_counts(df, label))
    drawn = materialize(bootstrap(df, n_bags, seed, key, "_n"))  # read four times
    draws = (
        drawn.where(F.col(label) == minority).select(F.posexplode("_n").alias("bag", "n")).where("n > 0")
        .groupBy("bag").agg(F.sum("n").alias("n")).collect()
    )
    text = F.col(key).cast("string")
    copies = drawn.where(F.col(label) != minority).select(text.alias("k"), "_n")
    limits = _copy_limits(copies, seed, {b: 0 for b in range(n_bags)} | {r["bag"]: r["n"] for r in draws})
    kept = _kept_copies(seed, limits)(text, F.when(F.col(label) != minority, F.col("_n")))
    weights = F.when(F.col(label) == minority, F.col("_n")).otherwise(kept)
    return drawn.withColumn(output, weights).drop("_n")


def _copies(keys: pa.Array, drawn: pa.Array, n_bags: int, seed: int):
    """(bag, row, copy, two halves of the digest) of all copies of rows; a null list has none."""
    lists = drawn.is_valid().to_numpy(zero_copy_only=False)
    n = np.zeros((len(keys), n_bags), dtype=np.int32)
    if lists.any():
        n[lists] = drawn.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_bags)
    at = np.flatnonzero(n.ravel())
    times = n.ravel()[at]
    at = np.repeat(at, times)
    copy = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + 1
    row, bag = np.divmod(at, n_bags)
    return bag, row, copy, *Keys(keys).digests(seed, bag, row, copy)


def _copy_limits(copies: DataFrame, seed: int, targets: dict[int, int]) -> dict[int, str]:
    """The last digest of each bag's first ``targets`` copies in seeded order.

    The leading digits are counted where the copies are hashed; only copies in the
    bucket that holds a bag's target are ranked.
    """
    n_bags, buckets = len(targets), 16**DIGITS

    def leading(high):
        return (high >> np.uint64(64 - 4 * DIGITS)).astype(np.int64)

    def count(batches):
        n = np.zeros(n_bags * buckets, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                bag, _, _, high, _ = _copies(batch.column("k"), batch.column("_n"), n_bags, seed)
                n += np.bincount(bag * buckets + leading(high), minlength=len(n))
        some = np.flatnonzero(n)
        bag, bucket = np.divmod(some, buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bag.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[some])],
            names=["bag", "bucket", "n"])

    counts = copies.mapInArrow(count, "bag int, bucket int, n bigint").groupBy("bag", "bucket").agg(F.sum("n").alias("n"))
    by_bag = Window.partitionBy("bag")
    upto = F.sum("n").over(by_bag.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    target = _case("bag", targets)
    found = (
        counts.withColumn("upto", upto).withColumn("whole", F.sum("n").over(by_bag))
        .where((F.col("upto") >= F.least(target, F.col("whole"))) & (F.col("upto") - F.col("n") < target)).collect()
    )
    limits = dict.fromkeys(targets, NOTHING.digest)
    prefix, sizes, left = {}, {}, {}
    for r in found:
        b = r["bag"]
        if targets[b] >= r["whole"]:
            limits[b] = EVERYTHING
        elif targets[b] > 0:
            prefix[b], sizes[b], left[b] = r["bucket"], r["n"], targets[b] - (r["upto"] - r["n"])
    if not prefix:
        return limits
    wanted = np.full(n_bags, -1, dtype=np.int64)
    wanted[list(prefix)] = list(prefix.values())

    def inside(batches):
        for batch in batches:
            if batch.num_rows:
                bag, row, _, high, low = _copies(batch.column("k"), batch.column("_n"), n_bags, seed)
                at = np.flatnonzero(leading(high) == wanted[bag])
                digest = [f"{a:016x}{b:016x}" for a, b in zip(high[at].tolist(), low[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bag[at].astype(np.int32)), batch.column("k").take(pa.array(row[at])), pa.array(digest, pa.string())],
                    names=["bag", "k", "d"])

    cuts = hash_cuts(copies.mapInArrow(inside, "bag int, k string, d string"), "bag", "d", "k", sizes, left)
    for b, cut in cuts.items():
        limits[b] = f"{prefix[b]:0{DIGITS}x}".ljust(32, "f") if cut.digest == EVERYTHING else cut.digest
    return limits


def _kept_copies(seed: int, limits: dict[int, str]):
    """Copies of a row, of those drawn into each bag, up to the bag's last digest."""
    n_bags = len(limits)
    # A digest names one (bag, row, copy), so comparing digests is enough.
    ends = [limits[b] for b in range(n_bags)]
    most = np.array([e != NOTHING.digest for e in ends])
    last = ["f" * 32 if e == EVERYTHING else e or "0" * 32 for e in ends]
    high_end = np.array([int(e[:16], 16) for e in last], dtype=np.uint64)
    low_end = np.array([int(e[16:], 16) for e in last], dtype=np.uint64)

    @F.arrow_udf("array<int>")
    def kept(keys: pa.Array, drawn: pa.Array) -> pa.Array:
        bag, row, _, high, low = _copies(keys, drawn, n_bags, seed)
        end = high_end[bag]
        within = most[bag] & ((high < end) | ((high == end) & (low <= low_end[bag])))
        n = np.bincount((row * n_bags + bag)[within], minlength=len(keys) * n_bags).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * n_bags), pa.array(n))

    return kept


def explode_bags(df: DataFrame, weights: str = "bag_w") -> DataFrame:
    """One row per copy in a bag, with its ``bag``; absent rows never appear."""
    bags = F.flatten(
        F.transform(weights, lambda w, b: F.array_repeat(b, w))
    )
    return df.withColumn("bag", F.explode(bags)).drop(weights)


def bag_sizes(df: DataFrame, label: str, weights: str = "bag_w") -> DataFrame:
    """Copies per (bag, class)."""
    return (
        df.select(label, F.posexplode(weights).alias("bag", "n")).where("n > 0")
        .groupBy("bag", label).agg(F.sum("n").cast("bigint").alias("n"))
    )
