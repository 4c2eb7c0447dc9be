import numpy as np
import pytest
from pyspark.sql import functions as F

import lopside.operators.sampling as R
from lopside.schema import KEY, LABEL
from lopside.sources.patient import patient


@pytest.fixture(scope="module")
def rows(spark, sf):
    return patient(spark, sf).select(KEY, LABEL).cache()


def test_published_split_sizes():
    import math

    assert math.ceil(round(0.2 * 4240, 9)) == 848
    assert math.ceil(round(0.15 * 3392, 9)) == 509


def test_largest_remainder_gives_the_lower_class_first():
    assert R.largest_remainder({0: 5, 1: 5}, 3) == {0: 2, 1: 1}


def test_split_is_exact_and_complete(rows):
    n = rows.count()
    counts = {
        r["split"]: r["n"]
        for r in R.three_way_split(rows, LABEL, 0.2, 0.15, 42, KEY)
        .groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    assert sum(counts.values()) == n
    assert counts["test"] == -(-n // 5)
    no_val = R.three_way_split(rows, LABEL, 0.2, 0.0, 42, KEY)
    assert no_val.where("split = 'val'").isEmpty()


def test_results_do_not_depend_on_partitioning(rows):
    pick = lambda df: {r[KEY] for r in R.undersample(df, LABEL, 7, KEY).collect()}
    assert pick(rows.repartition(1)) == pick(rows.repartition(16))


def test_cuts_agree_with_and_without_buckets(rows, monkeypatch):
    pick = lambda: {r[KEY] for r in R.undersample(rows, LABEL, 7, KEY).collect()}
    whole = pick()
    monkeypatch.setattr(R, "BUCKET_ROWS", 20)
    assert pick() == whole


def test_undersampling_balances(rows):
    counts = {r[LABEL]: r["count"] for r in R.undersample(rows, LABEL, 42, KEY).groupBy(LABEL).count().collect()}
    assert counts[0] == counts[1] == rows.where(F.col(LABEL) == 1).count()


def test_bags_are_balanced_and_prefixes(rows):
    five = R.balanced_bags(rows, LABEL, 5, 42, KEY)
    sizes = {(r["bag"], r[LABEL]): r["n"] for r in R.bag_sizes(five, LABEL).collect()}
    for b in range(5):
        assert sizes[(b, 0)] == sizes[(b, 1)]
    three = R.balanced_bags(rows, LABEL, 3, 42, KEY)
    cut = five.select(KEY, F.slice("bag_w", 1, 3).alias("bag_w"))
    assert cut.exceptAll(three.select(KEY, "bag_w")).isEmpty()


def test_bootstrap_draws_look_poisson(rows):
    draws = np.array([r["draws"] for r in R.bootstrap(rows, 20, 1, KEY).collect()]).ravel()
    assert draws.mean() == pytest.approx(1.0, abs=0.03)
    assert draws.var() == pytest.approx(1.0, abs=0.06)


def test_one_class_is_refused(rows):
    with pytest.raises(ValueError, match="two classes"):
        R.undersample(rows.where(F.col(LABEL) == 0), LABEL, 1, KEY)


def test_poisson_draws_reach_the_resolution_of_the_uniform():
    from lopside.operators.sampling import POISSON_CDF

    assert 1 - POISSON_CDF[-1] < 2.0**-32 <= 1 - POISSON_CDF[-2]


def test_null_labels_are_an_error(spark):
    import pytest

    from lopside.operators.sampling import three_way_split

    rows = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "pid int, y int")
    with pytest.raises(ValueError, match="1 rows"):
        three_way_split(rows, "y", 0.2, 0.2, 1, "pid")


def test_cuts_descend_into_full_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lopside.operators import sampling

    monkeypatch.setattr(sampling, "BUCKET_ROWS", 2)
    monkeypatch.setattr(sampling, "DIGITS", 1)
    rows = spark.range(1000).select(F.col("id").alias("pid"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    got = {r["pid"] for r in sampling.undersample(rows, "y", 7, "pid").where("y = 0").collect()}
    ranked = rows.where("y = 0").orderBy(sampling.seeded_hash(7, "pid"), "pid").limit(200)
    assert got == {r["pid"] for r in ranked.collect()}
