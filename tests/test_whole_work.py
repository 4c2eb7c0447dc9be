"""Queries do the work they are named for, and large inputs take the same paths' results."""

from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lopside.catalog import learning
from lopside.functions.digests import Keys
from lopside.learners import boost, grow, tree, whole
from lopside.operators import approximate, sampling
from lopside.plans import families


def test_bagged_neighbours_have_a_searched_number_of_bags(spark, sf, monkeypatch):
    grid = next(values for strategy, values in families.FULL_GRIDS["knn"] if strategy == "BB_PCA")
    asked = {}

    def fit(train, features, label, n_bags, **options):
        asked.update(options, n_bags=n_bags, drawn=train.select(F.size("bag_w")).first()[0])

    monkeypatch.setattr(learning.neighbors, "fit_bagged_neighbors", fit)
    monkeypatch.setattr(learning, "quality", lambda model, parts: None)
    learning.bag_pca_knn(spark, sf)
    assert asked["n_bags"] in grid["n"] and asked["drawn"] == asked["n_bags"]
    assert asked["n_components"] in grid["components"] and asked["k"] in grid["k"]


def test_a_query_row_goes_once_to_a_slice():
    slices = np.array([[5, 3, 5, 5], [1, 1, 1, 1]])
    buckets = np.array([[8, 9, 7, 8], [4, 2, 4, 2]])
    got = approximate._spots(slices[:, None, :], buckets[:, None, :]).to_pylist()
    assert got == [
        [{"slice": 3, "buckets": [9]}, {"slice": 5, "buckets": [7, 8]}], [{"slice": 1, "buckets": [2, 4]}]]


def test_approximate_join_over_many_slices_keeps_what_it_meets(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(500, 6))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pid long, x array<double>").repartition(3).cache()
    monkeypatch.setattr(approximate, "BUCKET_ROWS", 10)  # several directions
    found = {}
    for directions in (0, 2, 9):  # a bucket, some, all of them are a slice
        monkeypatch.setattr(approximate, "SLICE_DIRECTIONS", directions)
        near = approximate.knn_approximate(df, df, 4, exclude_self=True, tables=3, probes=6, chunk_rows=50)
        found[directions] = sorted((r["q"], r["rank"], r["r"], r["dist"]) for r in near.collect())
    assert found[0] == found[2] == found[9] and len(found[0]) > 1500


@pytest.fixture(scope="module")
def bagged_rows(spark):
    rnd = np.random.default_rng(11)
    n = 900
    x = np.round(np.c_[rnd.normal(size=(n, 4)), rnd.integers(0, 3, (n, 2)), np.zeros(n)], 1)
    y = (x[:, 0] + x[:, 4] + rnd.normal(size=n) > 1).astype(int)
    w = rnd.integers(0, 3, (n, 6))
    names = [f"f{j}" for j in range(x.shape[1])]
    rows = [(i, int(y[i]), *map(float, x[i]), [int(v) for v in w[i]]) for i in range(n)]
    schema = "pid long, y int, " + ", ".join(f"{c} double" for c in names) + ", bag_w array<int>"
    return spark.createDataFrame(rows, schema).repartition(4).cache(), names


def arrays(model):
    return {name: getattr(model, name) for name in ("feature", "cut", "left", "value", "root", "member", "round")}


@pytest.mark.parametrize("tried", ["sqrt", "0.7", "all"])
def test_trees_finished_in_tasks_are_those_of_the_passes(bagged_rows, monkeypatch, tried):
    df, names = bagged_rows
    fitted = {}
    for passes in (10**9, 0):
        monkeypatch.setattr(grow, "LEVEL_PASSES", passes)
        monkeypatch.setattr(grow, "NODE_BYTES", 1 << 14 if passes else 1 << 25)
        monkeypatch.setattr(whole, "SUM_CELLS", 512)
        fitted[passes] = arrays(tree.fit_trees(df, names, "y", None, 2, tried, 6, min_split=2))
    assert len(fitted[0]["left"]) > 6 * 60
    for name, expected in fitted[10**9].items():
        assert np.array_equal(fitted[0][name], expected), name


def test_deep_forests_need_few_passes(bagged_rows, monkeypatch):
    df, names = bagged_rows
    passes = []
    split_pass = grow._split_pass
    monkeypatch.setattr(grow, "_split_pass", lambda *a: passes.append(1) or split_pass(*a))
    monkeypatch.setattr(grow, "NODE_BYTES", 1 << 14)
    tree.fit_trees(df, names, "y", 20, 1, "sqrt", 6, min_split=2)
    assert len(passes) <= 8  # a pass for each few nodes before


def test_digests_of_many_texts_are_md5():
    rnd = np.random.default_rng(2)
    texts = [None, "", "é", "a" * 70] + [str(v) for v in rnd.integers(0, 10**9, 300)]
    bag, row, copy = rnd.integers(0, 120, 2000), rnd.integers(0, len(texts), 2000), rnd.integers(1, 12, 2000)
    high, low = Keys(pa.array(texts)).digests(42, bag, row, copy)
    for i in range(2000):
        text = ":".join(str(p) for p in (42, bag[i], texts[row[i]], copy[i]) if p is not None)
        assert f"{high[i]:016x}{low[i]:016x}" == md5(text.encode()).hexdigest()


def test_balanced_bags_keep_the_first_copies_in_seeded_order(spark, monkeypatch):
    rows = [(k, int(k % 5 == 0)) for k in range(300)] + [(7, 0), (None, 0)]
    df = spark.createDataFrame(rows, "pid long, y int").repartition(3)
    cdf = sampling.POISSON_CDF
    for together in (50_000, 0):  # buckets are ranked, or split down to single digests
        monkeypatch.setattr(sampling, "BUCKET_ROWS", together)
        got = sampling.balanced_bags(df, "y", 12, 42, "pid").collect()
        text = lambda *parts: ":".join(str(p) for p in parts if p is not None).encode()
        draws = lambda b, k: int(np.searchsorted(cdf, int(md5(text(42, b, k)).hexdigest()[:8], 16) / 2**32, side="right"))
        for b in range(12):
            n_min = sum(draws(b, k) for k, y in rows if y == 1)
            copies = sorted(md5(text(42, b, k, c)).hexdigest() for k, y in rows if y == 0 for c in range(1, draws(b, k) + 1))
            limit = copies[n_min - 1]
            for r in got:
                k = r["pid"]
                want = draws(b, k) if r["y"] == 1 else sum(
                    md5(text(42, b, k, c)).hexdigest() <= limit for c in range(1, draws(b, k) + 1))
                assert r["bag_w"][b] == want


@pytest.mark.parametrize("with_val", [False, True])
def test_boosting_in_tasks_is_that_of_the_passes(bagged_rows, monkeypatch, with_val):
    df, names = bagged_rows
    params = [boost.BoostParams(0.3, 3, 6, rows=1.0, columns=0.7), boost.BoostParams(0.4, 2, 12, 2.0, 0.05, rows=0.7)]
    fitted = []
    for size in (0, whole.TASK_BYTES):
        monkeypatch.setattr(boost, "TASK_BYTES", size)
        if with_val:
            held = df.where("pid % 3 = 0")
            models = boost.fit_boosted_early(df.where("pid % 3 > 0"), held, names, "y", params, patience=2)
            fitted.append([(arrays(m), rounds) for m, rounds in models])
        else:
            fitted.append([(arrays(boost.fit_boosted_bags(df, names, "y", p, 3)), p.rounds) for p in params])
    for (old, rounds), (new, rounds_too) in zip(*fitted):
        assert rounds == rounds_too
        for name, expected in old.items():
            assert np.allclose(new[name], expected, rtol=1e-9, atol=1e-12), name


def test_early_stopping_of_a_small_table_runs_no_job_a_round(bagged_rows, monkeypatch):
    df, names = bagged_rows

    def fail(*_):
        raise AssertionError("a job for a round")

    monkeypatch.setattr(boost, "grow", fail)
    model, rounds = boost.fit_boosted_early(
        df, df, names, "y", boost.BoostParams(0.3, 2, 25), patience=30)
    assert rounds == 25 and len(model.root) == 26
