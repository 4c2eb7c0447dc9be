import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lopside.operators import neighbors as kernel
from lopside.operators.approximate import knn_approximate
from lopside.operators.neighbors import knn_join, vote_shares
from lopside.operators.reduce import fit_bag_pca, fit_pca, mutual_information, select_k_best
from lopside.operators.resample import enn, smote, smote_rows, smoteenn, smotetomek, tomek_pairs

RNG = np.random.default_rng(3)


def table(spark, x, y=None, start=0, w=None):
    rows = [
        (start + i, [float(v) for v in row], int(y[i]) if y is not None else 0,
         [int(c) for c in w[i]] if w is not None else [1])
        for i, row in enumerate(x)
    ]
    return spark.createDataFrame(rows, "pid long, x array<double>, y int, bag_w array<int>")


def brute(q, r, k, p, exclude_self=False):
    gap = np.abs(q[:, None, :] - r[None, :, :])
    d = np.zeros(gap.shape[:2])
    for j in range(gap.shape[2]):
        d += gap[:, :, j] if p == 1 else gap[:, :, j] ** 2
    d = d if p == 1 else np.sqrt(d)
    if exclude_self:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {(i, int(j)): d[i, j] for i in range(len(q)) for j in order[i] if np.isfinite(d[i, j])}


def collected(df):
    return {(r["q"], r["r"]): r["dist"] for r in df.collect()}


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("dim", [2, 12])
def test_join_equals_brute_force_over_many_blocks(spark, p, dim):
    """Clustered points, a third of them identical, cut into tiny blocks."""
    x = np.vstack([
        RNG.normal(size=(90, dim)), RNG.normal(loc=8.0, size=(70, dim)), np.full((80, dim), 3.0)
    ]).round(1)
    q = np.vstack([x[::5], RNG.normal(loc=4.0, size=(20, dim)).round(1)])
    got = knn_join(table(spark, q), table(spark, x), 6, p, block_rows=25, chunk_rows=10)
    want = brute(q, x, 6, p)
    found = collected(got)
    assert found.keys() == want.keys()
    assert all(found[key] == want[key] for key in want)


def test_join_excludes_self_and_keeps_all_when_few(spark):
    x = RNG.normal(size=(40, 3)).round(2)
    df = table(spark, x)
    found = collected(knn_join(df, df, 5, 2, exclude_self=True, block_rows=7, chunk_rows=5))
    assert found == brute(x, x, 5, 2, True)
    assert len(collected(knn_join(df, table(spark, x[:3]), 5, 2))) == 40 * 3
    assert knn_join(df, df.limit(0), 5, 2).count() == 0


def test_join_far_clusters_route_only_where_needed(spark):
    """A query in one far cluster must still find neighbours in another when its own is small."""
    x = np.vstack([np.zeros((2, 2)), np.full((60, 2), 100.0) + RNG.normal(size=(60, 2))]).round(2)
    q = np.array([[0.0, 0.5]])
    got = collected(knn_join(table(spark, q), table(spark, x), 4, 2, block_rows=8))
    assert got == brute(q, x, 4, 2)


def test_join_shuffles_no_copies_of_the_reference(spark):
    """Blocks meet chunks in a nested-loop join; a cogroup would copy a block per chunk."""
    x = RNG.normal(size=(60, 3)).round(2)
    found = knn_join(table(spark, x), table(spark, x), 3, block_rows=8, chunk_rows=4)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    assert collected(found) == brute(x, x, 3, 2)


def test_join_leaves_out_rows_without_numbers(spark):
    """Such a row is nobody's neighbour and hides no other row of its block."""
    x = RNG.normal(size=(40, 3)).round(2)
    odd = np.vstack([x, [[np.nan, 0.0, 0.0]], [[np.inf, 0.0, 0.0]]])
    for p in (1, 2):
        found = collected(knn_join(table(spark, odd), table(spark, odd), 3, p, block_rows=64))
        assert found == brute(x, x, 3, p)


def test_manhattan_rows_within_a_loose_limit_are_whole_sums(spark):
    """The first columns leave many rows within the limit, and do not rank them."""
    rng = np.random.default_rng(11)
    q, r = np.zeros((6, 40)), np.hstack([rng.random((6000, 16)), 5 * rng.random((6000, 24))])
    r[300:, :16] += 100
    want = np.sort(np.abs(q[:, None, :] - r[None]).sum(axis=2), axis=1)
    rows, _, dist = kernel.nearest_rows(
        q, np.arange(6), r, np.arange(6000), 3, 1, False, want[:, 2] * 1.15)
    found = [np.sort(dist[rows == i]) for i in range(6)]
    assert all(np.allclose(found[i], want[i, :3]) for i in range(6))


def test_a_pair_of_chunk_and_block_compares_near_runs_only(monkeypatch):
    """Most rows of a large block are out of reach of a query row."""
    rng = np.random.default_rng(5)
    x, q = rng.random((8192, 2)), 0.3 * rng.random((64, 2))
    x, q = x[kernel._in_runs(x, 128)], q[kernel._in_runs(q, 32)]
    pair = pa.RecordBatch.from_pydict({
        "chunk": [0], "q": [list(range(64))], "x": [q.tobytes()], "bound": pa.array([None], pa.binary()),
        "r": [list(range(8192))], "rx": [x.tobytes()], "rlow": [x.min(axis=0).tolist()],
        "rhigh": [x.max(axis=0).tolist()], "y": [[0] * 8192], "bw": [np.ones(8192, np.int32).tobytes()],
    })
    compared, real = [], kernel.nearest_rows
    monkeypatch.setattr(kernel, "nearest_rows", lambda *a: (compared.append(len(a[0]) * len(a[2])), real(*a))[1])
    held = kernel._Chunk(0, pair, 0, 3, 2, 1, False, [0, 1])
    held.search(pair)
    assert sum(compared) < 64 * 8192 / 4
    got = {(int(i), int(j)): d for i, d, j in zip(*held.best[0][:3])}
    assert got == brute(q, x, 3, 2)


def test_cells_of_a_sample_hold_equal_shares():
    x = np.vstack([np.random.default_rng(2).normal(size=(900, 3)), np.full((300, 3), 9.0)])
    cuts = kernel._Cuts.fit(x, 16)
    counts = np.bincount(cuts.cells_of(x), minlength=len(cuts.centers))
    assert len(counts) == 16 and counts.sum() == 1200
    assert counts.max() == 300 and np.sort(counts)[-2] <= 2 * 900 / 15  # equal rows cannot be parted


def test_joins_pass_on_missing_labels(spark):
    x = RNG.normal(size=(30, 3)).round(2)
    df = table(spark, x).withColumn("y", F.when(F.col("pid") % 3 > 0, F.lit(1)))
    exact = knn_join(df, df, 2, 2, label="y", exclude_self=True)
    for found in (exact, knn_approximate(df, df, 2, label="y", exclude_self=True)):
        rows = found.collect()
        assert len(rows) == 60
        assert all(r["y"] == (1 if r["r"] % 3 else None) for r in rows)


def test_bags_in_one_pass_equal_separate_joins(spark):
    x, q = RNG.normal(size=(80, 4)).round(2), RNG.normal(size=(15, 4)).round(2)
    y = RNG.integers(0, 2, 80)
    w = RNG.poisson(0.7, size=(80, 3))
    ref = table(spark, x, y, w=w)
    near = knn_join(
        table(spark, q), ref, 5, 2, label="y", weights="bag_w", n_bags=3, block_rows=16, chunk_rows=4
    )
    got = {r["q"]: r["p"] for r in vote_shares(near, [5], ["uniform"]).collect()}
    for i in range(len(q)):
        shares = []
        for b in range(3):
            order = np.argsort(np.sqrt(((q[i] - x) ** 2).sum(1)), kind="stable")
            copies = np.repeat(order, w[order, b])[:5]
            shares.append(y[copies].mean())
        assert got[i] == pytest.approx(np.mean(shares))


def test_distance_votes_and_exact_hits(spark):
    x, y = np.array([[0.0], [1.0], [3.0]]), [1, 0, 0]
    near = knn_join(table(spark, np.array([[0.0], [0.5]])), table(spark, x, y), 3, 2, label="y")
    got = {(r["q"], r["weighting"]): r["p"] for r in vote_shares(near, [3], ["uniform", "distance"]).collect()}
    assert got[(0, "distance")] == 1.0  # the row at distance 0 takes the whole vote
    assert got[(0, "uniform")] == pytest.approx(1 / 3)
    assert got[(1, "distance")] == pytest.approx(2.0 / (2.0 + 2.0 + 0.4))


def test_oversampling_balances_and_interpolates(spark):
    x = RNG.normal(size=(100, 3))
    y = [1] * 10 + [0] * 90
    df = table(spark, x, y)
    new = smote_rows(df, "y", 42, block_rows=4).collect()
    assert len(new) == 80
    for r in new:
        low = np.minimum(x[r["base"]], x[r["neighbor"]]) - 1e-12
        high = np.maximum(x[r["base"]], x[r["neighbor"]]) + 1e-12
        assert ((low <= r["x"]) & (r["x"] <= high)).all()
    counts = {r["y"]: r["count"] for r in smote(df, "y").groupBy("y").count().collect()}
    assert counts == {0: 90, 1: 90}


def test_oversampling_needs_enough_minority_rows(spark):
    with pytest.raises(ValueError, match="minority"):
        smote(table(spark, RNG.normal(size=(20, 2)), [1] * 3 + [0] * 17), "y")


def test_cleaning_removes_an_isolated_minority_row(spark):
    x = np.vstack([RNG.normal(size=(30, 2)), [[0.0, 0.0]], RNG.normal(loc=50.0, size=(10, 2))])
    y = [0] * 30 + [1] + [1] * 10
    kept = {r["pid"] for r in enn(table(spark, x, y), "y", key="pid", block_rows=9).collect()}
    assert 30 not in kept and set(range(31, 41)) <= kept


def test_links_are_mutual_and_removed(spark):
    x, y = np.array([[0.0], [0.1], [5.0], [5.3], [9.0]]), [0, 1, 0, 0, 0]
    pairs = tomek_pairs(table(spark, x, y), "y", key="pid").collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(0, 1)]


def test_compositions_are_subsets_of_the_oversampled(spark):
    x = np.vstack([RNG.normal(size=(60, 2)), RNG.normal(loc=1.5, size=(15, 2))])
    df = table(spark, x, [0] * 60 + [1] * 15)
    whole = {r["sid"] for r in smote(df, "y").collect()}
    for clean in (smoteenn, smotetomek):
        kept = {r["sid"] for r in clean(df, "y", block_rows=32).collect()}
        assert kept < whole or kept == whole


def test_components_are_orthonormal(spark):
    x = RNG.normal(size=(200, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.1])
    fitted = fit_pca(table(spark, x), 3)
    assert np.allclose(fitted.loadings.T @ fitted.loadings, np.eye(3), atol=1e-9)
    assert fitted.explained == sorted(fitted.explained, reverse=True)
    w = RNG.poisson(1.0, size=(200, 2))
    bags = fit_bag_pca(table(spark, x, w=w).repartition(5), 3, 2)
    for b in range(2):
        cov = np.cov(np.repeat(x, w[:, b], axis=0).T)
        values = np.linalg.eigvalsh(cov)[::-1][:3]
        assert np.allclose(np.diag(bags[b].T @ cov @ bags[b]), values)


def test_information_ranks_the_informative_column(spark):
    df = spark.range(2000).select(
        (F.col("id") % 2).alias("y"), (F.col("id") % 2 + F.rand(1) * 0.1).alias("good"),
        F.rand(2).alias("noise"), F.lit(1.0).alias("constant"),
    )
    scores = mutual_information(df, ["good", "noise", "constant"], "y")
    got = {r["feature"]: r["mi"] for r in scores.collect()}
    assert got["good"] == pytest.approx(np.log(2), abs=1e-3)
    assert got["noise"] < 0.02 and got["constant"] == pytest.approx(0.0)
    assert select_k_best(scores, 1).first()["feature"] == "good"


def test_a_join_of_rows_with_themselves_writes_vectors_four_times(spark):
    from pathlib import Path

    from lopside.session import ensure_checkpoint_dir

    home = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(home.rglob("table-*"))
    rows = spark.createDataFrame([(i, [float(i % 17), float(i % 5)]) for i in range(200)], "pid long, x array<double>")
    apart = rows.select("pid", "x")
    alone = {(r["q"], r["rank"]): (r["r"], r["dist"]) for r in knn_join(rows, apart, 3, exclude_self=True).collect()}
    between = set(home.rglob("table-*"))
    same = {(r["q"], r["rank"]): (r["r"], r["dist"]) for r in knn_join(rows, rows, 3, exclude_self=True).collect()}
    # The rows, their blocks, their chunks, and the chunks with how far they look.
    assert len(set(home.rglob("table-*")) - between) == 4 and len(between - before) == 5
    assert same == alone and len(same) == 600


def test_synthetic_rows_get_vectors_per_pair_of_ends(spark):
    few = [(i, 1, [float(i * i % 11), float(i % 3)]) for i in range(8)]
    rows = [*few, few[3], *[(100 + i, 0, [0.0, 0.0]) for i in range(60)]]  # one key twice
    df = spark.createDataFrame(rows, "pid long, y int, x array<double>")
    made = smote_rows(df, "y", 42)
    vector = {k: x for k, _, x in few}
    n_new = 60 - 9
    got = made.collect()
    assert {r["base"] for r in got} == set(vector)
    for r in got:
        want = [b + r["u"] * (n - b) for b, n in zip(vector[r["base"]], vector[r["neighbor"]])]
        assert r["x"] == want and r["y"] == 1
    copies = {(r["base"], r["copy"]) for r in got}
    per_base = {b: sum(c[0] == b for c in copies) for b in vector}
    assert sum(n * (2 if b == 3 else 1) for b, n in per_base.items()) == n_new
    # A copy is a row of its own only after both vectors have come.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(_copies") < plan.index("Join ")
