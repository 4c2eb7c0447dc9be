"""Running sums, the neighbour estimate of information, the approximate join and
preparation options, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lopside.catalog.learning import SMALL_GRIDS
from lopside.operators import approximate, metrics, reduce, running
from lopside.operators.neighbors import knn_join
from lopside.plans import families
from lopside.plans.prepare import fit_prepare
from lopside.schema import FEATURES, KEY, LABEL
from lopside.sources.patient import patient
from lopside.sources.report import report_rows


@pytest.mark.parametrize("part_rows", [7, 1_000_000])
def test_running_sums_of_a_hot_group(spark, monkeypatch, part_rows):
    monkeypatch.setattr(running, "PART_ROWS", part_rows)
    rnd = np.random.default_rng(1)
    rows = [("hot" if rnd.random() < 0.6 else None if rnd.random() < 0.3 else f"g{rnd.integers(4)}", i,
             int(rnd.integers(0, 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, at int, v int").repartition(5)
    want, total = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        total[g] = total.get(g, 0) + v
        want[at] = total[g]
    got = running.running_sums(df, ["g"], ["at"], ["v"])
    assert got.columns == ["g", "at", "v", "v_upto"]
    assert {r["at"]: r["v_upto"] for r in got.collect()} == want
    monkeypatch.setattr(running, "BROADCAST_ROWS", 0)
    assert {r["at"]: r["v_upto"] for r in running.running_sums(df, ["g"], ["at"], ["v"]).collect()} == want
    assert running.running_sums(df.limit(0), ["g"], ["at"], ["v"]).count() == 0


@pytest.mark.parametrize("part_rows", [5, 1_000_000])
def test_area_of_groups_of_unlike_size(spark, monkeypatch, part_rows):
    monkeypatch.setattr(running, "PART_ROWS", part_rows)
    rnd = np.random.default_rng(2)
    rows = [("big" if i < 150 else "small", int(rnd.integers(2)), float(rnd.integers(30)) / 7) for i in range(160)]
    got = {r["g"]: r["auc"] for r in metrics.roc_auc(
        spark.createDataFrame(rows, "g string, y int, p double"), by=["g"]).collect()}
    for g in ("big", "small"):
        pairs = [(p > q) + 0.5 * (p == q) for a, y, p in rows for b, z, q in rows if a == b == g and y == 1 and z == 0]
        assert got[g] == pytest.approx(np.mean(pairs))


def psi(n):
    return -np.euler_gamma + sum(1 / i for i in range(1, n))


@pytest.mark.parametrize("bucket", [4, 10_000])
def test_neighbour_information_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(reduce, "BUCKET_ROWS", bucket)
    rnd = np.random.default_rng(3)
    n = 160
    y = rnd.integers(0, 2, n)
    columns = {"near": y * 2.0 + rnd.integers(0, 64, n) / 32, "noise": rnd.integers(0, 256, n) / 64,
               "flag": (y ^ (rnd.random(n) < 0.1)).astype(float), "same": np.zeros(n)}
    rows = [(int(y[i]), *[float(c[i]) for c in columns.values()]) for i in range(n)]
    rows += [(2, 5.0, 5.0, 5.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0), (1, None, None, None, None)]
    df = spark.createDataFrame(rows, "y int, near double, noise double, flag double, same double").repartition(3)
    got = {r["feature"]: r["mi"] for r in reduce.neighbor_information(df, list(columns), "y").collect()}
    for name, x in columns.items():
        terms = []
        for i in range(n):
            own = np.sort(np.abs(x[(y == y[i]) & (np.arange(n) != i)] - x[i]))
            r = own[2]
            m = int((np.abs(x - x[i]) < r).sum()) if r > 0 else int((x == x[i]).sum())
            terms.append(psi(n) + psi(3) - psi(int((y == y[i]).sum())) - psi(m))
        assert got[name] == pytest.approx(max(0.0, np.mean(terms)), abs=1e-6)
    assert got["near"] > 0.3 > got["noise"]


def test_approximate_join_finds_nearly_all(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(12, 16)) * 4
    x = centres[rnd.integers(12, size=600)] + rnd.normal(size=(600, 16))
    x[:80] = x[0]  # a mass of equal rows
    rows = [(i, [float(v) for v in r], int(i % 2)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "pid long, x array<double>, y int").repartition(4).cache()
    exact = knn_join(df, df, 5, 2, "pid", label="y", exclude_self=True)
    for bucket, block in ((4096, 32_768), (40, 16)):
        monkeypatch.setattr(approximate, "BUCKET_ROWS", bucket)
        found = approximate.knn_approximate(df, df, 5, label="y", exclude_self=True, block_rows=block, chunk_rows=64)
        rows_found = found.collect()
        for r in rows_found[:50]:
            assert r["dist"] == pytest.approx(np.linalg.norm(x[r["q"]] - x[r["r"]])) and r["q"] != r["r"]
            assert r["y"] == r["r"] % 2
        assert len({(r["q"], r["rank"]) for r in rows_found}) == len(rows_found)
        total = approximate.recall(found, exact, 5).agg(F.sum("hits") / F.sum("wanted"), F.count(F.lit(1))).first()
        assert total[0] >= 0.9 and total[1] == 600
    assert approximate.knn_approximate(df, df.limit(0), 5).count() == 0


def test_preparation_of_tables_that_come_split(spark, sf):
    rows = patient(spark, sf)
    train, test = rows.where("pid % 4 > 0"), rows.where("pid % 4 = 0")
    parts = fit_prepare(train, test=test, keep=True)
    keys = lambda name: {r[0] for r in parts.part(name).select(KEY).collect()}
    assert keys("test") == {r[0] for r in test.select(KEY).collect()}
    assert not keys("train") & keys("val") and len(keys("train") | keys("val")) == train.count()
    # Test rows take no part in what is fitted.
    other = fit_prepare(train, test=test.withColumn("glucose", F.lit(1e6)))
    assert other.medians == parts.medians and other.scaler == parts.scaler


def test_over_sampling_balances_the_train_part_alone(spark, sf):
    plain = fit_prepare(patient(spark, sf), keep=True)
    grown = fit_prepare(patient(spark, sf), oversample=True, keep=True)
    assert grown.key == "sid" and grown.table.columns == ["sid", LABEL, "split", *FEATURES]
    count = lambda parts: {(r["split"], r[LABEL]): r["count"] for r in parts.table.groupBy("split", LABEL).count().collect()}
    before, after = count(plain), count(grown)
    assert after[("train", 1)] == after[("train", 0)] == before[("train", 0)]
    assert all(after[k] == before[k] for k in before if k[0] != "train")
    result = families.train_family("nb", grown, families.family_configs("nb", SMALL_GRIDS))
    assert result.metrics.first()["auc"] > 0.7


def test_confusion_labels(spark):
    df = spark.createDataFrame([(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)], "y int, pred int")
    got = {r["cell"]: r["label"] for r in metrics.confusion_labels(df).collect()}
    assert got == {"tn": "TN\n5\n(62.5%)", "fp": "FP\n2\n(25.0%)", "fn": "FN\n0\n(0.0%)", "tp": "TP\n1\n(12.5%)"}
    assert metrics.confusion_labels(df.limit(0)).where("label LIKE '%(0.0%)'").count() == 4


def test_report_from_training(parts, tmp_path):
    grids = {"nb": SMALL_GRIDS["nb"], "lr": [("BalancedBagging", {"penalty": ["bad"], "C": [1.0], "n": [1]})]}
    report, trained = families.train_report(
        parts, "2024-01-01T00:00:00", ["a note"], grids, ["lr", "nb"], path=str(tmp_path / "report"))
    row = report.first()
    assert list(row["errors"]) == ["lr"] and list(row["models"]) == ["nb"] == list(trained)
    flat = report_rows(report).collect()
    assert [r["family"] for r in flat] == ["nb"] and flat[0]["training_timestamp"] == "2024-01-01T00:00:00"
    assert report.sparkSession.read.json(str(tmp_path / "report")).count() == 1
