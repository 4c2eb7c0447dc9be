import pytest
from pyspark.sql import functions as F

import lopside.operators.metrics as M
from lopside.functions.thresholds import family_grid, threshold_grid
from lopside.operators.ranking import category_winners, compare_models, rank_board
from lopside.session import small_table
from lopside.sources.patient import scored_patients
from lopside.sources.report import build_report, report_rows, write_report

# Published confusion counts and metrics (848 rows, 129 positive).
GOLDEN = {
    "lr": (326, 393, 18, 111, 0.37, 0.5153301886792453, 0.22023809523809523, 0.8604651162790697, 0.35071090047393366, 0.7008226326400793),
    "dt": (547, 172, 69, 60, 0.5649999999999998, 0.7158018867924528, 0.25862068965517243, 0.46511627906976744, 0.33240997229916897, 0.6725641772056365),
    "knn": (482, 237, 49, 80, 0.48499999999999976, 0.6627358490566038, 0.25236593059936907, 0.6201550387596899, 0.35874439461883406, 0.678499423186812),
    "nb": (589, 130, 80, 49, 0.4650000000000003, 0.7523584905660378, 0.2737430167597765, 0.3798449612403101, 0.3181818181818182, 0.6809899623723732),
    "rf": (556, 163, 71, 58, 0.5250000000000001, 0.7240566037735849, 0.26244343891402716, 0.4496124031007752, 0.3314285714285714, 0.6676747420512987),
    "xgb": (540, 179, 68, 61, 0.5500000000000003, 0.7087264150943396, 0.25416666666666665, 0.4728682170542636, 0.33062330623306235, 0.6783862168601956),
}
MCC = {"lr": 0.229572, "dt": 0.181983, "knn": 0.215662, "nb": 0.175169, "rf": 0.182371, "xgb": 0.178516}


@pytest.fixture(scope="module")
def golden(spark):
    """Each matrix expanded to its 848 rows."""
    cells = [
        (f, y, p, n)
        for f, (tn, fp, fn, tp, *_) in GOLDEN.items()
        for y, p, n in ((0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp))
    ]
    table = small_table(spark, cells, "family string, y int, pred int, n int")
    return table.select("family", "y", "pred", F.explode(F.sequence(F.lit(1), "n"))).drop("col")


def test_golden_metrics(golden):
    for r in M.binary_metrics(golden, by=["family"]).collect():
        want = GOLDEN[r["family"]]
        assert (r["tn"], r["fp"], r["fn"], r["tp"]) == want[:4]
        assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == pytest.approx(want[5:9], abs=1e-12)
        assert r["mcc"] == pytest.approx(MCC[r["family"]], abs=1e-6)


def golden_board(spark):
    rows = [(f, "bags", v[4], *v[5:]) for f, v in GOLDEN.items()]
    schema = "family string, strategy string, threshold double, accuracy double, precision double, recall double, f1 double, auc double"
    return compare_models(small_table(spark, rows, schema))


def test_golden_leaderboard(spark):
    board = golden_board(spark)
    winners = {r["metric"]: r["family"] for r in category_winners(board).collect()}
    assert winners == {"f1": "knn", "accuracy": "nb", "precision": "nb", "recall": "lr", "auc": "lr"}
    first = rank_board(board).where("rank = 1").first()
    assert first["family"] == "knn"


def test_report_round_trip(spark, tmp_path):
    report = build_report(golden_board(spark), "2024-01-01T00:00:00", ["a note"], {"knn": "failed"})
    path = str(tmp_path / "report")
    write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    row = back.first()
    assert row["models"]["nb"]["f1"] == GOLDEN["nb"][8] and row["errors"] == {"knn": "failed"}
    assert [r["family"] for r in report_rows(back).orderBy("pos").collect()] == list(GOLDEN)


def test_grids_hold_published_thresholds():
    sizes = {"dt": 180, "knn": 90, "nb": 120, "rf": 80, "xgb": 71, "xgb_best_possible": 140}
    for family, size in sizes.items():
        assert len(family_grid(family)) == size
    for family in ("dt", "knn", "nb", "rf", "xgb"):
        assert GOLDEN[family][4] in family_grid(family)


def scored(spark, rows):
    return spark.createDataFrame(rows, "y int, p double")


def test_auc_ties_count_half(spark):
    df = scored(spark, [(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)])
    assert M.roc_auc(df).first()["auc"] == 0.875


def test_auc_symmetry_and_monotone_maps(spark, sf):
    df = scored_patients(spark, sf)
    area = M.roc_auc(df).first()["auc"]
    assert area == pytest.approx(0.923026, abs=1e-6)
    assert M.roc_auc(df.withColumn("p", -F.col("p"))).first()["auc"] == pytest.approx(1 - area)
    assert M.roc_auc(df.withColumn("p", F.exp("p"))).first()["auc"] == pytest.approx(area)


def test_auc_of_one_class_is_null(spark):
    assert M.roc_auc(scored(spark, [(1, 0.5)])).first()["auc"] is None


def test_auc_by_group_equals_each_alone(spark, sf):
    df = scored_patients(spark, sf).withColumn("g", F.col("pid") % 3)
    by = {r["g"]: r["auc"] for r in M.roc_auc(df, by=["g"]).collect()}
    for g, area in by.items():
        assert area == pytest.approx(M.roc_auc(df.where(F.col("g") == g)).first()["auc"])


def test_sweep_equals_thresholding(spark, sf):
    df = scored_patients(spark, sf)
    sweep = M.threshold_sweep(df, family_grid("rf")).orderBy("threshold").collect()
    recalls = [r["recall"] for r in sweep]
    assert recalls == sorted(recalls, reverse=True)
    for r in sweep[::20]:
        alone = M.binary_metrics(M.apply_threshold(df, r["threshold"])).first()
        assert (alone["tp"], alone["fp"], alone["f1"]) == (r["tp"], r["fp"], r["f1"])


def test_sweep_edges_fall_on_the_literal(spark):
    grid = threshold_grid(0.05, 0.95)
    df = scored(spark, [(1, t) for t in grid])
    counted = {r["threshold"]: r["tp"] for r in M.threshold_sweep(df, grid).collect()}
    assert [counted[t] for t in grid] == list(range(len(grid), 0, -1))


def test_uneven_thresholds(spark):
    df = scored(spark, [(1, 0.3), (0, 0.2)])
    got = {r["threshold"]: (r["tp"], r["fp"]) for r in M.threshold_sweep(df, [0.1, 0.25, 0.9]).collect()}
    assert got == {0.1: (1, 1), 0.25: (1, 0), 0.9: (0, 0)}


def test_many_uneven_thresholds_are_searched_by_halves(spark):
    grid = sorted({t for f in ("lr", "nb", "rf", "xgb") for t in family_grid(f)})
    points = [*grid, 0.0, 0.999, float("nan")]
    df = scored(spark, [(1, p) for p in points])
    swept = M.threshold_sweep(df, grid)
    assert {r["threshold"]: r["tp"] for r in swept.collect()} == {
        t: sum(p != p or p >= t for p in points) for t in grid}
    # No row is compared with every threshold.
    assert "filter(" not in swept._jdf.queryExecution().optimizedPlan().toString()


def test_lower_threshold_wins_ties(spark):
    df = scored(spark, [(1, 0.8), (0, 0.1)])
    best = M.best_threshold(M.threshold_sweep(df, [0.2, 0.4, 0.6]), 0.5).first()
    assert best["threshold"] == 0.2 and best["f1"] == 1.0


def test_default_threshold_without_any_hit(spark):
    df = scored(spark, [(1, 0.0), (0, 0.0)])
    best = M.best_threshold(M.threshold_sweep(df, family_grid("nb")), 0.35).first()
    assert (best["threshold"], best["f1"], best["precision"]) == (0.35, 0.0, 0.0)


def test_class_report_averages(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, pred int")
    report = {r["class"]: r for r in M.classification_report(df).collect()}
    assert report["0"]["precision"] == 1.0 and report["0"]["recall"] == 0.5
    assert report["macro avg"]["recall"] == 0.75 and report["accuracy"]["f1"] == 0.75
    assert report["weighted avg"]["support"] == 4
