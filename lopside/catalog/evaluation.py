"""Metric, threshold, ranking and report queries over score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.catalog.tabular import rounded
from lopside.functions.thresholds import GRIDS, family_default, family_grid
from lopside.operators import metrics as M
from lopside.operators import ranking as K
from lopside.plans.search import config_table, evaluate_scores, param_grid
from lopside.schema import KEY, LABEL
from lopside.sources.patient import patient, scored_patients
from lopside.sources.report import build_report, report_rows

FIVE = ["accuracy", "precision", "recall", "f1", "mcc"]
CUT = 0.6

# A grid of linear rules over three columns, standing in for a learner whose
# scores both engines can compute.
RULES = {"age": [5, 10, 20], "sbp": [2, 4], "male": [0, 80]}

# One rule per family, scored at the family's default threshold.
FAMILY_RULES = {
    "lr": (10, 4, 80), "dt": (10, 0, 0), "knn": (0, 4, 0),
    "nb": (10, 4, 0), "rf": (0, 4, 80), "xgb": (20, 4, 80),
}

BY_SEGMENT = ["c_mktsegment"]


def predicted(spark, d):
    return M.apply_threshold(scored_patients(spark, d), CUT)


def rule_scores(spark, d, configs):
    """One row per (rule, patient); ``configs`` is a short list of weights."""
    rules = F.array(*[
        F.struct(F.lit(name).alias("id"), *[F.lit(float(w)).alias(c) for c, w in zip("abc", weights)])
        for name, weights in configs.items()
    ])
    a, b, c = F.col("r.a"), F.col("r.b"), F.col("r.c")
    score = (a * (F.col("age") - 32.0) + b * (F.col("sysBP") - 95.0) + c * F.col("male")) / (
        a * 38.0 + b * 99.0 + c
    )
    return patient(spark, d).select(
        KEY, F.col(LABEL).alias("y"), "age", "sysBP", "male", F.explode(rules).alias("r")
    ).select("r.id", KEY, "y", F.round(score, 4).alias("p"))


def grid():
    return param_grid(RULES, "rule", "linear", 0)


def grid_scores(spark, d):
    weights = {c["config_id"]: tuple(c["params"].values()) for c in grid()}
    return rule_scores(spark, d, weights).withColumnRenamed("id", "config_id")


def grid_results(spark, d):
    low, high, step, default = GRIDS["dt"]
    results = evaluate_scores(grid_scores(spark, d), family_grid("dt"), default)
    return results.join(F.broadcast(config_table(spark, grid())), "config_id").withColumn(
        "strategy", F.concat(F.lit("age"), F.col("params")["age"])
    )


RESULT_VALUES = ["val_f1", "val_prec", "val_rec", "val_auc"]
RESULT_COLUMNS = ["config_id", "strategy", "threshold", *RESULT_VALUES]


def predict(spark, d):
    return predicted(spark, d)


def risk_table(spark, d):
    # The features are columns of the scored rows, so nothing is joined.
    orders = scored_patients(spark, d, ["o_custkey", "o_totalprice"])
    rows = M.apply_threshold(orders, CUT).select(
        KEY, "p", "pred", (F.col("o_custkey") % 39 + 32).cast("double").alias("age"),
        (F.lit(95) + F.floor("o_totalprice").cast("bigint") % 100).cast("double").alias("sysBP"))
    return M.risk_label(rows, [KEY, "age", "sysBP"])


def confusion(spark, d):
    return rounded(M.confusion_cells(predicted(spark, d)), ["share"])


def confusion_labels(spark, d):
    return M.confusion_labels(predicted(spark, d))


def metrics(spark, d):
    return rounded(M.binary_metrics(predicted(spark, d)), FIVE)


def metrics_long(spark, d):
    one = M.evaluate(scored_patients(spark, d), CUT)
    return rounded(M.metrics_long(one, [*FIVE, "auc"]), ["value"])


def metrics_by_segment(spark, d):
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_mktsegment")
    rows = M.apply_threshold(scored_patients(spark, d, ["o_custkey"]), CUT)
    rows = rows.withColumnRenamed("o_custkey", "c_custkey").join(customers, "c_custkey")
    counted = M.binary_metrics(rows, by=BY_SEGMENT).join(M.roc_auc(rows, by=BY_SEGMENT), BY_SEGMENT)
    return rounded(counted, [*FIVE, "auc"])


def auc(spark, d):
    return rounded(M.roc_auc(scored_patients(spark, d)), ["auc"])


def class_report(spark, d):
    return rounded(M.classification_report(predicted(spark, d)), ["precision", "recall", "f1"])


def sweep(spark, d):
    return rounded(
        M.threshold_sweep(scored_patients(spark, d), family_grid("dt")),
        ["threshold", "f1", "precision", "recall"],
    )


def best_threshold(spark, d):
    """The best threshold on every family's own grid."""
    # One sweep over all grids' thresholds; each family then takes its own.
    every = sorted({t for f in GRIDS for t in family_grid(f)})
    swept = M.threshold_sweep(scored_patients(spark, d), every)
    families = F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(float(family_default(f))).alias("default"),
                 F.array(*[F.lit(float(t)) for t in family_grid(f)]).alias("grid"))
        for f in GRIDS
    ])
    own = swept.withColumn("of", F.explode(families)).where(F.array_contains("of.grid", F.col("threshold")))
    best = own.groupBy("of.family", "of.default").agg(
        F.max_by(F.struct("threshold", "f1", "precision", "recall"),
                 F.struct("f1", -F.col("threshold"))).alias("b"))
    chosen = F.when(F.col("b.f1") == 0, F.col("default")).otherwise(F.col("b.threshold"))
    return rounded(best.select(
        "family", chosen.alias("threshold"), "b.f1", "b.precision", "b.recall"
    ), ["threshold", "f1", "precision", "recall"])


def best_possible(spark, d):
    low, high, step, default = GRIDS["xgb_best_possible"]
    found = M.best_possible_threshold(scored_patients(spark, d), family_grid("xgb_best_possible"), default)
    return rounded(found, ["threshold", "f1"])


def test_metrics(spark, d):
    return rounded(M.evaluate(scored_patients(spark, d), CUT), [*FIVE, "auc"])


def grid_query(spark, d):
    """Each configuration with its share of rows at or above one half."""
    counted = grid_scores(spark, d).groupBy("config_id").agg(
        F.count_if(F.col("p") >= 0.5).alias("n_high")
    )
    table = config_table(spark, grid())
    return counted.join(F.broadcast(table), "config_id").select(
        "config_id", "strategy", F.col("params")["age"].alias("age"),
        F.col("params")["sbp"].alias("sbp"), F.col("params")["male"].alias("male"), "n_high",
    )


def eval_configs(spark, d):
    return shown(grid_results(spark, d).select(*RESULT_COLUMNS))


def shown(results):
    return rounded(results, ["threshold", *RESULT_VALUES])


def top_configs(spark, d):
    return shown(K.top_configs(grid_results(spark, d).select(*RESULT_COLUMNS), 5))


def best_per_strategy(spark, d):
    return shown(K.best_per_strategy(grid_results(spark, d).select(*RESULT_COLUMNS)))


BOARD_VALUES = ["threshold", "accuracy", "precision", "recall", "f1", "auc"]


def board(spark, d):
    scores = rule_scores(spark, d, FAMILY_RULES).withColumnRenamed("id", "family")
    bounds = F.create_map(*[
        F.lit(v) for f in FAMILY_RULES for v in (f, family_default(f))
    ])
    flagged = M.apply_threshold(scores, bounds[F.col("family")])
    measured = (
        M.binary_metrics(flagged, by=["family"])
        .join(M.roc_auc(scores, by=["family"]), "family")
        .withColumns({"strategy": F.lit("rule"), "threshold": bounds[F.col("family")]})
    )
    return K.compare_models(measured)


def leaderboard(spark, d):
    return rounded(K.rank_board(board(spark, d)), BOARD_VALUES)


def winners(spark, d):
    return rounded(K.category_winners(board(spark, d)), ["value"])


def report(spark, d):
    built = build_report(rounded(board(spark, d), BOARD_VALUES), "2024-01-01T00:00:00", ["rules on patient"])
    return report_rows(built)


QUERIES = {
    "q_predict": predict,
    "q_risk_table": risk_table,
    "q_confusion": confusion,
    "q_metrics": metrics,
    "q_metrics_long": metrics_long,
    "q_metrics_by_segment": metrics_by_segment,
    "q_auc": auc,
    "q_class_report": class_report,
    "q_sweep": sweep,
    "q_best_threshold": best_threshold,
    "q_oracle_threshold": best_possible,
    "q_test_metrics": test_metrics,
    "q_grid": grid_query,
    "q_eval_configs": eval_configs,
    "q_top_configs": top_configs,
    "q_best_per_strategy": best_per_strategy,
    "q_leaderboard": leaderboard,
    "q_winners": winners,
    "q_report": report,
    "q_confusion_labels": confusion_labels,
}

_pred = f"predicted AS (SELECT *, (p >= {CUT}e0)::INTEGER AS pred FROM scored)"
_cells = f"cells AS (SELECT {S.CELLS} FROM predicted)"
_base = f"{S.SCORED}, {_pred}, {_cells}"


def _rule_ctes(rules: dict) -> str:
    rows = ", ".join(
        f"({k!r}, {a}e0, {b}e0, {c}e0)" for k, (a, b, c) in rules.items()
    )
    return f"""{S.PATIENT}, rules(id, a, b, c) AS (VALUES {rows}),
scores AS (SELECT id, pid, "{LABEL}" AS y,
  round((a * (age - 32e0) + b * ("sysBP" - 95e0) + c * male) / (a * 38e0 + b * 99e0 + c), 4) AS p
  FROM patient, rules)"""


_grid_rules = {c["config_id"]: tuple(c["params"].values()) for c in grid()}
_names = ", ".join(
    f"({c['config_id']}, '{c['params']['age']}', '{c['params']['sbp']}', '{c['params']['male']}')"
    for c in grid()
)
_results = f"""{_rule_ctes(_grid_rules)}, names(id, age, sbp, male) AS (VALUES {_names}),
{S.sweep_ctes('scores', 'sw', family_grid('dt'), 'id')},
{S.best_ctes('sw', 'best', 0.5, 'id')}, {S.auc_ctes('scores', 'area', 'id')},
results AS (
  SELECT best.id::INTEGER AS config_id, 'age' || names.age AS strategy, threshold,
    f1 AS val_f1, "precision" AS val_prec, recall AS val_rec, auc AS val_auc
  FROM best JOIN area ON area.id = best.id JOIN names ON names.id = best.id)"""
_bounds = " ".join(f"WHEN '{f}' THEN {family_default(f)!r}e0" for f in FAMILY_RULES)
_order = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(K.FAMILY_ORDER, start=1))
_board = f"""{_rule_ctes(FAMILY_RULES)},
cells AS (SELECT id, {S.CELLS} FROM (
  SELECT *, (p >= CASE id {_bounds} END)::INTEGER AS pred FROM scores) GROUP BY id),
{S.auc_ctes('scores', 'area', 'id')},
board AS (
  SELECT (CASE cells.id {_order} END)::INTEGER AS pos, cells.id AS family, 'rule' AS strategy,
    CASE cells.id {_bounds} END AS threshold,
    {S.metrics_select(('accuracy', 'precision', 'recall', 'f1'), 17)}, auc
  FROM cells JOIN area ON area.id = cells.id)"""

_shown = "config_id, strategy, " + ", ".join(f"round({c}, 6) AS {c}" for c in ["threshold", *RESULT_VALUES])
_board_shown = "pos, family, strategy, " + ", ".join(f'round({S.q(c)}, 6) AS {S.q(c)}' for c in BOARD_VALUES)

_segment = f"""{S.SCORED}, {_pred}, seg AS (
  SELECT c_mktsegment AS g, y, p, pred FROM predicted JOIN orders ON o_orderkey = pid
  JOIN customer ON c_custkey = o_custkey),
cells AS (SELECT g, {S.CELLS} FROM seg GROUP BY g), {S.auc_ctes('seg', 'area', 'g')}"""

_best_parts = []
_best_ctes = [S.SCORED]
for _f in GRIDS:
    _best_ctes += [
        S.sweep_ctes("scored", f"sw_{_f}", family_grid(_f)),
        S.best_ctes(f"sw_{_f}", f"best_{_f}", family_default(_f)),
    ]
    _best_parts.append(
        f"SELECT '{_f}' AS family, round(threshold, 6) AS threshold, round(f1, 6) AS f1, "
        f'round("precision", 6) AS "precision", round(recall, 6) AS recall FROM best_{_f}'
    )

_ratio = S.ratio
_report_rows = f"""
SELECT '0' AS class, p0 AS "precision", r0 AS recall, f0 AS f1, s0 AS support FROM r UNION ALL
SELECT '1', p1, r1, f1, s1 FROM r UNION ALL
SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM r UNION ALL
SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM r UNION ALL
SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
  (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM r"""

ORACLES = {
    "q_predict": f"WITH {S.SCORED}, {_pred} SELECT * FROM predicted",
    "q_risk_table": f"""WITH {S.SCORED}, {_pred}, {S.PATIENT}
SELECT CASE WHEN pred = 1 THEN 'High Risk' ELSE 'Low Risk' END AS predicted_risk, p AS confidence,
  predicted.pid, age, "sysBP" FROM predicted JOIN patient ON patient.pid = predicted.pid""",
    "q_confusion": f"WITH {_base} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS cell, {c} AS n, round({c}::DOUBLE / (tn + fp + fn + tp), 6) AS share FROM cells"
        for c in ("tn", "fp", "fn", "tp")
    ),
    "q_confusion_labels": f"WITH {_base} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS cell, concat_ws(chr(10), '{c.upper()}', {c}::VARCHAR, "
        f"printf('(%.1f%%)', {c}::DOUBLE / (tn + fp + fn + tp) * 100e0)) AS label FROM cells"
        for c in ("tn", "fp", "fn", "tp")
    ),
    "q_metrics": f"WITH {_base} SELECT tn, fp, fn, tp, {S.metrics_select()} FROM cells",
    "q_metrics_long": f"WITH {_base}, {S.auc_ctes('scored', 'area')} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({S.METRIC_SQL[m]}, 6) + 0e0 AS value FROM cells" for m in FIVE
    )
    + " UNION ALL SELECT 'auc', round(auc, 6) FROM area",
    "q_metrics_by_segment": f"""WITH {_segment}
SELECT cells.g AS c_mktsegment, tn, fp, fn, tp, {S.metrics_select()}, round(auc, 6) AS auc
FROM cells JOIN area ON area.g = cells.g""",
    "q_auc": f"WITH {S.SCORED}, {S.auc_ctes('scored', 'area')} SELECT round(auc, 6) AS auc FROM area",
    "q_class_report": f"""WITH {_base}, r AS (SELECT
  {_ratio('tn', 'tn + fn')} AS p0, {_ratio('tn', 'tn + fp')} AS r0, {_ratio('2 * tn', '2 * tn + fn + fp')} AS f0, tn + fp AS s0,
  {_ratio('tp', 'tp + fp')} AS p1, {_ratio('tp', 'tp + fn')} AS r1, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, tp + fn AS s1,
  {_ratio('tp + tn', 'tp + tn + fp + fn')} AS acc FROM cells)
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({_report_rows})""",
    "q_sweep": f"""WITH {S.SCORED}, {S.sweep_ctes('scored', 'sw', family_grid('dt'))}
SELECT round(threshold, 6) AS threshold, tn, fp, fn, tp, {S.metrics_select(('f1', 'precision', 'recall'))} FROM sw""",
    "q_best_threshold": "WITH " + ",\n".join(_best_ctes) + " " + " UNION ALL ".join(_best_parts),
    "q_oracle_threshold": f"""WITH {S.SCORED}, {S.sweep_ctes('scored', 'sw', family_grid('xgb_best_possible'))},
{S.best_ctes('sw', 'best', 0.5)} SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM best""",
    "q_test_metrics": f"""WITH {_base}, {S.auc_ctes('scored', 'area')}
SELECT tn, fp, fn, tp, {S.metrics_select()}, round(auc, 6) AS auc, {CUT}e0 AS threshold FROM cells, area""",
    "q_grid": f"""WITH {_rule_ctes(_grid_rules)}, names(id, age, sbp, male) AS (VALUES {_names})
SELECT names.id::INTEGER AS config_id, 'linear' AS strategy, names.age, names.sbp, names.male,
  count(*) FILTER (p >= 0.5e0) AS n_high FROM scores JOIN names ON names.id = scores.id GROUP BY ALL""",
    "q_eval_configs": f"WITH {_results} SELECT {_shown} FROM results",
    "q_top_configs": f"WITH {_results} SELECT {_shown} FROM results ORDER BY results.val_f1 DESC, config_id LIMIT 5",
    "q_best_per_strategy": f"""WITH {_results} SELECT {_shown} FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY val_f1 DESC, config_id) AS rn FROM results) WHERE rn = 1""",
    "q_leaderboard": f"WITH {_board} SELECT {_board_shown}, (row_number() OVER (ORDER BY board.f1 DESC, pos))::INTEGER AS rank FROM board",
    "q_winners": f"WITH {_board}, long AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, pos, family, {S.q(m)} AS value FROM board" for m in K.BOARD_METRICS)
    + """) SELECT metric, family, round(value, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, pos) AS rn FROM long) WHERE rn = 1""",
    "q_report": f"WITH {_board} SELECT '2024-01-01T00:00:00' AS training_timestamp, {_board_shown} FROM board",
}
